"""Kana to romaji, and the spelling variants a reader may type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexmill import fixed
from lexmill.functions.text import as_col, literal_map


def kana_to_romaji(c) -> Column:
    """Romanise a reading already in search form (lower case, hiragana).

    Tokens are digraphs first, then single characters. A small tsu is kept
    only before a kana that romanises, and then doubles its first letter; a
    long mark repeats the last vowel written so far; anything unknown passes.
    """
    singles = "".join(fixed.ROMAJI_SINGLES)
    pairs = "|".join(fixed.ROMAJI_PAIRS)
    text = F.regexp_replace(as_col(c), f"っ(?![{singles}])", "")
    tokens = F.regexp_extract_all(text, F.lit(f"(?s){pairs}|."), F.lit(0))
    table = literal_map({**fixed.ROMAJI_PAIRS, **fixed.ROMAJI_SINGLES})
    latin = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))
    spelled = F.aggregate(
        latin,
        F.lit(""),
        lambda done, t: F.concat(
            done, F.when(t == "ー", F.regexp_extract(done, "([aeiou])[^aeiou]*$", 1)).otherwise(t)
        ),
    )
    return F.regexp_replace(spelled, "っ([a-z])", "$1$1")


def romaji_variants(c) -> Column:
    compact = F.regexp_replace(as_col(c), "[^a-z0-9]", "")
    kunrei = compact
    for hepburn, short in (("shi", "si"), ("chi", "ti"), ("tsu", "tu"), ("fu", "hu")):
        kunrei = F.replace(kunrei, F.lit(hepburn), F.lit(short))
    unmarked = compact
    for long, short in (("ou", "o"), ("oo", "o"), ("uu", "u"), ("ei", "e")):
        unmarked = F.replace(unmarked, F.lit(long), F.lit(short))
    return F.array_distinct(F.filter(F.array(compact, kunrei, unmarked), lambda x: x != ""))
