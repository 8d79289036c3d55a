"""Text normalisation as Column expressions.

Everything is a built-in expression except ``nfkc``, which has no JVM
counterpart and runs as one Arrow-batched pandas UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from lexmill import fixed

UNICODE_SPACE = r"(?U)\s"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_quote(text: str) -> str:
    """Escape a literal for a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-])", r"\\\1", text)


def literal_map(table: dict) -> Column:
    """Constant map; one parsed expression instead of a call per entry."""
    def sql(v):
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr("map(" + ",".join(f"{sql(k)},{sql(v)}" for k, v in table.items()) + ")")


def any_of(words) -> str:
    return "|".join(java_quote(w) for w in words)


def quoted(c) -> Column:
    """Escape a column value for use as a regular expression."""
    return F.regexp_replace(as_col(c), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def quoted_replacement(c) -> Column:
    return F.regexp_replace(as_col(c), r"([\\$])", r"\\$1")


# -- scalars -------------------------------------------------------------------

def strip(c) -> Column:
    return F.regexp_replace(as_col(c), r"(?U)^\s+|\s+$", "")


def strip_chars(c, characters: str) -> Column:
    cls = "[" + "".join(java_quote(ch) for ch in characters) + "]+"
    return F.regexp_replace(as_col(c), f"^{cls}|{cls}$", "")


def collapse(c) -> Column:
    """Trim and turn every run of white space into one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def clean(c) -> Column:
    return strip(F.coalesce(as_col(c), F.lit("")))


def to_hiragana(c) -> Column:
    return F.translate(as_col(c), fixed.KATAKANA_LETTERS, fixed.HIRAGANA_LETTERS)


#: Text of these characters alone is its own NFKC form; anything else may not be.
NFKC_STABLE = r"^[\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u3001-\u3020\u3041-\u3096\u309D\u309E\u30A1-\u30FE\u4E00-\u9FFF]*$"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


def nfkc(c) -> Column:
    """Compatibility form; only text that it can change is sent to Python."""
    text = as_col(c)
    stable = text.rlike(NFKC_STABLE)
    return F.when(stable, text).otherwise(_nfkc(F.when(~stable, text)))


def normalize_japanese(c, compatibility: bool = True) -> Column:
    """Match key of a written form: NFKC, no white space, hiragana.

    ``compatibility=False`` leaves NFKC out for text known to be free of
    compatibility forms, which keeps the expression in the JVM.
    """
    text = clean(c)
    if compatibility:
        text = nfkc(text)
    return to_hiragana(F.regexp_replace(text, r"(?U)\s+", ""))


def normalize_search(c, compatibility: bool = True) -> Column:
    text = F.coalesce(as_col(c), F.lit(""))
    if compatibility:
        text = nfkc(text)
    return to_hiragana(F.lower(text))


def kanji_reading_key(c, compatibility: bool = True) -> Column:
    text = normalize_search(c, compatibility)
    return F.regexp_replace(text, r"[.\-‐‑‒–—−]|(?U:\s)", "")


def non_empty(items) -> Column:
    """Drop empty and NULL items, then repeats; first occurrence stays."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def stripped_items(items) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x != "")


def split_list(c, both_semicolons: bool = False) -> Column:
    pattern = "[;；]" if both_semicolons else fixed.LIST_SEPARATOR
    return stripped_items(F.split(F.coalesce(as_col(c), F.lit("")), pattern))


def split_readings(c) -> Column:
    return F.array_distinct(stripped_items(F.split(F.coalesce(as_col(c), F.lit("")), "[、,，]")))


def join_list(c) -> Column:
    return F.coalesce(F.array_join(as_col(c), fixed.LIST_SEPARATOR), F.lit(""))


def display_list(c) -> Column:
    """List shown to a reader: joined, or a dash when there is nothing."""
    return F.when(F.size(as_col(c)) > 0, join_list(c)).otherwise(F.lit("-"))


def display_definitions(c) -> Column:
    return F.coalesce(F.array_join(F.filter(as_col(c), lambda x: x != ""), fixed.LIST_SEPARATOR), F.lit(""))


def first_definition(translations, glosses) -> Column:
    """First usable translation, else gloss, else the placeholder text."""
    def first(c):
        return F.get(F.filter(as_col(c), lambda x: x != ""), 0)

    return F.coalesce(first(translations), first(glosses), F.lit(fixed.NO_DEFINITION))


def maybe_float(c) -> Column:
    return strip(c).try_cast("double")


def maybe_int(c) -> Column:
    return maybe_float(c).try_cast("bigint")


# -- predicates and extraction --------------------------------------------------

def has_kanji(c) -> Column:
    return as_col(c).rlike(f"[{fixed.CJK}]")


def has_kana(c) -> Column:
    return as_col(c).rlike(f"[{fixed.KANA}]")


def kana_only(c) -> Column:
    return as_col(c).rlike(fixed.KANA_ONLY)


def has_japanese(c) -> Column:
    return as_col(c).rlike(f"[{fixed.KANA}{fixed.CJK}]")


def has_latin(c) -> Column:
    return as_col(c).rlike("[A-Za-z]")


def reading_like(c, compatibility: bool = True) -> Column:
    return kana_only(normalize_japanese(c, compatibility))


def characters(c) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit("(?s)."), F.lit(0))


def kanji_characters(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(as_col(c), F.lit(f"[{fixed.CJK}]"), F.lit(0)))


def kanji_runs(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(as_col(c), F.lit(f"[{fixed.CJK}]+"), F.lit(0)))


# -- level-list forms -------------------------------------------------------------

def writing_variants(c) -> Column:
    parts = stripped_items(F.split(clean(c), r"[/／]|(?U:\s){2,}"))

    def forms(part):
        plain = F.replace(part, F.lit("・"), F.lit(""))
        honorific = part.startswith("お・") | part.startswith("ご・")
        return F.when(
            honorific, F.array(plain, F.replace(F.substr(part, F.lit(3)), F.lit("・"), F.lit("")))
        ).otherwise(F.array(plain))

    return non_empty(F.flatten(F.transform(parts, forms)))


def reading_variants(c, writing, compatibility: bool = True) -> Column:
    """Kana readings listed for a writing; the writing itself if it is kana.

    The kana test works on the match key, so NFKC is applied to the joined
    list once rather than to each item.
    """
    writing = as_col(writing)
    value = strip(F.regexp_replace(clean(c), r"[（(][^）)]*[）)]", ""))
    parts = stripped_items(F.split(value, r"[/／,，、]|(?U:\s)+"))
    keys = F.split(normalize_joined(parts, compatibility), "\u0001")
    kept = F.transform(
        F.filter(F.arrays_zip(parts.alias("part"), keys.alias("key")), lambda x: kana_only(x["key"])),
        lambda x: x["part"],
    )
    fallback = F.when(reading_like(writing, compatibility), F.array(strip(writing))).otherwise(
        F.array().cast("array<string>")
    )
    return non_empty(F.when(F.size(kept) > 0, kept).otherwise(fallback))


def normalize_joined(items, compatibility: bool = True) -> Column:
    """Match keys of a whole list, joined by U+0001, with one NFKC call."""
    joined = F.array_join(items, "\u0001")
    if compatibility:
        joined = nfkc(joined)
    return to_hiragana(F.regexp_replace(joined, r"(?U)\s+", ""))


# -- gloss keys ---------------------------------------------------------------------

def gloss_key(c) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


def strip_parentheses(c) -> Column:
    return strip(F.regexp_replace(as_col(c), r"(?U)\s*\([^)]*\)", ""))


def definition_key(c) -> Column:
    """Dictionary definition reduced to its lookup key.

    ``sb`` and ``sth`` are expanded inside words as well.
    """
    text = strip_parentheses(c)
    text = F.replace(F.replace(text, F.lit("sb"), F.lit("somebody")), F.lit("sth"), F.lit("something"))
    text = F.regexp_replace(text, r"(?i)\b(fig|lit)\.\s*", "")
    text = F.regexp_replace(text, r"\bCL:.*", "")
    return gloss_key(strip_chars(text, " .;:,"))


def useful_candidate(c) -> Column:
    c = as_col(c)
    denied = "[" + "".join(fixed.REVERSE_DENIED_CHARACTERS) + "]"
    return (F.length(c) >= 2) & c.rlike("^[一-鿿·]+$") & ~c.rlike(denied)


def translation_items(c, limit: int = fixed.MAX_TRANSLATIONS) -> Column:
    """Translations of one record (string or array of strings) as a tidy list."""
    text = as_col(c)
    parts = F.flatten(F.transform(text, lambda x: F.split(x, r"(?U)\s*[;；]\s*|\n+")))

    def tidy(part):
        part = F.regexp_replace(collapse(part), r"^\d+[.)、]\s*", "")
        return strip_chars(part, " 。.;；")

    kept = F.filter(
        F.transform(parts, tidy),
        lambda x: (x != "") & ~F.lower(x).isin("n/a", "none", "null"),
    )
    return F.slice(F.array_distinct(kept), 1, limit)


def compact_translation(c) -> Column:
    text = strip_chars(collapse(c), "。.;； ")
    text = F.replace(text, F.lit("；"), F.lit("、"))
    return F.when(text == "", F.lit(fixed.UNTRANSLATED)).otherwise(text)


def cleanup_machine_text(c) -> Column:
    text = F.replace(as_col(c), F.lit("；；"), F.lit("；"))
    text = collapse(text)
    for mark, wide in ((",", "，"), (":", "："), (";", "；")):
        text = F.replace(F.replace(text, F.lit(f" {mark}"), F.lit(wide)), F.lit(f"{mark} "), F.lit(wide))
    return text


def latin_tokens(c) -> Column:
    found = F.regexp_extract_all(as_col(c), F.lit("[A-Za-z][A-Za-z-]*(?:'[A-Za-z]+)?"), F.lit(0))
    return F.filter(found, lambda t: ~F.lower(t).isin(fixed.LATIN_TOKENS_IGNORED))


def adjust_for_pos(c, major) -> Column:
    """Give short adjective translations their attributive ending."""
    text = as_col(c)
    pieces = F.regexp_extract_all(text, F.lit("[^；、]+|[；、]"), F.lit(0))

    def adjust(piece):
        value = strip(piece)
        keep = (
            piece.isin("；", "、")
            | (value == "")
            | value.startswith(fixed.UNTRANSLATED)
            | value.startswith(fixed.PROPER_PREFIX.rstrip("："))
        )
        short = (F.length(value) <= 8) & ~value.rlike("[：/]")
        return (
            F.when(keep, piece)
            .when(value.rlike(fixed.ADJECTIVE_ENDINGS_KEPT), value)
            .when(short, F.concat(value, F.lit("的")))
            .otherwise(value)
        )

    adjective = as_col(major).isin(fixed.I_ADJ, fixed.NA_ADJ)
    return F.when(adjective, F.array_join(F.transform(pieces, adjust), "")).otherwise(text)


def distance_from_ideal(c) -> Column:
    return F.abs(F.length(as_col(c)) - fixed.IDEAL_LENGTH)


def part_labels(c, compatibility: bool = True) -> Column:
    text = F.coalesce(as_col(c), F.lit(""))
    if compatibility:
        text = nfkc(text)
    return F.filter(F.split(F.lower(text), "[；;]"), lambda x: x != "")
