"""Japanese order as plain columns: three keys that compare byte by byte.

The first key says which letters stand there (scripts of kana, voicing, size, accents and case
folded; a long mark is the vowel before it), the second which marks they bear, the third their
size and case. Katakana and hiragana are equal, kanji follow the order of JIS X 0208 and,
beyond it, code points. As plain strings the keys can be range-partitioned, stored and stated in any SQL.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, functions as F

from lexmill import fixed
from lexmill.functions.text import as_col

#: Order of marks and signs before the digits (fixed values).
SIGNS = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"
#: Order of the marks a letter may bear (fixed values): acute, grave, breve, circumflex, caron, ring, diaeresis, double acute,
#: tilde, dot above, stroke, cedilla, ogonek, macron, voiced, semi-voiced.
MARKS = "̸゙゚̧̨́̀̆̂̌̊̈̋̃̇̄"
SMALL, LARGE = "ぁぃぅぇぉっゃゅょゎゕゖ", "あいうえおつやゆよわかけ"
VOWELS = {"あ": "あかさたなはまやらわ", "い": "いきしちにひみりゐ", "う": "うくすつぬふむゆる", "え": "えけせてねへめれゑ", "お": "おこそとのほもよろを"}
MARK_BASE = 0xE000
BEYOND = chr(0xF8FF)
#: A sign of repetition and a long mark without a vowel come after the signs and before the digits.
REPEATED, LONG = "AB"


@functools.cache
def marked() -> dict[str, tuple[str, str]]:
    """Letter with one mark -> (its plain letter, its mark), from the canonical decompositions."""
    out = {"ø": ("o", "̸"), "Ø": ("O", "̸")}
    for code in (*range(0xC0, 0x250), *range(0x3041, 0x3097)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[1] in MARKS:
            out[chr(code)] = (parts[0], parts[1])
    return out


@functools.cache
def kanji_order() -> str:
    """Kanji of the two levels of JIS X 0208 in its order."""
    cells = (bytes((0xA0 + row, 0xA0 + cell)).decode("euc_jp", "ignore") for row in range(16, 85) for cell in range(1, 95))
    return "".join(c for c in cells if c)


@functools.cache
def letter_table() -> tuple[str, str]:
    """Characters and what they are in the first key, for one translation."""
    table: dict[str, str] = {}
    for i, c in enumerate(SIGNS):
        table[c] = chr(0x21 + i)
    for i, c in enumerate("0123456789"):
        table[c] = chr(0x43 + i)
    table["々"] = REPEATED
    for c, (plain, _) in marked().items():
        table[c] = plain.lower()
    for c in map(chr, range(0x41, 0x5B)):
        table[c] = c.lower()
    for small, large in zip(SMALL, LARGE, strict=True):
        table[small] = table.get(large, large)
    for i, c in enumerate(kanji_order()):
        table[c] = chr(MARK_BASE + i)
    return "".join(table), "".join(table.values())


def long_marks(text: Column) -> Column:
    """Each long mark as the vowel of the kana before it; one without a kana before it stays."""
    rows = {k: v for v, row in VOWELS.items() for k in row}
    before, vowel = "".join(rows), "".join(rows.values())

    def step(done: Column, c: Column) -> Column:
        last = F.translate(F.right(done, F.lit(1)), before, vowel)
        known = last.isin(list(VOWELS))
        return F.concat(done, F.when((c == "ー") & known, last).otherwise(c))

    spelt = F.aggregate(F.split(text, ""), F.lit(""), step)
    return F.when(F.contains(text, F.lit("ー")), spelt).otherwise(text)


def japanese_keys(c) -> list[Column]:
    """Three columns that order texts as a Japanese reader would; null is empty."""
    text = F.translate(F.coalesce(as_col(c), F.lit("")), fixed.KATAKANA_LETTERS, fixed.HIRAGANA_LETTERS)
    letters = long_marks(F.translate(text, *letter_table()))
    first = F.regexp_replace(F.translate(letters, "ー", LONG), "([㐀-鿿])", f"{BEYOND}$1")
    own = "".join(marked())
    classes = "".join(chr(MARK_BASE + MARKS.index(m)) for _, m in marked().values())
    span = f"\\x{{{MARK_BASE:x}}}-\\x{{{MARK_BASE + len(MARKS) - 1:x}}}"
    bare = F.regexp_replace(F.translate(F.regexp_replace(text, f"[{span}]", "a"), own, classes), f"[^{span}]", "a")
    second = F.regexp_replace(bare, f"([{span}])", "a$1")
    sized = F.regexp_replace(F.regexp_replace(text, f"[{SMALL}]", "1"), "ー", "0")
    third = F.regexp_replace(F.regexp_replace(sized, r"[\p{Lu}\x{3041}-\x{3096}]", "2"), r"[^012]", "1")
    return [first, second, third]
