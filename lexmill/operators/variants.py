"""Character-variant forms of kanji strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill import fixed
from lexmill.functions import text as tx
from lexmill.operators.common import ordered_list


def combinations(choices: Column) -> Column:
    """Number of strings from one choice per position; it stops at 10**15."""
    return F.aggregate(choices, F.lit(1).cast("bigint"), lambda n, c: F.least(n * F.size(c), F.lit(10**15).cast("bigint")))


def combine_choices(choices: Column, limit: int | None = fixed.VARIANT_COMBINATIONS) -> Column:
    """All strings from one choice per position, while they number at most ``limit``.

    Beyond it: the string of first alternatives, then every string with one
    position changed. Without a limit: all strings, whatever their number.
    """
    every = F.aggregate(
        choices,
        F.array(F.lit("")),
        lambda done, c: F.flatten(F.transform(done, lambda d: F.transform(c, lambda x: F.concat(d, x)))),
    )
    own = F.transform(choices, lambda c: F.get(c, 0))
    first = F.array_join(F.transform(choices, lambda c: F.coalesce(F.get(c, 1), F.get(c, 0))), "")
    single = F.flatten(
        F.transform(
            choices,
            lambda c, i: F.transform(
                F.slice(c, F.lit(2), F.size(c)),
                lambda x: F.array_join(F.transform(own, lambda o, j: F.when(i == j, x).otherwise(o)), ""),
            ),
        )
    )
    if limit is None:
        return every
    return F.when(combinations(choices) <= limit, every).otherwise(F.array_distinct(F.concat(F.array(first), single)))


def variant_choices(strings: DataFrame, column: str, variants: DataFrame) -> DataFrame:
    """(column, choices) for every distinct string: each position's character and its variants.

    Characters are looked up by an equality join, so the variant table may be
    of any size; the group per string is bounded by its length.
    """
    distinct = strings.select(F.col(column)).distinct()
    chars = distinct.select(column, F.posexplode(tx.characters(column)).alias("pos", "kanji"))
    table = variants.groupBy("kanji").agg(ordered_list(F.col("ord"), F.col("variant")).alias("alts"))
    choices = chars.join(table, "kanji", "left").select(
        column, "pos", F.concat(F.array("kanji"), F.coalesce("alts", F.array().cast("array<string>"))).alias("choice")
    )
    rows = choices.groupBy(column).agg(ordered_list(F.col("pos"), F.col("choice")).alias("choices"))
    return rows


def variant_forms(strings: DataFrame, column: str, variants: DataFrame, limit: int | None = fixed.VARIANT_COMBINATIONS) -> DataFrame:
    """(column, forms, whole) for every distinct string; ``whole`` is false where the limit cut the combinations."""
    choices = F.col("choices")
    whole = combinations(choices) <= limit if limit is not None else F.lit(True)
    return variant_choices(strings, column, variants).select(column, combine_choices(choices, limit).alias("forms"), whole.alias("whole"))


def variant_rows(strings: DataFrame, column: str, variants: DataFrame) -> DataFrame:
    """(column, form): every combination as a row of its own; the number of a row spells its choices."""
    numbered = variant_choices(strings, column, variants).select(column, "choices", F.explode(F.sequence(F.lit(0).cast("bigint"), combinations(F.col("choices")) - 1)).alias("_i"))
    sizes = F.transform("choices", F.size)
    stride = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(1).cast("bigint"), lambda n, s: n * s)
    form = F.array_join(F.transform("choices", lambda c, i: F.get(c, (F.floor(F.col("_i") / stride(i)) % F.size(c)).cast("int"))), "")
    return numbered.select(column, form.alias("form"))


def run_variants(texts: DataFrame, id_col: str, text_col: str, variants: DataFrame, limit: int | None = fixed.VARIANT_COMBINATIONS) -> DataFrame:
    """(id, extra): variant forms of every kanji run of a text, the run excepted."""
    runs = texts.select(id_col, F.posexplode(tx.kanji_runs(text_col)).alias("run_ord", "run"))
    forms = variant_forms(runs, "run", variants, limit)
    joined = runs.join(forms, "run").select(
        id_col, "run_ord", F.filter("forms", lambda f: f != F.col("run")).alias("forms")
    )
    return joined.groupBy(id_col).agg(
        F.array_distinct(F.flatten(ordered_list(F.col("run_ord"), F.col("forms")))).alias("extra")
    )


def with_indexed_text(texts: DataFrame, id_col: str, text_col: str, variants: DataFrame | None, limit: int | None = fixed.VARIANT_COMBINATIONS) -> DataFrame:
    """Append the variant forms of a text's kanji runs to the text."""
    if variants is None:
        return texts
    extra = run_variants(texts, id_col, text_col, variants, limit)
    joined = texts.join(extra, id_col, "left")
    return joined.withColumn(text_col, F.concat_ws(" ", text_col, F.nullif(F.array_join("extra", " "), F.lit("")))).drop("extra")
