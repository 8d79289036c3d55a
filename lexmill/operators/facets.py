"""Facet counts, category tree and the typed export of a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill import fixed
from lexmill.functions.text import clean, maybe_float, maybe_int


def facet_counts(lexicon: DataFrame, facets: list[str], keep_blank: tuple[str, ...] = ("major", "level")) -> DataFrame:
    """(facet, value, n) for several facets from one scan.

    Rows are unpivoted to (facet, value) and counted with map-side combine, so
    the data is read once whatever the number of facets.
    """
    pairs = F.array(
        *[
            F.when(
                F.lit(c in keep_blank) | (F.coalesce(F.col(c).cast("string"), F.lit("")) != ""),
                F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")),
            )
            for c in facets
        ]
    )
    return (
        lexicon.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p"))
        .select("p.*").groupBy("facet", "value").agg(F.count("*").alias("n"))
    )


def category_tree(lexicon: DataFrame) -> DataFrame:
    """(major, major_n, cluster, n): classes by size with their clusters by size."""
    clusters = lexicon.groupBy("major", "cluster").agg(F.count("*").alias("n"))
    majors = clusters.groupBy("major").agg(F.sum("n").alias("major_n"))
    return clusters.where(F.coalesce("cluster", F.lit("")) != "").join(majors, "major").select("major", "major_n", "cluster", "n")


def export_entries(lexicon: DataFrame) -> DataFrame:
    """Lexicon rows as exported: typed numbers, arrays, published field names."""
    text = lambda c: clean(c)
    arrays = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    have = set(lexicon.columns)
    col = lambda c: F.col(c) if c in have else F.lit("")
    return lexicon.select(
        text("entry_id").alias("id"), text("level").alias("level"), text(col("ref_level")).alias("jlpt"),
        text(col("ref_source")).alias("jlptSource"), text(col("ref_confidence")).alias("jlptConfidence"),
        text(col("ref_note")).alias("jlptNote"), text("headword").alias("word"), text("reading").alias("reading"),
        text("major").alias("major"), F.array_join("pos", fixed.LIST_SEPARATOR).alias("subpos"),
        text("transitivity").alias("transitivity"), text("conjugation").alias("conjugation"),
        text("cluster").alias("cluster"),
        (F.coalesce(F.array_join("related", fixed.LIST_SEPARATOR), F.lit("")) if "related" in have else F.lit("")).alias("pair"),
        arrays("kanji").alias("kanji"), arrays("writings").alias("writings"), arrays("readings").alias("readings"),
        arrays("tags").alias("tags"), arrays("glosses").alias("gloss"),
        (F.split("translation", fixed.LIST_SEPARATOR) if "translation" in have else F.array().cast("array<string>")).alias("translation"),
        text(col("translation_source")).alias("translationSource"),
        maybe_int(F.col("freq_rank").cast("string")).alias("rank"),
        maybe_int(F.col("freq_count").cast("string")).alias("frequency"),
        maybe_float(F.col("freq_pmw").cast("string")).alias("pmw"),
        text("freq_pos").alias("bccwjPos"), F.lit(fixed.REVIEW_STATUS).alias("review"),
    )


def result_summary(entries: DataFrame, kanji: str = "kanji") -> DataFrame:
    """Rows, distinct classes and distinct kanji of a result."""
    base = entries.agg(
        F.count("*").alias("results"), F.count_distinct(F.nullif("major", F.lit(""))).alias("majors")
    )
    distinct = entries.select(F.explode(kanji).alias("k")).distinct().agg(F.count("*").alias("kanji"))
    return base.withColumn("kanji", distinct.select("kanji").scalar())
