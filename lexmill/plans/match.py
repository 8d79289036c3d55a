"""Level lists and example sentences matched to a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill import fixed
from lexmill.operators import examples as ex
from lexmill.operators import levels as lv
from lexmill.sources import readers, sinks


def match_levels(lexicon: DataFrame, lists: DataFrame, meanings: DataFrame | None = None,
                 compatibility: bool = True) -> dict[str, DataFrame]:
    """Candidates, matches, ambiguous, unmatched, preview and counts.

    The three reports are filters over one decided table, so together they
    hold every candidate exactly once.
    """
    candidates = lv.dedupe_candidates(lv.with_keys(lv.expand_candidates(lists, meanings, compatibility), compatibility))
    keys = lv.entry_keys(lexicon, compatibility)
    decided = lv.decide_matches(candidates, keys).withColumns(
        {"source": F.lit(fixed.LEVEL_SOURCE), "note": F.lit(fixed.CANDIDATE_NOTE)}
    )
    words = lexicon.select(
        "entry_id", F.col("headword").alias("entry_word"), F.col("reading").alias("entry_reading"),
        F.col("level").alias("entry_level"), "major", "glosses",
    )
    matched = lv.matched_entries(decided, keys)
    report = matched.join(words, "entry_id")
    best = lv.best_levels(matched)
    preview = lexicon.select("entry_id", "headword", "reading", "level").join(best, "entry_id")
    return {
        "candidates": decided.orderBy(lv.level_rank("level"), "reading_key", "writing_key"),
        "decided": decided,
        "matches": report.where(F.col("confidence") != "ambiguous"),
        "ambiguous": report.where(F.col("confidence") == "ambiguous"),
        "unmatched": decided.where(F.col("confidence") == "none"),
        "preview": preview,
        "level_counts": lv.level_counts(decided),
        "outcome_counts": lv.outcome_counts(decided),
    }


def match_example_files(spark: SparkSession, lexicon: DataFrame, sentences: str, translations: str, links: str,
                        out: str, levels: tuple[str, ...] = ("A",), per_entry: int = fixed.EXAMPLES_PER_ENTRY) -> DataFrame:
    pairs = ex.linked_sentences(
        readers.read_sentences(spark, sentences), readers.read_sentences(spark, translations), readers.read_links(spark, links)
    )
    sinks.write_parquet(pairs, f"{out}/tables/sentence_pairs")
    stored = spark.read.parquet(f"{out}/tables/sentence_pairs")
    found = ex.match_examples(stored, ex.entry_terms(lexicon, list(levels)), per_entry)
    sinks.write_parquet(found, f"{out}/tables/examples")
    result = spark.read.parquet(f"{out}/tables/examples")
    sinks.write_examples(result, out)
    sinks.write_json(ex.example_totals(result), f"{out}/examples_summary")
    return result
