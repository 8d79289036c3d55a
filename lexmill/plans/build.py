"""Source files to the graded lexicon and its outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill import fixed
from lexmill.operators import lexicon as lx
from lexmill.operators.frequency import frequency_keys
from lexmill.sources import readers, sinks


def policy_rows(spark: SparkSession, extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    rows = {
        "jmdict_source_url": ("", fixed.ENTRY_SOURCE_URL),
        "kanjidic2_source_url": ("", fixed.KANJI_SOURCE_URL),
        "bccwj_source_url": ("", fixed.FREQ_SOURCE_URL),
        **(extra or {}),
    }
    return spark.createDataFrame([(k, a, n) for k, (a, n) in rows.items()], "item string, amount string, note string")


def loaded_counts(item: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").cast("string").alias("amount")).select(F.lit(item).alias("item"), "amount", F.lit("").alias("note"))


def build_lexicon(spark: SparkSession, dictionary: str, out: str, kanji: str | None = None, frequency: str | None = None,
                  overrides: str | None = None, levels: str | None = None, compat: bool = True, max_rank: int | None = fixed.FREQ_MAX_RANK) -> dict[str, DataFrame]:
    """Read, classify, enrich and write the lexicon.

    The classified entries are stored once as Parquet under ``out``; every
    further table reads that copy instead of running the classification again,
    and a lost executor never sends the job back to the source files.
    """
    freq = frequency_keys(readers.read_frequency(spark, frequency, max_rank)) if frequency else None
    classified = lx.classify_entries(readers.read_dictionary(spark, dictionary), freq, compat)
    sinks.write_parquet(classified, f"{out}/tables/classified")
    stored = spark.read.parquet(f"{out}/tables/classified")

    over = readers.read_overrides(spark, overrides) if overrides else None
    refs = readers.read_levels(spark, levels) if levels else None
    core = lx.accepted(stored)
    enriched = lx.enrich(core, lx.pair_candidates(core), over, refs).withColumns(
        {
            "source": F.lit(fixed.ENTRY_SOURCE), "source_url": F.lit(fixed.ENTRY_SOURCE_URL),
            "review": F.lit(fixed.REVIEW_STATUS),
        }
    )
    sinks.write_parquet(enriched, f"{out}/tables/lexicon", ["major"])
    lexicon = spark.read.parquet(f"{out}/tables/lexicon")

    facts = readers.read_kanji(spark, kanji) if kanji else None
    tree, clusters = lx.kanji_tree(lexicon, facts), lx.cluster_summary(lexicon)
    audit = lx.audit(stored, policy_rows(spark, {"frequency_max_rank": (str(max_rank if max_rank is not None else "all"), "")}))
    for item, df in (
        ("kanjidic2_characters_loaded", facts), ("bccwj_keys_loaded", freq),
        ("translation_overrides_loaded", over), ("jlpt_levels_loaded", refs),
    ):
        if df is not None:
            audit = audit.unionByName(loaded_counts(item, df))
    sinks.write_lexicon(lexicon, tree, clusters, audit, out)
    sinks.write_json(lx.build_counters(stored), f"{out}/build_summary")
    return {"lexicon": lexicon, "classified": stored, "tree": tree, "clusters": clusters, "audit": audit}


def ordered_lexicon(lexicon: DataFrame) -> DataFrame:
    """Add ``source_ord``, a sort key equal to the master order."""
    reading = F.when(F.coalesce("reading", F.lit("")) == "", F.col("headword")).otherwise(F.col("reading"))
    key = F.struct("major", "level", reading.alias("reading"), "headword", "doc_pos", "entry_id")
    return lexicon.withColumn("source_ord", key)
