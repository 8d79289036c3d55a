"""Frequency evidence: one best record per key, and its join to entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.functions.text import has_kanji, non_empty, to_hiragana

RECORD = ["rank", "lemma", "form", "freq_pos", "freq_count", "freq_pmw"]


def frequency_keys(freq: DataFrame) -> DataFrame:
    """One row per key (lemma, form, hiragana form) with its lowest rank.

    The first record in file order wins a tie. Combined on the map side, so a
    key shared by many records costs one row per task.
    """
    keys = non_empty(F.array("lemma", "form", to_hiragana("form")))
    exploded = freq.select(F.explode(keys).alias("key"), *RECORD, "line_ord")
    return (
        exploded.groupBy("key")
        .agg(F.min_by(F.struct(*RECORD), F.struct("rank", "line_ord")).alias("r"))
        .select("key", "r.*")
    )


def all_frequency_records(freq: DataFrame) -> DataFrame:
    """Every record per key, for joins that test the reading before picking."""
    keys = non_empty(F.array("lemma", "form", to_hiragana("form")))
    return freq.select(F.explode(keys).alias("key"), *RECORD)


def join_frequency(entries: DataFrame, keyed: DataFrame) -> DataFrame:
    """Add the best frequency record to every entry (NULLs when none).

    ``entries`` has entry_id, headword, writings, readings. An entry written
    with kanji is looked up by its writings and the record's reading must be
    one of its own; any other entry is looked up by its readings too. Pass
    ``frequency_keys`` for the published behaviour (a key is reduced to its
    best record before the reading test) or ``all_frequency_records`` to test
    first.
    """
    written = has_kanji("headword") | F.exists("writings", has_kanji)
    own = F.concat(F.array("headword"), "writings")
    wide = F.concat(own, "readings", F.transform("readings", to_hiragana))
    probes = entries.select(
        "entry_id",
        written.alias("written"),
        "readings",
        F.posexplode(non_empty(F.when(written, own).otherwise(wide))).alias("ord", "key"),
    )
    hits = probes.join(keyed, "key").where(
        ~F.col("written") | (F.size("readings") == 0) | F.array_contains("readings", to_hiragana("form"))
    )
    best = hits.groupBy("entry_id").agg(F.min_by(F.struct(*RECORD), F.struct("rank", "ord", "lemma", "form")).alias("f"))
    return entries.join(best, "entry_id", "left").select(
        *entries.columns,
        F.col("f.rank").alias("freq_rank"),
        F.col("f.freq_count").alias("freq_count"),
        F.col("f.freq_pmw").alias("freq_pmw"),
        F.col("f.freq_pos").alias("freq_pos"),
    )
