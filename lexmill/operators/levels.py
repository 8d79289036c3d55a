"""Reference levels: candidate lists matched to entries in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill import fixed
from lexmill.functions.text import kana_only, non_empty, normalize_joined, reading_variants, strip, writing_variants
from lexmill.functions import text as tx
from lexmill.operators.common import ordered_list


def level_rank(level: Column | str, order=fixed.LEVEL_ORDER) -> Column:
    table = tx.literal_map(order)
    return F.try_element_at(table, tx.as_col(level))


def expand_candidates(lists: DataFrame, meanings: DataFrame | None = None, compatibility: bool = True) -> DataFrame:
    """List rows (level, q, a, source_file, source_url, line_ord) to candidates.

    Every writing variant is paired with every reading variant. Meanings join
    by level and normalised writing; the first meaning in file order counts.
    """
    rows = lists.withColumn("raw", strip("q")).where(F.col("raw") != "")
    rows = rows.withColumn("meaning_key", tx.normalize_japanese("raw", compatibility))
    if meanings is None:
        rows = rows.withColumn("meaning", F.lit(""))
    else:
        keyed = meanings.withColumn("meaning_key", tx.normalize_japanese("q", compatibility))
        first = keyed.groupBy("level", "meaning_key").agg(F.min_by("a", "line_ord").alias("meaning"))
        rows = rows.join(first, ["level", "meaning_key"], "left").withColumn("meaning", F.coalesce("meaning", F.lit("")))
    written = rows.select(
        "level", "a", "meaning", "source_file", "source_url", "line_ord",
        F.posexplode(writing_variants("raw")).alias("writing_ord", "writing"),
    )
    spoken = written.select(
        "*", F.posexplode(reading_variants("a", "writing", compatibility)).alias("reading_ord", "reading")
    )
    return spoken.select(
        "level", "writing", "reading", "meaning", "source_file", "source_url",
        F.struct(level_rank("level").alias("level"), "line_ord", "writing_ord", "reading_ord").alias("ord"),
    )


def with_keys(candidates: DataFrame, compatibility: bool = True) -> DataFrame:
    return candidates.withColumns(
        {
            "writing_key": tx.normalize_japanese("writing", compatibility),
            "reading_key": tx.normalize_japanese("reading", compatibility),
        }
    )


def dedupe_candidates(candidates: DataFrame, source_page: str = fixed.LEVEL_SOURCE_PAGE, order=fixed.LEVEL_ORDER) -> DataFrame:
    """One candidate per (writing key, reading key): easiest level, first on ties.

    A key listed at several levels carries all its source files and the
    general source page. Source files are reduced to one row each before they
    are gathered, so the list is bounded by the number of files.
    """
    keys = ["writing_key", "reading_key"]
    per_file = candidates.groupBy(*keys, "source_file", "level").agg(
        F.min(F.struct(level_rank("level", order).alias("level"), "ord")).alias("first"),
        F.min_by(F.struct("level", "writing", "reading", "meaning", "source_url"),
                 F.struct(level_rank("level", order).alias("level"), "ord")).alias("best"),
        F.min("ord").alias("seen"),
    )
    merged = per_file.groupBy(*keys).agg(
        F.min_by(F.struct("best.*", "source_file"), "first").alias("c"),
        F.count_distinct("level").alias("levels"),
        F.array_distinct(ordered_list(F.col("seen"), F.col("source_file"))).alias("files"),
    )
    several = F.col("levels") > 1
    return merged.select(
        *keys, "c.level", "c.writing", "c.reading", "c.meaning",
        F.when(several, F.array_join("files", ";")).otherwise(F.col("c.source_file")).alias("source_file"),
        F.when(several, source_page).otherwise(F.col("c.source_url")).alias("source_url"),
    )


def entry_keys(lexicon: DataFrame, compatibility: bool = True) -> DataFrame:
    """(kind, k1, k2, entry_id): pair, writing and reading keys of every entry."""
    keys = lambda own, more: F.split(
        normalize_joined(non_empty(F.concat(F.array(F.coalesce(own, F.lit(""))), more)), compatibility), "\u0001"
    )
    base = lexicon.select(
        "entry_id",
        keys("headword", F.col("writings")).alias("w"),
        keys("reading", F.col("readings")).alias("r"),
    ).select("entry_id", non_empty(F.col("w")).alias("w"), non_empty(F.col("r")).alias("r"))
    key = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("k1"), b.alias("k2"))
    none = F.lit("")
    exploded = F.concat(
        F.flatten(F.transform("w", lambda w: F.transform("r", lambda r: key("pair", w, r)))),
        F.transform("w", lambda w: key("writing", w, none)),
        F.transform("r", lambda r: key("reading", r, none)),
    )
    return base.select("entry_id", F.explode(exploded).alias("k")).select("k.*", "entry_id")


def decide_matches(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """Rule, confidence and chosen key of every candidate.

    Entries per key are counted first, so a candidate meets at most three
    counts and never the entries behind them; a key shared by a third of all
    entries is one row here. Candidates are identified by their key pair.
    """
    counts = keys.groupBy("kind", "k1", "k2").agg(F.count("*").alias("hits"))
    none = F.lit("")
    probe = lambda tier, kind, a, b: F.struct(
        F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), a.alias("k1"), b.alias("k2")
    )
    w, r = F.col("writing_key"), F.col("reading_key")
    probes = candidates.select(
        "writing_key", "reading_key",
        F.explode(
            F.filter(
                F.array(
                    probe(1, "pair", w, r),
                    F.when(kana_only(w), probe(2, "reading", r, none)),
                    probe(3, "writing", w, none),
                ),
                lambda p: p.isNotNull(),
            )
        ).alias("p"),
    ).select("writing_key", "reading_key", "p.*")
    found = probes.join(counts, ["kind", "k1", "k2"])
    best = found.groupBy("writing_key", "reading_key").agg(
        F.min(F.struct("tier", "kind", "k1", "k2", "hits")).alias("b")
    )
    out = candidates.join(best, ["writing_key", "reading_key"], "left")
    tier, one = F.col("b.tier"), F.col("b.hits") == 1
    rules = fixed.MATCH_RULES
    rule = (
        F.when(tier == 1, rules["pair"])
        .when((tier == 2) & one, rules["reading_one"])
        .when(tier == 2, rules["reading_many"])
        .when((tier == 3) & one, rules["writing_one"])
        .when(tier == 3, rules["writing_many"])
        .otherwise(rules["none"])
    )
    confidence = (
        F.when(tier.isNull(), "none")
        .when(~one, "ambiguous")
        .when(tier == 1, "high")
        .when(tier == 2, "medium")
        .otherwise("low")
    )
    return out.select(
        *candidates.columns, rule.alias("rule"), confidence.alias("confidence"),
        F.col("b.kind").alias("kind"), F.col("b.k1").alias("k1"), F.col("b.k2").alias("k2"),
        F.coalesce("b.hits", F.lit(0)).alias("hits"),
    )


def matched_entries(decided: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per matched (candidate, entry), the report rows."""
    return decided.where(F.col("confidence") != "none").join(keys, ["kind", "k1", "k2"])


def best_levels(matched: DataFrame, order=fixed.LEVEL_ORDER) -> DataFrame:
    """Easiest level per entry from high and medium matches."""
    sure = matched.where(F.col("confidence").isin("high", "medium"))
    best = F.min(F.struct(level_rank("level", order).alias("o"), "confidence", "level"))
    return sure.groupBy("entry_id").agg(best.alias("b")).select(
        "entry_id", F.col("b.level").alias("ref_level"), F.col("b.confidence").alias("ref_confidence"),
        F.lit(fixed.LEVEL_SOURCE).alias("ref_source"), F.lit(fixed.LEVEL_NOTE).alias("ref_note"),
    )


def level_counts(decided: DataFrame) -> DataFrame:
    sure, settled = F.col("confidence").isin("high", "medium"), F.col("confidence").isin("high", "medium", "low")
    return decided.groupBy("level").agg(
        F.count("*").alias("candidates"),
        F.count_if(settled).alias("matched"),
        F.count_if(sure).alias("matched_high_medium"),
    )


def outcome_counts(decided: DataFrame) -> DataFrame:
    """Candidates by confidence and by rule, as (measure, value, n)."""
    pairs = F.array(
        F.struct(F.lit("confidence").alias("measure"), F.col("confidence").alias("value")),
        F.struct(F.lit("rule").alias("measure"), F.col("rule").alias("value")),
    )
    return (
        decided.select(F.explode(pairs).alias("x")).select("x.*")
        .groupBy("measure", "value").agg(F.count("*").alias("n"))
    )
