"""Dictionary entries to graded lexicon rows, with every rejection accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill import fixed
from lexmill.functions import classify as cl
from lexmill.functions.text import kanji_characters, non_empty
from lexmill.operators.common import first_n, ordered_list
from lexmill.operators.frequency import join_frequency


def describe_entries(dictionary: DataFrame) -> DataFrame:
    """Narrow, join-free description of each entry.

    Senses are reduced to label and gloss lists before any shuffle.
    """
    writings = F.transform("written", lambda w: w["text"])
    readings = F.transform("spoken", lambda r: r["text"])
    tags = F.flatten(F.concat(F.transform("written", lambda w: w["tags"]), F.transform("spoken", lambda r: r["tags"])))
    base = dictionary.select(
        "doc_pos",
        F.col("ent_seq").alias("entry_id"),
        cl.choose_headword("written", readings).alias("headword"),
        writings.alias("writings"),
        readings.alias("readings"),
        non_empty(tags).alias("tags"),
        cl.usable_senses("senses").alias("usable"),
    )
    return base.select(
        "doc_pos", "entry_id", "headword",
        F.coalesce(F.get("readings", F.lit(0)), F.lit("")).alias("reading"),
        "writings", "readings", "tags",
        cl.sense_labels(F.col("usable"), "pos").alias("pos"),
        cl.sense_labels(F.col("usable"), "misc").alias("misc"),
        cl.sense_labels(F.col("usable"), "field").alias("fields"),
        cl.sense_glosses(F.col("usable")).alias("glosses"),
    )


def classify_entries(dictionary: DataFrame, keyed_frequency: DataFrame | None, compat: bool = True) -> DataFrame:
    """All entries, graded and classified; ``reject_reason`` is NULL if accepted."""
    described = describe_entries(dictionary)
    if keyed_frequency is None:
        null = F.lit(None)
        joined = described.select(
            "*", null.cast("int").alias("freq_rank"), *[null.cast("string").alias(c) for c in ("freq_count", "freq_pmw", "freq_pos")]
        )
    else:
        joined = join_frequency(described, keyed_frequency)
    graded = joined.withColumns(
        {
            "evidence_level": cl.priority_level("tags"),
            "freq_level": cl.frequency_level("freq_rank"),
            "major": cl.major_class("pos"),
        }
    ).withColumn("level", F.coalesce("evidence_level", "freq_level"))
    is_verb = F.col("major") == fixed.VERB
    return (
        graded.withColumns(
            {
                "transitivity": F.when(is_verb, cl.transitivity("pos", compat)),
                "conjugation": F.when(is_verb, cl.conjugation("pos")),
                "kanji": kanji_characters("headword"),
                "reject_reason": cl.reject_reason(
                    "pos", "fields", "major", "evidence_level", "freq_level", "level", "freq_pos"
                ),
            }
        )
        .withColumn("cluster", cl.cluster("headword", "reading", "major", "conjugation"))
    )


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reject_reason").isNull()).drop("reject_reason")


def pair_candidates(lexicon: DataFrame, rewrites=fixed.PAIR_REWRITES, verb: str = fixed.VERB, limit: int = 5) -> DataFrame:
    """(entry_id, related): up to five verbs of the other transitivity.

    A verb's reading is rewritten by every suffix rule that fits and joined to
    the verbs with that reading. Only the first five distinct labels of each
    (reading, transitivity) can ever be used, so they are cut to five before
    the join and no reading shared by many verbs multiplies.
    """
    verbs = lexicon.where((F.col("major") == verb) & (F.coalesce("reading", F.lit("")) != "")).select(
        "entry_id", "doc_pos", "headword", "reading", F.coalesce("transitivity", F.lit("")).alias("transitivity")
    )
    label = F.concat("headword", F.lit("（"), "reading", F.lit("）"))
    targets = (
        verbs.where(F.col("transitivity") != "")
        .groupBy("reading", "transitivity", label.alias("label"))
        .agg(F.min(F.struct("doc_pos", "entry_id")).alias("pos"))
    )
    targets = first_n(targets, ["reading", "transitivity"], ["pos"], limit).select(
        F.col("reading").alias("target"), F.col("transitivity").alias("other"), "label", "pos"
    )
    rules = F.array(
        *[
            F.when(
                F.col("reading").endswith(src),
                F.struct(
                    F.lit(i).alias("rule"),
                    F.concat(
                        F.substring("reading", F.lit(1), F.length("reading") - len(src)), F.lit(dst)
                    ).alias("target"),
                ),
            )
            for i, (src, dst) in enumerate(rewrites)
        ]
    )
    probes = verbs.select(
        "entry_id", "transitivity", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")
    ).select("entry_id", "transitivity", "r.rule", "r.target")
    hits = probes.join(targets, "target").where(F.col("other") != F.col("transitivity"))
    return hits.groupBy("entry_id").agg(
        F.slice(
            F.array_distinct(ordered_list(F.struct("rule", "pos"), F.col("label"))), 1, limit
        ).alias("related")
    )


def enrich(lexicon: DataFrame, pairs: DataFrame | None = None, overrides: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """Left joins on the entry id: related verbs, translation, reference level."""
    out = lexicon
    if pairs is not None:
        out = out.join(pairs, "entry_id", "left")
    if overrides is not None:
        out = out.join(overrides.select("entry_id", "translation", "translation_source"), "entry_id", "left")
    if levels is not None:
        out = out.join(levels.select("entry_id", "ref_level", "ref_source", "ref_confidence", "ref_note"), "entry_id", "left")
    return out


def kanji_tree(lexicon: DataFrame, kanji: DataFrame | None, noun: str = fixed.NOUN) -> DataFrame:
    """One row per noun and kanji: the first kanji is the main node."""
    sort_reading = F.when(F.coalesce("reading", F.lit("")) == "", F.col("headword")).otherwise(F.col("reading"))
    rows = lexicon.where((F.col("major") == noun) & (F.size("kanji") > 0)).select(
        "entry_id", "doc_pos", "major", "level", F.col("headword").alias("word"), "reading",
        sort_reading.alias("sort_reading"),
        F.posexplode("kanji").alias("ord", "kanji"),
    )
    if kanji is None:
        rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("status", "on_readings", "kun_readings")])
    else:
        rows = rows.join(kanji.select("kanji", "status", "on_readings", "kun_readings"), "kanji", "left")
    known = F.coalesce(
        F.nullif("on_readings", F.lit("")), F.nullif("kun_readings", F.lit("")), F.lit(fixed.READING_UNKNOWN)
    )
    return rows.withColumns(
        {
            "path": F.concat_ws(" > ", "kanji", known, "word"),
            "relation": F.when(F.col("ord") == 0, fixed.MAIN_NODE).otherwise(fixed.CONTAINED_NODE),
            "source": F.lit(fixed.ENTRY_SOURCE if kanji is None else fixed.TREE_SOURCE_WITH_KANJI),
        }
    )


def cluster_summary(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("major", "cluster").agg(F.count("*").alias("entries"))


def build_counters(classified: DataFrame) -> DataFrame:
    """Accept and reject counters as (item, amount), from one pass.

    Each entry turns into the few counters it feeds; the sums combine on the
    map side.
    """
    ok = F.col("reject_reason").isNull()
    rank_only = F.col("evidence_level").isNull() & F.col("freq_level").isNotNull()
    items = F.array(
        F.lit("jmdict_entries_seen"),
        F.concat(F.lit("rejected_"), "reject_reason"),
        F.when(ok, F.lit("accepted_total")),
        F.when(ok, F.concat(F.lit("accepted_"), "major")),
        F.when(ok, F.concat(F.lit("accepted_level_"), "level")),
        F.when(ok & F.col("freq_rank").isNotNull(), F.lit("accepted_with_bccwj_match")),
        F.when(ok & rank_only, F.lit("accepted_by_bccwj_rank_only")),
    )
    return (
        classified.select(F.explode(F.filter(items, lambda x: x.isNotNull())).alias("item"))
        .groupBy("item")
        .agg(F.count("*").alias("amount"))
    )


def rejected_samples(classified: DataFrame, limit: int = 100) -> DataFrame:
    """First entries without evidence, in document order, as JSON notes."""
    sample = classified.where(F.col("reject_reason") == "no_abc_evidence").orderBy("doc_pos", "entry_id").limit(limit)
    return sample.select(
        "doc_pos", "entry_id",
        F.to_json(
            F.struct(
                F.col("entry_id").alias("ent_seq"),
                "headword",
                F.lit("no_A_B_C_priority_or_bccwj_evidence").alias("reason"),
                F.array_join("tags", ";").alias("priority_tags"),
                F.coalesce(F.col("freq_rank").cast("string"), F.lit("")).alias("bccwj_rank"),
            )
        ).alias("note"),
    )


def audit(classified: DataFrame, policies: DataFrame) -> DataFrame:
    """Counters, samples and policy rows as one (item, amount, note) table."""
    counters = build_counters(classified).select("item", F.col("amount").cast("string"), F.lit("").alias("note"))
    samples = rejected_samples(classified).select(F.lit("rejected_sample").alias("item"), F.lit("").alias("amount"), "note")
    return counters.unionByName(samples).unionByName(policies)


def quality_checks(lexicon: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(check, bad): counts that must be zero, and class sizes that must add up."""
    sizes = lexicon.agg(
        F.count("*").alias("rows"),
        F.sum(F.when(F.col("major").isin(fixed.VERB, fixed.I_ADJ, fixed.NA_ADJ, fixed.NOUN), 1).otherwise(0)).alias("classed"),
    ).select(F.lit("unclassified_rows").alias("check"), (F.col("rows") - F.coalesce("classed", F.lit(0))).alias("bad"))
    repeated = (
        lexicon.groupBy("entry_id").count().where("count > 1")
        .agg(F.count("*").alias("bad")).select(F.lit("repeated_ids").alias("check"), "bad")
    )
    out = sizes.unionByName(repeated)
    if overrides is not None:
        orphans = overrides.join(lexicon, "entry_id", "left_anti").agg(F.count("*").alias("bad"))
        out = out.unionByName(orphans.select(F.lit("orphan_overrides").alias("check"), "bad"))
    return out
