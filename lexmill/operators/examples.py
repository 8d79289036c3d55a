"""Example sentences for entries by substring match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lexmill import fixed
from lexmill.functions.classify import eligible_sentence, eligible_translation, example_terms
from lexmill.functions.text import distance_from_ideal, has_kanji, strip
from lexmill.operators.common import broadcast_if_small, first_n, term_pieces


def entry_terms(lexicon: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """(term, entry_id, freq_rank) for entries of the chosen levels."""
    rows = lexicon.where(F.col("level").isin(levels)) if levels else lexicon
    return rows.select(
        "entry_id", "freq_rank", F.explode(example_terms("headword", "writings", "major", "pos")).alias("term")
    )


def linked_sentences(sentences: DataFrame, translations: DataFrame, links: DataFrame,
                     sentence_test=eligible_sentence, translation_test=eligible_translation) -> DataFrame:
    """Eligible sentences with their shortest eligible translation.

    Both sides are filtered before the joins; the pick combines on the map
    side, so a sentence with very many links is one row per task.
    """
    s = sentences.select(F.col("sentence_id").alias("src"), strip("text").alias("sentence")).where(sentence_test("sentence"))
    t = translations.select(
        F.col("sentence_id").alias("dst"), strip("text").alias("translation")
    ).where(translation_test("translation"))
    both = links.join(t, "dst").groupBy("src").agg(
        F.min_by(F.struct("dst", "translation"), F.struct(F.length("translation"), "line_ord")).alias("t")
    )
    return s.join(both, "src").select(
        F.col("src").alias("sentence_id"), "sentence",
        F.col("t.dst").alias("translation_id"), F.col("t.translation").alias("translation"),
    )


def _counted(texts: DataFrame, gaps: list[str]) -> DataFrame:
    """Texts with ``several``: whether their sentence id stands for texts of other lengths too."""
    ids = texts.groupBy("sentence_id").agg((F.min(F.struct(*gaps)) != F.max(F.struct(*gaps))).alias("several")).where("several")
    repeated = ids.select(F.col("sentence_id").alias("_id"), "several")
    return texts.join(repeated, F.col("sentence_id").eqNullSafe(F.col("_id")), "left").drop("_id").withColumn("several", F.coalesce("several", F.lit(False)))


def match_examples(pairs: DataFrame, terms: DataFrame, per_entry: int = fixed.EXAMPLES_PER_ENTRY,
                   prefers=has_kanji) -> DataFrame:
    """Best example sentences of every entry.

    1. which terms occur in which sentence: substring join on narrow rows, as
       a score needs lengths only;
    2. best sentences of every term, cut in each task before the shuffle: a
       sentence that an entry shows is among the first of one of its terms;
    3. best term per (entry, sentence), combined on the map side;
    4. first ``per_entry`` per entry, cut in each task before the shuffle;
    5. texts are joined back for the few chosen rows.
    """
    gaps = ["sentence_gap", "translation_gap"]
    texts = pairs.select(
        "sentence_id", "sentence",
        distance_from_ideal("sentence").alias("sentence_gap"),
        distance_from_ideal("translation").alias("translation_gap"),
    )
    terms = terms.where(F.length("term") > 0)
    pieces = term_pieces(_counted(texts, gaps), ["sentence_id", *gaps, "several"], "sentence", terms)
    if pieces is None:
        pieces = texts.limit(0).select("sentence_id", *gaps, F.lit(False).alias("several"), F.col("sentence").alias("term"))
    # equal pieces have one rank, so repeats of a piece in a sentence take no place
    place = F.dense_rank().over(W.partitionBy("term").orderBy(*gaps, "sentence_id"))
    few = pieces.where(~F.col("several")).withColumn("place", place).where(F.col("place") <= per_entry).drop("place")
    kept = few.unionByName(pieces.where("several")).drop("several").distinct()
    hits = kept.join(broadcast_if_small(terms), "term")
    score = F.struct(
        F.when(prefers("term"), 0).otherwise(1).alias("kanji_miss"),
        "sentence_gap", "translation_gap",
        F.coalesce("freq_rank", F.lit(fixed.UNRANKED_EXAMPLE)).alias("rank"),
        "term",
    )
    best = hits.groupBy("entry_id", "sentence_id").agg(F.min(score).alias("score"))
    order = [F.col("score.kanji_miss"), F.col("score.sentence_gap"), F.col("score.translation_gap"),
             F.col("score.rank"), F.col("sentence_id")]
    chosen = first_n(best, ["entry_id"], order, per_entry, rank="rank_in_entry")
    return chosen.join(pairs, "sentence_id").select(
        "entry_id", "rank_in_entry", "sentence", "translation",
        F.lit(fixed.EXAMPLE_SOURCE).alias("source"), "sentence_id", "translation_id",
        F.col("score.term").alias("term"),
        F.concat(F.lit(fixed.EXAMPLE_URL), F.col("sentence_id").cast("string")).alias("url"),
    )


def example_totals(examples: DataFrame) -> DataFrame:
    return examples.agg(F.count_distinct("entry_id").alias("covered_entries"), F.count("*").alias("examples"))


def attach_examples(entries: DataFrame, examples: DataFrame, shown: int = fixed.EXAMPLES_PER_ENTRY) -> DataFrame:
    """Entries with their first examples as an array (bounded by ``shown``)."""
    few = examples.where(F.col("rank_in_entry") <= shown)
    lists = few.groupBy("entry_id").agg(
        F.array_sort(F.collect_list(F.struct("rank_in_entry", "sentence", "translation", "source", "url"))).alias("examples")
    )
    return entries.join(lists, "entry_id", "left")
