"""Kanji index: counts, metadata, search and detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill import fixed
from lexmill.functions import text as tx
from lexmill.functions.romaji import kana_to_romaji, romaji_variants
from lexmill.operators.common import first_n, ordered_list


def kanji_counts(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(F.explode("kanji").alias("kanji")).groupBy("kanji").agg(F.count("*").alias("count"))


def kanji_metadata(tree: DataFrame, samples: int = fixed.SAMPLE_WORD_LIMIT) -> DataFrame:
    """Per kanji: first non-empty facts, main-node count, first distinct words.

    Words fold to one row per (kanji, word) before the first six are picked,
    so a kanji in a third of all nouns is never gathered.
    """
    order = F.struct("major", "level", "sort_reading", "word", "doc_pos", "entry_id", "ord")
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", order)), F.lit(""))
    facts = tree.groupBy("kanji").agg(
        first("status").alias("status"), first("on_readings").alias("on_readings"), first("kun_readings").alias("kun_readings"),
        F.count_if(F.col("relation") == fixed.MAIN_NODE).alias("noun_count"),
    )
    words = tree.where(F.col("word") != "").groupBy("kanji", "word").agg(
        F.min(order).alias("at"), F.min_by("reading", order).alias("reading")
    )
    few = first_n(words, ["kanji"], ["at"], samples)
    lists = few.groupBy("kanji").agg(ordered_list(F.col("at"), F.struct("word", "reading")).alias("sample_words"))
    return facts.join(lists, "kanji", "left")


def kanji_index(lexicon: DataFrame, metadata: DataFrame) -> DataFrame:
    """Counts with metadata; sort by descending count, then kanji."""
    return kanji_counts(lexicon).join(metadata, "kanji", "left")


def search_kanji(index: DataFrame, query: str, variants: DataFrame | None = None,
                 limit: int | None = None, compatibility: bool = True) -> DataFrame:
    """Kanji that match a query by its script: character, kana or romaji; all of them unless the caller asks for a page."""
    if query:
        normal = tx.normalize_search(F.lit(query), compatibility)
        joined = F.concat_ws("、", F.nullif("on_readings", F.lit("")), F.nullif("kun_readings", F.lit("")))
        kana_text = tx.normalize_search(F.concat_ws(" ", "on_readings", "kun_readings"), compatibility)
        keys = F.split(tx.normalize_search(F.regexp_replace(joined, r"[.\-‐‑‒–—−]|(?U:\s)", ""), compatibility), "[、,，]")
        latin = F.array_join(F.flatten(F.transform(keys, lambda k: romaji_variants(kana_to_romaji(k)))), " ")
        forms = F.col("kanji")
        if variants is not None:
            extra = variants.groupBy("kanji").agg(ordered_list(F.col("ord"), F.col("variant")).alias("_v"))
            index = index.join(extra, "kanji", "left")
            forms = F.concat_ws(" ", "kanji", F.array_join("_v", " "))
        index = index.where(
            F.when(tx.has_kanji(normal), forms.contains(normal))
            .when(tx.has_kana(normal), kana_text.contains(normal))
            .otherwise(latin.contains(normal))
        )
        index = index.drop("_v")
    ordered = index.orderBy(F.desc("count"), "kanji")
    return ordered.limit(limit) if limit else ordered


def own_entries(search_terms: DataFrame, lexicon: DataFrame, kanji: str, limit: int = fixed.OWN_ENTRY_LIMIT) -> DataFrame:
    """Entries one of whose exact writings is the kanji, by rank."""
    own = tx.normalize_search(F.lit(kanji))
    ids = search_terms.where((F.col("kind") == "writing") & (F.col("term") == own)).select("entry_id").distinct()
    return lexicon.join(ids, "entry_id", "left_semi").orderBy(
        F.col("freq_rank").isNull(), "freq_rank", "source_ord"
    ).limit(limit)


def kanji_detail(index: DataFrame, search_terms: DataFrame, lexicon: DataFrame, kanji: str) -> DataFrame:
    """One row: metadata, reading lists, own entries and their readings."""
    own = own_entries(search_terms, lexicon, kanji)
    gathered = own.agg(
        ordered_list(
            F.struct(F.coalesce("freq_rank", F.lit(fixed.UNRANKED)), "source_ord"),
            F.struct("entry_id", "level", "headword", "reading", tx.first_definition(tx.split_list("translation"), "glosses").alias("definition")),
        ).alias("own_entries"),
        F.flatten(
            ordered_list(
                F.struct(F.coalesce("freq_rank", F.lit(fixed.UNRANKED)), "source_ord"),
                F.concat(F.array("reading"), "readings"),
            )
        ).alias("r"),
    ).select("own_entries", tx.non_empty(F.col("r")).alias("entry_readings"), F.lit(kanji).alias("kanji"))
    facts = index.where(F.col("kanji") == kanji)
    return gathered.join(facts, "kanji", "left").select(
        "kanji", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("count", F.lit(0)).alias("count"),
        tx.split_readings("on_readings").alias("on_readings"), tx.split_readings("kun_readings").alias("kun_readings"),
        "own_entries", "entry_readings",
    )
