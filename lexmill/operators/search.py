"""Faceted, ranked and paged search over a lexicon.

``prepare`` writes the expensive parts once: ``search_docs`` (one row per entry
with its search texts, labels and part groups) and ``search_terms`` (exact terms
by kind). A request is then one filter, one score join and one top-k.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lexmill import fixed
from lexmill.functions import classify as cl
from lexmill.functions import text as tx
from lexmill.functions.collation import japanese_keys
from lexmill.functions.romaji import kana_to_romaji, romaji_variants
from lexmill.operators.common import cut_lineage, find_terms, first_n, with_nfkc
from lexmill.operators.paging import dealt_page
from lexmill.operators.variants import variant_forms, with_indexed_text

FIELD = "\u0001"
ITEM = "\u0002"
GROUP = "\u0003"


@dataclass(frozen=True)
class SearchRequest:
    text: str = ""
    term_only: bool = False
    major: str = ""
    cluster: str = ""
    levels: tuple[str, ...] = ()
    ref_levels: tuple[str, ...] = ()
    part_group: str = ""
    transitivity: str = ""
    kanji: str = ""
    kanji_reading: str = ""
    status: str = ""
    sort: str = "rank"
    manual_sort: bool = False
    seed: int = 0
    page: int = 1
    page_size: int = fixed.DEFAULT_PAGE_SIZE


# -- preparation -------------------------------------------------------------------

TEXT_FIELDS = [
    "headword", "reading", "writings", "readings", "kanji", "major", "cluster", "pos", "transitivity",
    "conjugation", "related", "tags", "glosses", "translation", "translation_source", "freq_pos",
]
KEPT_FIELDS = ["headword", "reading", "major", "cluster", "level", "ref_level", "transitivity", "kanji", "freq_rank"]


def search_docs(lexicon: DataFrame, variants: DataFrame | None = None, compatibility: bool = True,
                variant_limit: int | None = fixed.VARIANT_COMBINATIONS) -> DataFrame:
    """One row per entry with search texts, part labels and part groups.

    All text fields travel through NFKC as one string per row, and only rows
    that it can change leave the JVM.
    """
    have = {f.name: f.dataType.typeName() for f in lexicon.schema.fields}

    def joined(name):
        if name not in have:
            return F.lit("")
        if have[name] == "array":
            return F.coalesce(F.array_join(name, ITEM), F.lit(""))
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    packed = F.concat_ws(FIELD, *[joined(n) for n in TEXT_FIELDS])
    lexicon = lexicon.withColumn("_packed", packed)
    if compatibility:
        lexicon = with_nfkc(lexicon, "_packed")
    normal = F.split(tx.normalize_search("_packed", False), FIELD, -1)
    at = {n: F.get(normal, i) for i, n in enumerate(TEXT_FIELDS)}
    items = lambda n: F.filter(F.split(F.col(f"n.{n}"), ITEM), lambda x: x != "")
    kept = [c for c in KEPT_FIELDS if c in have]
    base = lexicon.select(
        "entry_id", "source_ord", *kept, F.struct(*[at[n].alias(n) for n in TEXT_FIELDS]).alias("n")
    )
    flat = lambda n: F.replace(F.col(f"n.{n}"), F.lit(ITEM), F.lit(" "))
    readings = tx.non_empty(F.concat(F.array("n.reading"), items("readings")))
    spoken = F.concat(readings, F.flatten(F.transform(readings, lambda r: romaji_variants(kana_to_romaji(r)))))
    docs = base.select(
        "entry_id", "source_ord", *kept,
        F.concat_ws(" ", *[F.nullif(flat(n), F.lit("")) for n in ("headword", "writings", "kanji")]).alias("writing_text"),
        F.array_join(spoken, " ").alias("reading_text"),
        F.concat_ws(" ", *[F.nullif(flat(n), F.lit("")) for n in TEXT_FIELDS if n != "freq_pos"]).alias("all_text"),
        tx.non_empty(F.concat(F.array("n.headword"), items("writings"))).alias("writing_forms"),
        readings.alias("reading_forms"),
        F.filter(F.split(F.replace("n.pos", F.lit(ITEM), F.lit(";")), "[；;]"), lambda x: x != "").alias("labels"),
        F.col("n.freq_pos").alias("_fp"),
    )
    docs = with_indexed_text(docs, "entry_id", "writing_text", variants, variant_limit)
    docs = with_indexed_text(docs, "entry_id", "all_text", variants, variant_limit)
    groups = cl.part_groups("labels", "major", "transitivity", "_fp")
    return docs.select(
        *[c for c in docs.columns if c not in ("all_text", "_fp")],
        F.concat_ws(" ", "all_text", "writing_text", "reading_text").alias("search_text"),
        groups.alias("part_groups"),
        F.array_contains(groups, "verb").alias("is_verb"),
    )


def search_terms(lexicon: DataFrame, variants: DataFrame | None = None, compatibility: bool = True,
                 variant_limit: int | None = fixed.VARIANT_COMBINATIONS) -> DataFrame:
    """(entry_id, kind, term): exact writing, kanji, reading and romaji terms."""
    joined = lambda items: F.coalesce(F.array_join(items, FIELD), F.lit(""))
    packed = lexicon.select("entry_id", F.concat_ws(
        GROUP,
        joined(F.concat(F.array(F.coalesce("headword", F.lit(""))), "writings")),
        joined(F.col("kanji")),
        joined(F.concat(F.array(F.coalesce("reading", F.lit(""))), "readings")),
    ).alias("_packed"))
    if compatibility:
        packed = with_nfkc(packed, "_packed")
    parts = F.split(tx.normalize_search("_packed", False), GROUP, -1)
    keys = lambda i: tx.non_empty(F.transform(F.split(F.get(parts, i), FIELD), tx.strip))
    base = packed.select("entry_id", keys(0).alias("writing"), keys(1).alias("kanji"), keys(2).alias("reading"))
    tagged = lambda kind, arr: F.transform(arr, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    romaji = F.flatten(F.transform("reading", lambda r: romaji_variants(kana_to_romaji(r))))
    rows = base.select(
        "entry_id",
        F.explode(
            F.concat(
                tagged("writing", F.col("writing")), tagged("kanji", F.col("kanji")),
                tagged("reading", F.col("reading")), tagged("romaji", F.array_distinct(romaji)),
            )
        ).alias("t"),
    ).select("entry_id", "t.*")
    if variants is None:
        return rows.distinct()
    written = rows.where(F.col("kind").isin("writing", "kanji") & tx.has_kanji("term"))
    forms = variant_forms(written, "term", variants, variant_limit)
    extra = written.join(forms, "term").select("entry_id", "kind", F.explode("forms").alias("term"))
    return rows.unionByName(extra.where(F.col("term") != "")).distinct()


# -- one request ---------------------------------------------------------------------

def fold(text: str) -> str:
    """Search form of a typed text; equals ``normalize_search`` on columns."""
    return unicodedata.normalize("NFKC", text).lower().translate(
        str.maketrans(fixed.KATAKANA_LETTERS, fixed.HIRAGANA_LETTERS)
    )


def query_tokens(text: str) -> list[str]:
    return fold(text).split()


def token_matches(token: str, term_only: bool) -> Column:
    if not term_only:
        return F.col("search_text").contains(token)
    if re.search(f"[{fixed.CJK}]", token):
        return F.col("writing_text").contains(token)
    return F.col("reading_text").contains(token) | F.col("writing_text").contains(token)


def facet_filter(request: SearchRequest) -> Column:
    tests = [F.lit(True)]
    if request.major:
        tests.append(F.col("major") == request.major)
    if request.cluster:
        tests.append(F.col("cluster") == request.cluster)
    if request.levels:
        tests.append(F.col("level").isin(list(request.levels)))
    if request.ref_levels:
        tests.append(F.col("ref_level").isin(list(request.ref_levels)))
    if request.part_group:
        tests.append(F.array_contains("part_groups", request.part_group))
    if request.kanji:
        tests.append(F.array_contains("kanji", request.kanji))
    return reduce(lambda a, b: a & b, tests)


def safe_reading(reading: Column, wanted: str) -> Column:
    """The wanted kana occur other than as the tail of a long vowel."""
    before = {"う": fixed.LONG_O_KANA, "い": fixed.LONG_E_KANA}.get(wanted[:1])
    guard = f"(?<![{before}])" if before else ""
    return reading.rlike(guard + tx.java_quote(wanted))


def reading_position_matches(writing: Column, reading: Column, forms: Column, wanted: str) -> Column:
    """A reading fits a kanji at its place: prefix first, suffix last, inside anywhere safe."""
    chars = tx.characters(writing)
    last = F.size(chars) - 1
    at = F.filter(
        F.transform(chars, lambda c, i: F.when(F.array_contains(forms, c), i)), lambda i: i.isNotNull()
    )
    fits = lambda i: (
        ((i == 0) & reading.startswith(wanted))
        | ((i == last) & reading.endswith(wanted))
        | ((i > 0) & (i < last))
    )
    return safe_reading(reading, wanted) & F.exists(at, fits)


def kanji_reading_filter(forms: Column, wanted: str) -> Column:
    with_kanji = F.filter(
        "writing_forms", lambda w: F.exists(tx.characters(w), lambda c: F.array_contains(forms, c))
    )
    by_place = F.exists(
        with_kanji,
        lambda w: F.exists("reading_forms", lambda r: reading_position_matches(w, r, forms, wanted)),
    )
    return F.when(F.size(with_kanji) == 0, F.exists("reading_forms", lambda r: safe_reading(r, wanted))).otherwise(by_place)


def kanji_forms(kanji: str, variants: DataFrame | None) -> Column:
    if variants is None:
        return F.array(F.lit(kanji))
    found = variants.where(F.col("variant") == kanji).select(F.collect_list("kanji")).scalar()
    return F.concat(F.array(F.lit(kanji)), found)


def exact_scores(terms: DataFrame, tokens: list[str]) -> DataFrame:
    """(entry_id, score): weakest of the tokens' best exact kinds.

    Only entries on which every token is exact come out. Tokens filter the
    term table by equality, so a bucketed or sorted table is read in part.
    """
    weights = tx.literal_map(fixed.EXACT_SCORES)
    tokens = list(dict.fromkeys(tokens))
    hits = terms.where(F.col("term").isin(tokens))
    per_token = hits.groupBy("entry_id", "term").agg(F.max(F.element_at(weights, F.col("kind"))).alias("score"))
    return per_token.groupBy("entry_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(
        F.col("n") == len(tokens)
    ).drop("n")


def with_status(docs: DataFrame, progress: DataFrame | None, status: str, user_id=None) -> DataFrame:
    if not status or progress is None:
        return docs
    own = progress if user_id is None else progress.where(F.col("user_id") == user_id)
    wanted = "learned" if status == "unlearned" else status
    ids = own.where(F.col("status") == wanted).select("entry_id")
    return docs.join(ids, "entry_id", "left_anti" if status == "unlearned" else "left_semi")


def matching(docs: DataFrame, request: SearchRequest, variants: DataFrame | None = None,
             progress: DataFrame | None = None, user_id=None) -> DataFrame:
    """All entries a request selects, in no order."""
    found = docs.where(facet_filter(request))
    for token in query_tokens(request.text):
        found = found.where(token_matches(token, request.term_only))
    if request.kanji and request.kanji_reading:
        forms = kanji_forms(fold(request.kanji), variants)
        wanted = re.sub(r"[.\-‐‑‒–—−\s]", "", fold(request.kanji_reading))
        fits = kanji_reading_filter(F.col("_forms"), wanted) if wanted else F.lit(False)
        found = found.withColumn("_forms", forms).where(fits).drop("_forms")
    found = with_status(found, progress, request.status, user_id)
    if request.transitivity:
        any_verb = F.coalesce(found.select(F.bool_or("is_verb")).scalar(), F.lit(False))
        found = found.where(~any_verb | cl.matches_transitivity("labels", "transitivity", request.transitivity))
    return found


def kana_order(c: str, collation: str = "ja") -> list[Column]:
    """Sort keys of a text: plain columns in Japanese order, else one column in the named collation."""
    return japanese_keys(c) if collation == "ja" else [F.collate(F.coalesce(F.col(c), F.lit("")), collation)]


def result_order(request: SearchRequest, collation: str = "ja") -> list[Column]:
    kana = lambda c: kana_order(c, collation)
    orders = {
        "reading": [*kana("reading"), *kana("headword")],
        "word": [*kana("headword"), *kana("reading")],
        "category": [*kana("major"), *kana("cluster"), *kana("reading")],
        "random": [F.md5(F.concat_ws(":", F.col("entry_id").cast("string"), F.lit(str(request.seed))))],
    }
    by_rank = [F.coalesce("freq_rank", F.lit(fixed.UNRANKED)), *(F.when(F.col("freq_rank").isNotNull(), k) for k in kana("reading"))]
    order = orders.get(request.sort, by_rank)
    if request.text and request.sort == "rank" and not request.manual_sort:
        order = [F.desc("score"), *order]
    return [*order, F.col("source_ord"), F.col("entry_id")]


def ranked(found: DataFrame, terms: DataFrame | None, request: SearchRequest) -> DataFrame:
    tokens = query_tokens(request.text)
    if not tokens or terms is None:
        return found.withColumn("score", F.lit(0))
    scored = found.join(exact_scores(terms, tokens), "entry_id", "left")
    return scored.withColumn("score", F.coalesce("score", F.lit(0)))


def search(docs: DataFrame, terms: DataFrame | None, request: SearchRequest, variants: DataFrame | None = None,
           progress: DataFrame | None = None, user_id=None, collation: str = "ja") -> DataFrame:
    found = matching(docs, request, variants, progress, user_id)
    return dealt_page(ranked(found, terms, request), result_order(request, collation), request.page, request.page_size)


# -- many requests at once --------------------------------------------------------------

def query_table(queries: DataFrame, compatibility: bool = True) -> DataFrame:
    """(query_id, token) for a table of typed queries (query_id, text)."""
    return queries.select(
        "query_id",
        F.explode(
            F.array_distinct(F.filter(F.split(tx.normalize_search("text", compatibility), r"(?U)\s+"), lambda t: t != ""))
        ).alias("token"),
    )


def batch_matches(docs: DataFrame, tokens: DataFrame, text_col: str = "search_text") -> DataFrame:
    """(query_id, entry_id) where every token of the query is in the text.

    Distinct tokens are found in the texts by the substring join. A query
    then only follows its rarest token, and its other tokens are checked
    against those entries, so a query with one common word does not spread
    over all entries that hold it.
    """
    # met three times below: stored, the texts are opened once
    found = cut_lineage(find_terms(docs, ["entry_id"], text_col, tokens.select(F.col("token").alias("term")).distinct()).select("term", "entry_id"))
    spread = found.groupBy("term").agg(F.count("*").alias("n"))
    wanted = tokens.join(spread, tokens["token"] == spread["term"], "left").select(
        "query_id", "token", F.coalesce("n", F.lit(0)).alias("n")
    )
    per_query = wanted.groupBy("query_id").agg(F.count("*").alias("need"), F.min(F.struct("n", "token")).alias("rare"))
    seeds = per_query.select("query_id", "need", F.col("rare.token").alias("term")).join(found, "term").select(
        "query_id", "need", "entry_id"
    )
    pairs = seeds.join(tokens, "query_id").withColumnRenamed("token", "term")
    kept = pairs.join(found, ["entry_id", "term"]).groupBy("query_id", "need", "entry_id").agg(F.count("*").alias("have"))
    return kept.where(F.col("have") == F.col("need")).select("query_id", "entry_id")


def batch_exact_scores(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, entry_id, score) for entries exact on every token of a query."""
    weights = tx.literal_map(fixed.EXACT_SCORES)
    need = tokens.groupBy("query_id").agg(F.count("*").alias("need"))
    asked = tokens.select(F.col("token").alias("term")).distinct()
    best = terms.join(asked, "term", "left_semi").groupBy("term", "entry_id").agg(F.max(F.element_at(weights, F.col("kind"))).alias("score"))
    hits = tokens.withColumnRenamed("token", "term").join(best, "term")
    per_query = hits.groupBy("query_id", "entry_id").agg(F.min("score").alias("score"), F.count("*").alias("have"))
    return per_query.join(need, "query_id").where(F.col("have") == F.col("need")).select("query_id", "entry_id", "score")


def batch_search(docs: DataFrame, terms: DataFrame, queries: DataFrame, page_size: int = fixed.DEFAULT_PAGE_SIZE,
                 compatibility: bool = True, collation: str = "ja") -> DataFrame:
    """First page of every query as (query_id, position, entry_id, score).

    Queries of equal token sets are answered once; only first pages go back to
    the queries.
    """
    sets = query_table(queries, compatibility).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("token")), " ").alias("token_set"))
    sets = cut_lineage(sets)
    distinct = sets.select(F.col("token_set").alias("query_id")).distinct()
    tokens = distinct.select("query_id", F.explode(F.split("query_id", " ")).alias("token"))
    hits = batch_matches(docs, tokens).join(batch_exact_scores(terms, tokens), ["query_id", "entry_id"], "left")
    scored = hits.withColumn("score", F.coalesce("score", F.lit(0))).join(
        docs.select("entry_id", "freq_rank", "reading", "source_ord"), "entry_id"
    )
    order = [
        F.desc("score"), F.coalesce("freq_rank", F.lit(fixed.UNRANKED)),
        *(F.when(F.col("freq_rank").isNotNull(), k) for k in kana_order("reading", collation)),
        F.col("source_ord"), F.col("entry_id"),
    ]
    pages = first_n(scored, ["query_id"], order, page_size, rank="position").withColumnRenamed("query_id", "token_set")
    return sets.join(pages, "token_set").select("query_id", "position", "entry_id", "score")
