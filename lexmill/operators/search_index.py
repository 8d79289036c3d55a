"""Stored search index: entries in rank order, gram postings, a rank directory.

``write_index`` lays entries out in parts of consecutive ranks (folders), writes
for every gram of one to three characters of their search texts a posting
(field, gram, part, entry_id), sorted and dealt by gram, and keeps the number of
entries of every part. A token reads the row groups and pages of its grams only;
the postings' intersection names entries and parts, and only those parts' texts
are opened for the exact test. Results equal those of ``search.search``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill import fixed
from lexmill.operators import paging
from lexmill.operators.common import overlapping_blocks, spread_scan
from lexmill.operators.search import SearchRequest, exact_scores, matching, query_tokens, ranked, result_order

FIELDS = {"all": "search_text", "writing": "writing_text", "reading": "reading_text"}
GRAM = 3
PART_ROWS = 50_000
#: Characters of a text whose grams are made at once.
BLOCK = 4096
#: Rows of a posting page, the unit that column indexes skip.
PAGE_ROWS = 2_000


@dataclass(frozen=True)
class SearchIndex:
    docs: DataFrame
    grams: DataFrame
    terms: DataFrame
    directory: DataFrame
    collation: str


def _posting_rows(docs: DataFrame) -> DataFrame:
    """(field, gram, part, entry_id) of every search text; a gram comes once a block of its text."""
    texts = spread_scan(docs.select("part", "entry_id", *FIELDS.values()), "entry_id")
    cut = lambda field, column: F.transform(
        overlapping_blocks(F.coalesce(F.col(column), F.lit("")), GRAM, BLOCK), lambda b: F.struct(F.lit(field).alias("field"), b["n"].alias("n"), b["text"].alias("text")))
    blocks = texts.select("part", "entry_id", F.explode(F.concat(*[cut(*f) for f in FIELDS.items()])).alias("b"))
    at = F.sequence(F.lit(1), F.col("b.n"))
    grams = F.flatten(F.transform(at, lambda i: F.transform(F.array(*[F.lit(n) for n in range(1, GRAM + 1)]), lambda n: F.substring(F.col("b.text"), i, n))))
    return blocks.where("b.n > 0").select(F.col("b.field").alias("field"), F.explode(F.array_distinct(grams)).alias("gram"), "part", "entry_id")


def search_grams(docs: DataFrame) -> DataFrame:
    """(field, gram, part, entry_id): distinct grams of 1 to ``GRAM`` characters of every search text."""
    return _posting_rows(docs).distinct()


def _repeats(docs: DataFrame) -> bool:
    """Whether a posting may come twice: by a text of several blocks or by rows of one entry."""
    longer = F.greatest(*[F.max(F.length(c)) for c in FIELDS.values()])
    rows, most, longest = docs.groupBy("part", "entry_id").agg(F.count("*").alias("n"), longer.alias("l")).agg(F.count("*"), F.max("n"), F.max("l")).first()
    return rows > 0 and (most > 1 or (longest or 0) > BLOCK)


def write_index(docs: DataFrame, terms: DataFrame, folder: str, collation: str = "ja", part_rows: int = PART_ROWS, page_rows: int = PAGE_ROWS) -> SearchIndex:
    """Store the index of ``search_docs`` and ``search_terms`` rows below a shared folder."""
    spark = docs.sparkSession
    order = result_order(SearchRequest(), collation)
    parts = max(1, -(-docs.count() // part_rows))
    dealt = docs.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/docs")
    stored = spark.read.parquet(f"{folder}/docs")
    stored.groupBy("part").agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{folder}/directory")
    by_gram = ["field", "gram", "part", "entry_id"]
    # rows dealt by range meet their equals in one task, so repeated postings need no shuffle of their own
    postings = _posting_rows(stored).repartitionByRange(*by_gram)
    postings = postings.distinct() if _repeats(stored) else postings
    postings.sortWithinPartitions(*by_gram).write.mode("overwrite").option("parquet.page.row.count.limit", page_rows).parquet(f"{folder}/grams")
    terms.repartitionByRange("term", "entry_id").sortWithinPartitions("term", "entry_id").write.mode("overwrite").option("parquet.page.row.count.limit", page_rows).parquet(f"{folder}/terms")
    return read_index(spark, folder, collation)


def read_index(spark: SparkSession, folder: str, collation: str = "ja") -> SearchIndex:
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return SearchIndex(read("docs"), read("grams"), read("terms"), read("directory"), collation)


def grams_of(token: str) -> list[str]:
    """Grams that hold wherever the token does: its pieces of ``GRAM`` characters, or the token if shorter."""
    return sorted({token[i : i + GRAM] for i in range(max(1, len(token) - GRAM + 1))})


def fields_of(token: str, term_only: bool) -> list[str]:
    if not term_only:
        return ["all"]
    return ["writing"] if re.search(f"[{fixed.CJK}]", token) else ["reading", "writing"]


def candidates(index: SearchIndex, request: SearchRequest) -> DataFrame | None:
    """(part, entry_id) whose texts hold every gram of every token; None for a request without text."""
    tokens = list(dict.fromkeys(query_tokens(request.text)))
    if not tokens:
        return None
    wanted = {(field, token): grams_of(token) for token in tokens for field in fields_of(token, request.term_only)}
    test = lambda field, grams: (F.col("field") == field) & F.col("gram").isin(grams)
    by_field = {field: sorted({g for (f, _), gs in wanted.items() if f == field for g in gs}) for field in {f for f, _ in wanted}}
    postings = index.grams.where(reduce(lambda a, b: a | b, [test(f, gs) for f, gs in by_field.items()]))

    def whole(token: str) -> Column:
        return reduce(lambda a, b: a | b, [F.count_if(test(f, gs)) == len(gs) for (f, t), gs in wanted.items() if t == token])

    held = postings.groupBy("part", "entry_id").agg(*[whole(t).alias(f"_t{i}") for i, t in enumerate(tokens)])
    return held.where(reduce(lambda a, b: a & b, [F.col(f"_t{i}") for i in range(len(tokens))])).select("part", "entry_id")


def indexed_matching(index: SearchIndex, request: SearchRequest, variants: DataFrame | None = None, progress: DataFrame | None = None, user_id=None) -> DataFrame:
    """Rows of ``search.matching`` (with their part), read from the parts that the postings name."""
    found = candidates(index, request)
    docs = index.docs
    if found is not None:
        parts = [r["part"] for r in found.select("part").distinct().collect()]  # at most one number per folder of the index
        docs = docs.where(F.col("part").isin(parts)).join(found.select("entry_id"), "entry_id", "left_semi")
    return matching(docs, request, variants, progress, user_id)


def indexed_search(index: SearchIndex, request: SearchRequest, variants: DataFrame | None = None, progress: DataFrame | None = None, user_id=None) -> DataFrame:
    """The page that ``search.search`` gives; in rank order it opens only the parts which hold it."""
    found = ranked(indexed_matching(index, request, variants, progress, user_id), index.terms, request)
    order = result_order(request, index.collation)
    if request.sort != "rank":
        return paging.dealt_page(found, order, request.page, request.page_size).drop("part")
    plain = request == SearchRequest(page=request.page, page_size=request.page_size, manual_sort=request.manual_sort)
    known = index.directory.collect() if plain else None
    if request.text and not request.manual_sort:
        # Exact scores are few numbers; rows of one score follow one another in rank order.
        return paging.directory_page(found, ["score", "part"], order, request.page, request.page_size, falling=("score",)).drop("part")
    return paging.directory_page(found, ["part"], order, request.page, request.page_size, known).drop("part")


def rank_key(docs: DataFrame, collation: str = "ja") -> DataFrame:
    """Rows with the columns ``k0, k1 ...`` of the stored order, for pages that follow a given row."""
    order = result_order(SearchRequest(), collation)
    return docs.withColumns({f"k{i}": c for i, c in enumerate(order)})


def following(index: SearchIndex, last: DataFrame | None, size: int) -> DataFrame:
    """The ``size`` entries after the entry in ``last`` (a row of the index's docs), in rank order."""
    keyed = rank_key(index.docs, index.collation)
    key = [c for c in keyed.columns if re.fullmatch(r"k\d+", c)]
    return paging.next_page(keyed, "part", key, None if last is None else rank_key(last, index.collation), size).drop(*key)
