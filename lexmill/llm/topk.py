"""Exact top-k search: tiled matrix products of queries and shards.

Queries and rows are dealt to cells (query block, shard); both sizes are bounded
by the number of blocks and shards, which follow from the row counts. A cell is
one task group: it multiplies its queries with its rows tile by tile and keeps k
per tile and query. Lists of shards are merged as a tree of ``FAN`` per step, so
no step sorts more than FAN * k scores of a query.

Scores are integer inner products and exact: float32 or float64 products where
the greatest possible score fits their mantissa, whole numbers beyond. Defined
cases: vectors that are null or hold null or non-finite components take no part;
vectors of different length have no product; an empty vector scores 0 with other
empty ones; rows of the query's own id are no candidates; several rows of one id
are candidates each, and several query rows of one id are pooled; ties go to the
smaller id, and of equal (score, id) rows each counts; rows with a null id take
no part; scores beyond a long stop at its ends.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexmill.llm.common import table

K = 5
SCALE = 256
QUERY_BLOCK = 4096
SHARD_ROWS = 16_384
TILE = 4096
FAN = 8
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products of two whole-number float matrices."""
    top = (np.abs(q).max(initial=0) or 0) * (np.abs(v).max(initial=0) or 0) * q.shape[1]
    if top < 2**24:
        return (q.astype(np.float32) @ v.astype(np.float32).T).astype(np.int64)
    if top < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in v]
    return np.array([[max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(x, y, strict=True)))) for y in whole] for x in q], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores of one query, ties to the smaller id; ids ascend."""
    ok = np.flatnonzero(ids != own)
    if len(ok) > k:
        cut = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        above = ok[scores[ok] > cut]
        ok = np.r_[above, ok[scores[ok] == cut][: k - len(above)]]
    return ok[np.lexsort((ids[ok], -scores[ok]))][:k]


def _cell(k: int, scale: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            rows = rows.sort_values("id", kind="stable")
            sizes_q, sizes_v = queries["v"].map(len).to_numpy(), rows["v"].map(len).to_numpy()
            shard = int(key[1])
            for n in np.unique(sizes_q):
                q_ids = queries["id"].to_numpy()[sizes_q == n]
                v_ids = rows["id"].to_numpy()[sizes_v == n]
                if not len(v_ids):
                    continue
                q = np.floor(scale * np.stack(queries["v"].to_numpy()[sizes_q == n]).astype(np.float64).reshape(len(q_ids), n))
                v = np.floor(scale * np.stack(rows["v"].to_numpy()[sizes_v == n]).astype(np.float64).reshape(len(v_ids), n))
                for a in range(0, len(q), 512):
                    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q[a : a + 512])
                    for b in range(0, len(v), TILE):
                        s, ids = _scores(q[a : a + 512], v[b : b + TILE]), v_ids[b : b + TILE]
                        for i, (got, at) in enumerate(held):
                            pick = best(s[i], ids, q_ids[a + i], k)
                            got, at = np.r_[got, s[i][pick]], np.r_[at, ids[pick]]
                            keep = np.lexsort((at, -got))[:k]
                            held[i] = got[keep], at[keep]
                    out += [(int(q_ids[a + i]), int(x), int(y), shard) for i, (got, at) in enumerate(held) for y, x in zip(got, at, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "shard"])

    return run


def top_k(queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of greatest integer product with each query."""
    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))

    asked, held = plain(queries), plain(rows)
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    shards = max(1, math.ceil(held.count() / SHARD_ROWS), math.ceil(2 * rows.sparkSession.sparkContext.defaultParallelism / blocks))
    some = F.monotonically_increasing_id()
    q = asked.withColumn("block", F.pmod(F.xxhash64("id", some), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    v = held.withColumn("shard", F.pmod(F.xxhash64("id", some), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    lists = q.groupBy("block", "shard").cogroup(v.groupBy("block", "shard")).applyInPandas(_cell(k, scale), "query_id long, vec_id long, score long, shard int")
    while shards > 1:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        shards = math.ceil(shards / FAN)
        order = W.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows)


OP1_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
