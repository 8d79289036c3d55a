"""Helpers of the operators: tables, text buffers in Arrow batches, row keys, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.operators.common import cut_lineage

U = np.uint64
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later steps start from stored rows."""
    return cut_lineage(df)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few splits several tasks; a table with more splits than cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def row_keyed(df: DataFrame, id_col: str, text_col: str, key: str = "_k", carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns (key, id, text, carry ...) with a unique long ``key`` that orders rows by id.

    Unique ids are their own key. Where ids repeat or are null, rows are numbered
    in the order (id, nulls first; then text) and stored.
    """
    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *carry)
    odd = base.groupBy("_id").count().where((F.col("count") > 1) | F.col("_id").isNull()).limit(1).count()
    named = [F.col("_id").alias(id_col), F.col("_text").alias(text_col), *carry]
    if not odd:
        return base.select(F.col("_id").cast("long").alias(key), *named)
    ordered = base.repartitionByRange("_id", "_text").sortWithinPartitions("_id", "_text")
    return stored(ordered.select(F.monotonically_increasing_id().alias(key), *named))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def longs(column: pa.Array, null: int = 0) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy(zero_copy_only=False).astype(np.int64)


def batches(schema: pa.Schema, columns: list, size: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length from whole columns (numpy or Arrow)."""
    n = len(columns[0])
    for i in range(0, n, size):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + size], f.type) if isinstance(c, np.ndarray) else c[i : i + size] for c, f in zip(columns, schema, strict=True)], schema=schema)


def pieces(parts: Iterator[pa.RecordBatch], column: int, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a text column holds about ``size`` bytes."""
    for part in parts:
        _, offsets = text_buffer(part.column(column))
        i = 0
        while i < part.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            yield part.slice(i, j - i)
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))
        return self.up, self.down


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, count), concatenated."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals per owner: touching or overlapping ones become one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    group = np.cumsum(np.r_[True, owner[1:] != owner[:-1]]) - 1
    base = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * base) - group * base
    first = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(first)
    return owner[at], start[at], reach[np.r_[at[1:] - 1, len(owner) - 1]]
