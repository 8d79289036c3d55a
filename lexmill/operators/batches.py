"""Exact greedy request batches over rows of any number.

A batch closes when the next row would pass its limits, so where it closes
depends on all rows before. But a batch holds few rows, so a part of consecutive
rows can only be entered in a few ways: the first batch that begins in it begins
at one of its first rows. For each of these offsets a part computes where the
batch that is open at its end closes in the next part and how many batches began.
These short tables are chained from part to part; then all parts number their
rows at once. The result is that of one loop over all rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexmill import fixed
from lexmill.operators.common import cut_lineage, first_n

PART_ROWS = 100_000


def closings(sizes: np.ndarray, counts: np.ndarray, max_rows: int, max_chars: int) -> np.ndarray:
    """For a batch that begins at each row, the row at which the next one begins."""
    spent, held = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(counts)]
    by_size = np.searchsorted(spent, spent[:-1] + max_chars, "right") - 1
    by_count = np.searchsorted(held, held[:-1] + max_rows, "right") - 1
    return np.maximum(np.arange(len(sizes)) + 1, np.minimum(by_size, by_count))


def transfers(following: np.ndarray, rows: int, offsets: int) -> tuple[list[int], list[int]]:
    """Per entry offset: the offset at which the next part is entered, and the batches that began here."""
    leave, began = list(range(rows, len(following) + 1)), [0] * (len(following) + 1)
    out = [0] * rows + leave
    for i in range(rows - 1, -1, -1):
        j = int(following[i])
        out[i], began[i] = out[j], began[j] + 1
    ends = [out[o] - rows if o < len(out) else o - rows for o in range(offsets + 1)]
    return ends, [began[o] if o < rows else 0 for o in range(offsets + 1)]


def _numbers(following: np.ndarray, rows: int, enter: int, first: int) -> np.ndarray:
    """Batch of every row of a part that is entered at ``enter`` with ``first`` batches before."""
    begins = np.zeros(rows, np.int64)
    i = enter
    while i < rows:
        begins[i] = 1
        i = int(following[i])
    return first - 1 + np.cumsum(begins)


def request_batches(rows: DataFrame, order: list[str], size: str, max_rows: int = fixed.BATCH_ROWS, max_chars: int = fixed.BATCH_CHARS,
                    count: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with the number of their batch, from 0, in one sequence over ``order`` (unique).

    A batch holds ``max_rows`` rows (or a sum of ``count``, 1 and more per row)
    and ``max_chars`` of ``size`` at most; a row beyond that is a batch alone.
    Null sizes are 0. Only ordering keys and sizes go to Python.
    """
    narrow = rows.select(
        *order, F.greatest(F.lit(0), F.coalesce(F.col(size).cast("long"), F.lit(0))).alias("_size"),
        F.greatest(F.lit(1), F.coalesce(F.col(count).cast("long"), F.lit(1)) if count else F.lit(1)).cast("long").alias("_count"))
    parts = max(1, -(-rows.count() // part_rows))
    dealt = cut_lineage(narrow.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    # The rows that a part's last batch may take from the parts behind it: at most ``max_rows`` per part.
    heads: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(first_n(dealt, ["_part"], order, max_rows, "_n").select("_part", "_n", "_size", "_count").collect(), key=lambda r: (r["_part"], r["_n"])):
        heads.setdefault(r["_part"], []).append((r["_size"], r["_count"]))
    present = sorted(heads)
    behind: dict[int, list[tuple[int, int]]] = {}
    ahead: list[tuple[int, int]] = []
    for p in reversed(present):
        behind[p] = ahead[:max_rows]
        ahead = (heads[p] + ahead)[:max_rows]

    def following(pdf: pd.DataFrame) -> np.ndarray:
        extra = behind[int(pdf["_part"].iloc[0])]
        sizes = np.r_[pdf["_size"].to_numpy(np.int64), np.array([s for s, _ in extra], np.int64)]
        return closings(sizes, np.r_[pdf["_count"].to_numpy(np.int64), np.array([c for _, c in extra], np.int64)], max_rows, max_chars)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        ends, began = transfers(following(pdf), len(pdf), max_rows)
        return pd.DataFrame({"_part": [int(pdf["_part"].iloc[0])], "ends": [ends], "began": [began]})

    tables = {r["_part"]: r for r in dealt.groupBy("_part").applyInPandas(table, "_part int, ends array<int>, began array<long>").collect()}
    enter: dict[int, tuple[int, int]] = {}
    offset, number = 0, 0
    for p in present:
        enter[p] = offset, number
        offset, number = tables[p]["ends"][offset], number + tables[p]["began"][offset]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*order).schema.fields)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        batch = _numbers(following(pdf), len(pdf), *enter[int(pdf["_part"].iloc[0])])
        return pdf[order].assign(batch=batch)

    packed = dealt.groupBy("_part").applyInPandas(pack, f"{fields}, batch bigint")
    packed = packed.withColumnsRenamed({c: f"_o_{c}" for c in order})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in order])
    return rows.join(packed, same).drop(*[f"_o_{c}" for c in order])
