"""Result pages by a rank directory.

Rows lie in parts that follow one another in the result's order. A directory,
the number of rows of every part with the numbers before it, tells which parts
hold a page; only those are opened and ordered. Nothing gathers the pages before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from lexmill.operators.common import cut_lineage


def directory(rows: DataFrame, parts: Sequence[str]) -> list[Row]:
    """Parts with their number of rows; as many rows as there are parts."""
    return rows.groupBy(*parts).agg(F.count("*").alias("rows")).collect()


def _one_of(parts: Sequence[str], chosen: list[Row]) -> Column:
    if len(parts) == 1:  # plain membership, which prunes the folders of parts
        return F.col(parts[0]).isin([r[parts[0]] for r in chosen])
    same = [reduce(lambda a, b: a & b, [F.col(p) == F.lit(r[p]) for p in parts]) for r in chosen]
    return reduce(lambda a, b: a | b, same, F.lit(False))


def directory_page(rows: DataFrame, parts: Sequence[str], order: list[Column], page: int, size: int,
                   known: list[Row] | None = None, falling: Sequence[str] = ()) -> DataFrame:
    """One page of rows whose parts follow one another in ``order``; a page past the end is the last one.

    Parts sort by the columns ``parts``, those named in ``falling`` downwards.
    ``known`` is the directory where it is already at hand.
    """
    counts = directory(rows, parts) if known is None else list(known)
    for p in reversed(parts):
        counts.sort(key=lambda r: r[p], reverse=p in falling)
    total = sum(r["rows"] for r in counts)
    start = (min(max(1, page), max(1, -(-total // size))) - 1) * size
    before, chosen, base = 0, [], []
    for r in counts:
        if before < start + size and before + r["rows"] > start:
            chosen.append(r)
            base.append(before)
        before += r["rows"]
    if not chosen:
        return rows.limit(0)
    held = rows.where(_one_of(parts, chosen))
    offset = F.lit(None).cast("long")
    for r, b in zip(chosen, base, strict=True):
        offset = F.when(_one_of(parts, [r]), F.lit(b).cast("long")).otherwise(offset)
    inside = F.row_number().over(W.partitionBy(*parts).orderBy(*order))
    placed = held.withColumn("_place", offset + inside)
    return placed.where((F.col("_place") > start) & (F.col("_place") <= start + size)).orderBy("_place").drop("_place")


def dealt_page(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of rows in no stored order.

    The first page is what each task's first rows merge to. For a later one,
    rows are dealt by range of the order, stored, and paged by their directory.
    """
    if page <= 1:
        return rows.orderBy(*order).limit(size)
    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    return directory_page(dealt, ["_part"], order, page, size).drop("_part")


def next_page(rows: DataFrame, part: str, key: Sequence[str], last: DataFrame | None, size: int) -> DataFrame:
    """The ``size`` rows after the one row of ``last``, which has the key columns and its part (None: from the start).

    Keys are unique and their parts rise with them. The count over the narrow
    key columns names the parts that fill the page.
    """
    after = rows
    if last is not None:
        row = last.select(part).first()
        if row is None:
            return rows.limit(0)
        bound = last.select(F.struct(*key)).limit(1).scalar()
        after = rows.where((F.col(part) >= row[part]) & (F.struct(*key) > bound))
    got, chosen = 0, []
    for r in sorted(directory(after, [part]), key=lambda r: r[part]):
        if got < size:
            chosen.append(r)
            got += r["rows"]
    return after.where(_one_of([part], chosen)).orderBy(*key).limit(size) if chosen else rows.limit(0)
