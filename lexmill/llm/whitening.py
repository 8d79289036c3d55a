"""Embedding whitening: components of the covariance by a bidiagonal qd solver.

Every vector becomes whole numbers x = floor(scale * c). The fit list holds each
distinct x once. Tasks add up its sums, then reduce their centred rows block by
block to a triangle (QR); triangles merge as a tree of ``FAN`` per step, so what
meets in one task is a few squares of the vectors' length. The last triangle, of
a size that does not grow with the rows, is brought to bidiagonal form by
Householder reflections; shifted quotient-difference sweeps (dqds) give its
singular values, and a twisted factorisation per value gives its direction.
Rows are projected where they lie. How far the whitened rows are from unit
covariance is measured over the fit list, not assumed.

Defined cases: vectors that are null or hold null or non-finite entries take no
part; entries beyond a long stop at its ends, and so do deviations; the fit is
of the length that most distinct vectors have (ties: the greater length), rows
of other lengths and empty vectors have no components; a null id is kept; rows
of equal ids or vectors are rows each; components of no variance (fewer than two
distinct vectors, dependent dimensions) are left out, and an empty table gives
no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import stored, table
from lexmill.llm.topk import usable

SCALE = 256
COMPONENTS = 4
FAN = 8
BLOCK = 4096
EPS = float(np.finfo(np.float64).eps)
LONG = (1 << 63) - 1


# -- bidiagonal solver ------------------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector v and value r with (I - 2 v v') x = (r, 0, ...)."""
    size = float(np.linalg.norm(x))
    if size == 0 or not np.any(x[1:]):
        return np.zeros_like(x), float(x[0])
    v = x.copy()
    r = -size if x[0] >= 0 else size
    v[0] -= r
    return v / np.linalg.norm(v), r


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor P of r = U B P'."""
    m = np.array(r, np.float64)
    n = m.shape[1]
    right = np.eye(n)
    for i in range(n):
        v, m[i, i] = _reflector(m[i:, i])
        m[i:, i + 1 :] -= 2 * np.outer(v, v @ m[i:, i + 1 :])
        if i + 1 < n:
            v, m[i, i + 1] = _reflector(m[i, i + 1 :])
            m[i + 1 :, i + 1 :] -= 2 * np.outer(m[i + 1 :, i + 1 :] @ v, v)
            right[:, i + 1 :] -= 2 * np.outer(right[:, i + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, int]:
    """One dqds transform; also the least pivot and the place where it turned negative (or -1)."""
    d = q[0] - shift
    least, new_q, new_e = d, [], []
    for i in range(len(e)):
        if d < 0:
            return new_q, new_e, d, i
        top = d + e[i]
        new_q.append(top)
        if top == 0:
            new_e.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / top
            new_e.append(e[i] * t)
            d = d * t - shift
        least = min(least, d)
    new_q.append(d)
    return new_q, new_e, least, len(e) if d < 0 else -1


def _end_shift(q: list[float], e: list[float], least: float) -> float:
    """Smaller eigenvalue of the last two rows, at most the least pivot seen."""
    a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
    half = (a - c) / 2
    root = np.hypot(half, np.sqrt(b))
    low = c - b / (half + root) if half > 0 else c + half - root if root else c
    return max(0.0, min(float(low), least))


def singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, falling, to high relative accuracy."""
    top = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(upper).max(initial=0)))
    if top == 0:
        return np.zeros(len(diagonal))
    todo = [(list((diagonal / top) ** 2), list((upper / top) ** 2), 0.0)]
    out: list[float] = []
    tol = (100 * EPS) ** 2
    while todo:
        q, e, base = todo.pop()
        if e and 1.5 * q[0] < q[-1]:
            q, e = q[::-1], e[::-1]
        least = 0.0
        while q:
            if not e:
                out.append(base + q[0])
                break
            if e[-1] <= tol * (base + q[-1]) or e[-1] <= tol * tol:
                out.append(base + max(q[-1], 0.0))
                q, e = q[:-1], e[:-1]
                continue
            cut = next((i for i in range(len(e) - 1) if e[i] <= tol * (base + q[i]) or e[i] <= tol * tol), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], base))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            shift = _end_shift(q, e, least)
            while True:
                new_q, new_e, low, bad = _sweep(q, e, shift)
                if bad < 0 or shift == 0:
                    break
                # A pivot that fails only at the end tells how far the shift overshot.
                shift = shift + low if bad == len(e) and shift + low > 0 else shift / 4 if shift > EPS * (q[-1] + EPS) else 0.0
                shift = shift if shift > tol * max(q) else 0.0
            q, e, base, least = new_q, new_e, base + shift, max(low, 0.0)
    return top * np.sqrt(np.sort(np.array(out))[::-1])


class Twisted:
    """Factorisations of B'B - value from both ends, joined where the pivot is least."""

    def __init__(self, diagonal: np.ndarray, upper: np.ndarray, value: float):
        n, tiny = len(diagonal), EPS * value
        a = np.where(np.abs(diagonal) < EPS * np.sqrt(value), EPS * np.sqrt(value), diagonal)
        d, low = a * a, upper / a[:-1]
        self.down, self.pivot_down, s = np.zeros(n - 1), np.zeros(n), np.zeros(n)
        s[0] = -value
        for i in range(n):
            self.pivot_down[i] = s[i] + d[i] or -tiny
            if i < n - 1:
                self.down[i] = d[i] * low[i] / self.pivot_down[i]
                s[i + 1] = self.down[i] * low[i] * s[i] - value
        self.up, self.pivot_up, p = np.zeros(n - 1), np.zeros(n), np.zeros(n)
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            self.pivot_up[i + 1] = d[i] * low[i] ** 2 + p[i + 1] or -tiny
            t = d[i] / self.pivot_up[i + 1]
            self.up[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        gamma = s + p + value
        self.at = int(np.argmin(np.abs(gamma)))
        self.gamma = gamma[self.at] or tiny

    def _outwards(self, w: np.ndarray) -> np.ndarray:
        z, k = w.copy(), self.at
        for i in range(k - 1, -1, -1):
            z[i] -= self.down[i] * z[i + 1]
        for i in range(k, len(z) - 1):
            z[i + 1] -= self.up[i] * z[i]
        return z / np.linalg.norm(z)

    def vector(self) -> np.ndarray:
        w = np.zeros(len(self.pivot_up))
        w[self.at] = 1.0
        return self._outwards(w)

    def solve(self, y: np.ndarray) -> np.ndarray:
        """Direction of the solution of (B'B - value) z = y."""
        u, k = y.copy(), self.at
        for i in range(1, k):
            u[i] -= self.down[i - 1] * u[i - 1]
        for i in range(len(u) - 2, k, -1):
            u[i] -= self.up[i] * u[i + 1]
        if k:
            u[k] -= self.down[k - 1] * u[k - 1]
        if k < len(u) - 1:
            u[k] -= self.up[k] * u[k + 1]
        w = u / np.r_[self.pivot_down[:k], self.gamma, self.pivot_up[k + 1 :]]
        return self._outwards(w / np.abs(w).max())


def directions(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of the given singular values; close values get orthogonal ones."""
    out: list[np.ndarray] = []
    for i, value in enumerate(values):
        twisted = Twisted(diagonal, upper, float(value) ** 2)
        z = twisted.vector()
        near = [v for v, other in zip(out, values, strict=False) if abs(other - value) <= 1e-3 * other]
        for attempt in range(4):
            left = z - sum((v * (v @ z) for v in near), np.zeros_like(z))
            size = np.linalg.norm(left)
            if not near or (attempt and size > 0.9):
                z = left / size
                break
            # Equal values share their twisted vector: solve again for what is orthogonal to the earlier ones.
            start = left / size if size > 0.1 else np.random.default_rng(i + attempt).standard_normal(len(z))
            z = twisted.solve(start - sum((v * (v @ start) for v in near), np.zeros_like(z)))
        else:
            z = z - sum((v * (v @ z) for v in near), np.zeros_like(z))
            z /= np.linalg.norm(z)
        out.append(z)
    return np.array(out).T if out else np.zeros((len(diagonal), 0))


# -- fit over the rows ------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """Fit: number of distinct vectors, exact sums, eigenvalues, directions (columns), trace, error."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    directions: np.ndarray
    total: float
    identity_error: float


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _shifted(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact; whole Python numbers where a long does not hold it."""
    top = max(map(abs, sums), default=0)
    if n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + top <= LONG:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return _shifted(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Sum over dimensions of (n * x - sums)**2, exact up to the end of a long."""
    m = _shifted(x, n, sums)
    if m.dtype != object and float(np.abs(m).max(initial=0)) ** 2 * max(1, m.shape[1]) < 2.0**62:
        return (m * m).sum(1)
    return np.array([min(LONG, sum(int(v) ** 2 for v in row)) for row in m], np.int64)


def _sums(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size, object), 0
        for part in parts:
            x = matrix(part.column(0), size)
            rows += len(x)
            small = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * max(1, len(x)) <= LONG
            total += (x.sum(0) if small else x.astype(object).sum(0)).astype(object)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)), pa.array([rows] * size, pa.int64())], names=["at", "total", "rows"])

    return run


def _triangles(size: int, n: int, sums: tuple[int, ...]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for part in parts:
            x = matrix(part.column(0), size)
            for i in range(0, len(x), BLOCK):
                rows = centred(x[i : i + BLOCK], n, sums)
                r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel().tolist()])], names=["block", "r"])

    return run


def _merge(size: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = np.vstack([np.asarray(r, np.float64).reshape(-1, size) for r in part["r"]])
        return pd.DataFrame({"block": part["block"].iloc[:1].to_numpy(), "r": [np.linalg.qr(rows, mode="r").ravel().tolist()]})

    return run


def triangle(fit: DataFrame, size: int, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Triangle R of the centred rows: R'R is n times their covariance."""
    blocks = fit.rdd.getNumPartitions()
    held = fit.mapInArrow(_triangles(size, n, sums), "block int, r array<double>")
    while blocks > 1:
        blocks = -(-blocks // FAN)
        held = held.withColumn("block", F.floor(F.col("block") / FAN).cast("int")).groupBy("block").applyInPandas(_merge(size), "block int, r array<double>")
    rows = held.collect()
    r = np.array(rows[0].r).reshape(-1, size)
    return np.vstack([r, np.zeros((size - len(r), size))]) if len(r) < size else r


def _products(size: int, n: int, sums: tuple[int, ...], project: np.ndarray):
    k = project.shape[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for part in parts:
            w = centred(matrix(part.column(0), size), n, sums) @ project
            total += w.T @ w
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    return run


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit of a column ``x`` of long arrays, each distinct one counted once; None where no vector is."""
    fit = stored(vectors.select("x").where(F.size("x") > 0).distinct())
    common = fit.groupBy(F.size("x").alias("size")).count().agg(F.max(F.struct("count", "size")).alias("m")).first()["m"]
    if common is None:
        return None
    size = common["size"]
    fit = fit.where(F.size("x") == size)
    added = fit.mapInArrow(_sums(size), "at int, total decimal(38,0), rows long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect()
    n, sums = added[0]["rows"], tuple(int(r["total"]) for r in sorted(added, key=lambda r: r["at"]))
    r = triangle(fit, size, n, sums)
    scale = float(np.abs(r).max()) or 1.0  # keeps squares of very long vectors finite
    diagonal, upper, right = bidiagonal(r / scale)
    all_values = singular_values(diagonal, upper)
    top = all_values[: min(components, size)]
    top = top[top > 8 * size * EPS * (all_values[0] if len(all_values) else 0)]
    found = right @ directions(diagonal, upper, top)
    found = found * np.where(np.take_along_axis(found, np.abs(found).argmax(0)[None], 0)[0] < 0, -1, 1) if len(top) else found
    values = (top * scale) ** 2 / n
    error = 0.0
    if len(top):
        project = found / np.sqrt(values)
        rows = fit.mapInArrow(_products(size, n, sums, project), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        error = max(abs(row["v"] / n - (row["i"] == row["j"])) for row in rows)
    return Whitening(n, sums, values, found, float(((all_values * scale) ** 2).sum() / n), error)


def _project(fit: Whitening):
    size, k = fit.directions.shape
    project, explained = fit.directions / np.sqrt(fit.values), fit.values / fit.total

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = matrix(part.column(1), size)
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, fit.n)), pa.array(np.repeat(deviations(x, fit.n, fit.sums), k)),
                    pa.array((centred(x, fit.n, fit.sums) @ project).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, fit.identity_error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whole(vector, scale: int = SCALE):
    """Whole-number form of a vector column."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * float(scale)).cast("long"))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    taken = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    taken = taken.select("id", whole("v", scale).alias("x"))
    fit = fit_whitening(taken, components)
    if fit is None or not len(fit.values):
        return rows.sparkSession.createDataFrame([], schema)
    return taken.where(F.size("x") == len(fit.sums)).mapInArrow(_project(fit), schema.replace(f"{id_col} ", "id ", 1)).withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"))
