"""Suffix-array dedup: remove every byte that lies in a long string seen earlier.

A string of ``LENGTH`` bytes is removed where the same string starts earlier
(smaller row key, or same document and smaller start). Strings are judged on the
input, overlaps count.

1. *Anchors.* Among the grams of a window of LENGTH bytes the one of least hash
   is its anchor (ties: all). Equal windows have equal anchors, so a repeated
   string is found by looking only at anchors that occur twice, about one byte
   in 35. Anchors with the same bytes around them fall together at once, first
   inside a task and then after one shuffle by gram; all but the first are
   repeats.
2. *Suffix sort.* Where one gram has different surroundings, the windows around
   it are sorted as suffixes by a bottom-up mergesort. Two suffixes are compared
   by a binary search for their common extension over prefix polynomial hashes,
   and by the byte after it. Neighbours that share LENGTH bytes are one string;
   each such claim is checked byte by byte, and a collision sends its run to a
   plain comparison.
3. Groups are cut into runs of ``RUN`` anchors. The windows that are new in their
   run meet those of other runs by two 64-bit hashes, minima combined before the
   shuffle, so a gram that a third of all documents hold is never sorted in one
   task.

Defined cases: null or empty text has 0 bytes; texts shorter than LENGTH keep
all; rows with equal or null ids are separate documents, ordered by (id, nulls
first; text); fully equal rows in an order that Spark chooses, with equal
results; very long texts are cut into overlapping segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import U, Powers, batches, longs, merged, mix, pieces, ranges, row_keyed, spread, stored, table, text_buffer

LENGTH = 100
GRAM = 32
RUN = 1024
SEGMENT = 1 << 19

ONE, TWO = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)
FOUND = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("k", pa.int64()), ("loc", pa.int64())])
SPANS = pa.schema([("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("h", pa.int64()), ("run", pa.int64())])
CONTEXT = pa.schema([("h", pa.int64()), ("run", pa.int64()), ("k", pa.int64()), ("pos", pa.int64()), ("l", pa.int32()), ("bytes", pa.binary())])
INTERVALS = pa.schema([("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])
# loc packs position, bytes to the left and bytes to the right
LEFT_BITS, RIGHT_BITS = 10, 10


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over x[i : i + n] for every i, by doubling."""
    width = 1
    while width * 2 <= n:
        x = f(x[:-width], x[width:])
        width *= 2
    return x if width == n else f(x[: len(x) - (n - width)], x[n - width :])


def _segments(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Lists of (row, from, to, first window, last window + 1), positions in the row, of about SEGMENT bytes."""
    now, size, margin = [], 0, 2 * length
    for row in range(len(offsets) - 1):
        n = int(offsets[row + 1] - offsets[row])
        if n < length:
            continue
        windows = n - length + 1
        for s in range(0, windows, SEGMENT):
            e = min(windows, s + SEGMENT)
            lo, hi = max(0, s - margin), min(n, e + length + margin)
            now.append((row, lo, hi, s, e))
            size += hi - lo
            if size >= SEGMENT:
                yield now
                now, size = [], 0
    if now:
        yield now


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Row, gram hash, surroundings' hash, position, left and right extent of every anchor."""
    grams = length - gram + 1
    for parts in _segments(offsets, length):
        row, lo, hi, first, last = (np.array(x, np.int64) for x in zip(*parts, strict=True))
        size = hi - lo
        at = np.r_[0, np.cumsum(size)]
        text = np.concatenate([data[offsets[r] + a : offsets[r] + b] for r, a, b in zip(row, lo, hi, strict=True)]).astype(U) + U(1)
        n = len(text)
        up, down = ONE.to(n + 1)
        p = np.zeros(n + 1, U)
        np.cumsum(text * up[:n], out=p[1:])
        h = mix((p[gram:] - p[:-gram]) * down[: n - gram + 1])
        least = _sliding(h, grams, np.minimum)
        inside = np.zeros(n + 1, np.int8)
        inside[at[:-1] + first - lo] += 1
        np.subtract.at(inside, at[:-1] + last - lo, 1)
        least[np.cumsum(inside)[: len(least)] == 0] = 0
        pad = np.zeros(grams - 1, U)
        most = _sliding(np.concatenate([pad, least, pad]), grams, np.maximum)
        x = np.flatnonzero((most[: len(h)] == h) & (h != 0))
        seg = np.searchsorted(at, x, "right") - 1
        left = np.minimum(length - gram, x - at[seg])
        right = np.minimum(length, at[seg + 1] - x)
        up2, down2 = TWO.to(n + 1)
        np.cumsum(text * up2[:n], out=p[1:])
        around = mix((p[x + right] - p[x - left]) * down2[x - left] + left.astype(U) * U(0xA24BAED4963EE407) + right.astype(U))
        yield row[seg], h[x], around, x - at[seg] + lo[seg], left, right


def _found(length: int, gram: int):
    """Rows of a task: one anchor for each (gram, surroundings), and spans that repeat an earlier one of the task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts, 1, 1 << 22):
            key = longs(part.column(0))
            order = np.argsort(key, kind="stable")
            part, key = part.take(pa.array(order)), key[order]
            got = list(_anchors(*text_buffer(part.column(1)), length, gram))
            if not got:
                continue
            row, h, ctx, pos, left, right = (np.concatenate(x) for x in zip(*got, strict=True))
            once = np.unique(row << 32 | pos, return_index=True)[1]  # segments overlap: an anchor of two is one
            row, h, ctx, pos, left, right = (v[once] for v in (row, h, ctx, pos, left, right))
            h, ctx = h.view(np.int64), ctx.view(np.int64)
            by = np.argsort((h.view(U) * U(3) + ctx.view(U)), kind="stable")  # rows came in (key, position) order
            row, h, ctx, pos, left, right = (v[by] for v in (row, h, ctx, pos, left, right))
            again = np.r_[False, (h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1])]
            k = key[row]
            new = ~again
            yield from batches(FOUND, [h[new], ctx[new], k[new], (pos << LEFT_BITS + RIGHT_BITS | left << RIGHT_BITS | right)[new]])
            again &= left + right >= length
            owner, a, b = merged(row[again], (pos - left)[again], (pos + right)[again])
            spread_by = mix((key[owner].view(U) << U(20)) ^ a.view(U)).view(np.int64)
            yield from batches(FOUND, [spread_by, a, key[owner], -b - 1])

    return run


def _split(length: int):
    """From rows sorted by (h, ctx, k, loc): spans that repeat, and anchors whose gram has several surroundings."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before this batch, as (h, ctx, k, loc)
        held = None  # a first anchor that waits for another surrounding of its gram
        rank = 0  # anchors given out of the gram at hand
        for part in parts:
            h, ctx, k, loc = (longs(c) for c in part.columns)
            done = loc < 0
            yield from batches(SPANS, [k[done], ctx[done], -loc[done] - 1, np.full(done.sum(), 0, np.int64), np.full(done.sum(), -1, np.int64)])
            h, ctx, k, loc = (v[~done] for v in (h, ctx, k, loc))
            if not len(h):
                continue
            prev = np.array([last if last else (~h[0], 0, 0, 0)], np.int64)
            same_h = h == np.r_[prev[0, 0], h[:-1]]
            same_ctx = same_h & (ctx == np.r_[prev[0, 1], ctx[:-1]])
            twin = same_ctx & (k == np.r_[prev[0, 2], k[:-1]]) & (loc == np.r_[prev[0, 3], loc[:-1]])  # met in two segments
            last = (h[-1], ctx[-1], k[-1], loc[-1])
            pos, left, right = loc >> LEFT_BITS + RIGHT_BITS, loc >> RIGHT_BITS & (1 << LEFT_BITS) - 1, loc & (1 << RIGHT_BITS) - 1
            rep = same_ctx & ~twin & (left + right >= length)
            yield from batches(SPANS, [k[rep], (pos - left)[rep], (pos + right)[rep], np.zeros(rep.sum(), np.int64), np.full(rep.sum(), -1, np.int64)])
            lead = np.flatnonzero(~same_ctx)
            lh, lk, lp = h[lead], k[lead], pos[lead]
            if held is not None:
                lh, lk, lp = np.r_[held[0], lh], np.r_[held[1], lk], np.r_[held[2], lp]
            if not len(lh):
                continue
            fresh = np.r_[True, lh[1:] != lh[:-1]]
            if held is None and same_h[lead[0]]:
                fresh[0] = False
            start = np.flatnonzero(fresh)
            index = np.arange(len(lh)) - np.repeat(np.r_[0, start] if not fresh[0] else start, np.diff(np.r_[0, start, len(lh)] if not fresh[0] else np.r_[start, len(lh)]))
            if not fresh[0]:
                first = start[0] if len(start) else len(lh)
                index[:first] += rank
            alone = fresh & np.r_[fresh[1:], False]
            open_end = bool(fresh[-1])
            out = ~alone
            if open_end:
                out[-1] = False
            yield from batches(SPANS, [lk[out], lp[out], np.zeros(out.sum(), np.int64), lh[out], index[out] // RUN])
            held = (lh[-1], lk[-1], lp[-1]) if open_end else None
            rank = 0 if open_end else int(index[-1]) + 1

    return run


def _contexts(length: int, gram: int):
    """Bytes around every anchor that has to be sorted."""
    side = length - gram

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = text_buffer(part.column(1))
            k = longs(part.column(0))
            lists = part.column(2)
            counts = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(k)), counts)
            pos, h, runs = (longs(lists.flatten().field(i)) for i in range(3))
            for i in range(0, len(row), 8_000):
                r, p = row[i : i + 8_000], pos[i : i + 8_000]
                size = offsets[r + 1] - offsets[r]
                left, right = np.minimum(side, p), np.minimum(length, size - p)
                ends = np.r_[0, np.cumsum(left + right)].astype(np.int32)
                body = data[ranges(offsets[r] + p - left, left + right)]
                blob = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(ends), pa.py_buffer(body)])
                yield from batches(CONTEXT, [h[i : i + 8_000], runs[i : i + 8_000], k[r], p, left.astype(np.int32), blob])

    return run


def _prefix(grid: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros((len(grid), grid.shape[1] + 1), U)
    for j in range(grid.shape[1]):
        out[:, j + 1] = out[:, j] * U(base) + grid[:, j]
    return out


class Suffixes:
    """Suffixes as rows of a grid (byte + 1, 0 after the end) with prefix polynomial hashes."""

    def __init__(self, grid: np.ndarray):
        self.grid, self.length = grid, grid.shape[1]
        self.hash = _prefix(grid, ONE.base).ravel()
        self.step = self.length + 1

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y: binary search over prefix hashes."""
        x, y = x * self.step, y * self.step
        low = np.where(self.hash[x + self.length] == self.hash[y + self.length], self.length, 0)
        high = np.where(low > 0, self.length, self.length - 1)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            equal = self.hash[x + mid] == self.hash[y + mid]
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low

    def ahead(self, x: np.ndarray, y: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Does x come before y; equal suffixes as ``tie`` says."""
        n = self.common(x, y)
        at = np.minimum(n, self.length - 1)
        return np.where(n == self.length, tie, self.grid[x, at] < self.grid[y, at])

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes within each group (groups lie together), and each one's common length with the one before.

        Bottom-up mergesort, all runs of a level at once: the place of an item is
        its place in its own run plus a binary search in the neighbouring run.
        Every common length is checked byte by byte; a collision of hashes sends
        its group to a plain comparison.
        """
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[start, len(group)])
        base, total = np.repeat(start, size), np.repeat(size, size)
        local = np.arange(len(group)) - base
        order = np.arange(len(group))
        width = 1
        while width < size.max(initial=0):
            act = np.flatnonzero(total > width)
            pair = local[act] // (2 * width) * (2 * width)
            right = local[act] - pair >= width
            lo = np.minimum(np.where(right, pair, pair + width), total[act])
            hi = np.minimum(np.where(right, pair + width, pair + 2 * width), total[act])
            first, own = lo.copy(), order[act]
            go = np.flatnonzero(lo < hi)
            while len(go):
                mid = (lo[go] + hi[go]) >> 1
                before = self.ahead(order[base[act[go]] + mid], own[go], right[go])
                lo[go] = np.where(before, mid + 1, lo[go])
                hi[go] = np.where(before, hi[go], mid)
                go = go[lo[go] < hi[go]]
            order = order.copy()
            order[base[act] + np.where(right, local[act] - width, local[act]) + lo - first] = own
            width *= 2
        x, y = order[:-1], order[1:]
        shared = np.r_[0, self.common(x, y)]
        wrong = np.zeros(len(order), bool)
        for i in range(1, len(order), 20_000):
            j = slice(i, min(len(order), i + 20_000))
            a, b = self.grid[order[j.start - 1 : j.stop - 1]], self.grid[order[j]]
            differ = a != b
            n = np.where(differ.any(1), differ.argmax(1), self.length)
            at = np.minimum(n, self.length - 1)[:, None]
            rises = (np.take_along_axis(a, at, 1) <= np.take_along_axis(b, at, 1)).ravel()
            wrong[j] = (n != shared[j]) | ~rises
        wrong[start] = False
        for g in np.unique(group[order[wrong]]):
            at = np.flatnonzero(group == g)
            order[at] = sorted(at, key=lambda i: self.grid[i].tobytes())
            for a, b in zip(at[:-1], at[1:], strict=True):
                differ = self.grid[order[a]] != self.grid[order[b]]
                shared[b] = differ.argmax() if differ.any() else self.length
        shared[start] = -1
        return order, shared


class Surroundings:
    """Bytes around anchors: right of each (its suffix) and left of each, read backwards."""

    def __init__(self, blob: pa.Array, left: np.ndarray, length: int, gram: int):
        data, offsets = text_buffer(blob)
        self.length, self.side = length, length - gram
        size = np.diff(offsets)
        self.left, self.right = left.astype(np.int64), size - left
        grid = np.zeros((len(size), self.side + length), np.uint8)
        grid[np.repeat(np.arange(len(size)), size), ranges(self.side - self.left, size)] = data[offsets[0] : offsets[-1]] + np.uint8(1)
        self.grid = grid

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of every whole window around the anchors."""
        column = np.arange(self.side + 1)
        return np.nonzero((self.left[:, None] >= self.side - column) & (self.right[:, None] >= self.length - (self.side - column)))

    def window_hash(self, row: np.ndarray, col: np.ndarray, base: int) -> np.ndarray:
        h = _prefix(self.grid, base)
        return h[row, col + self.length] - h[row, col] * U(pow(base, self.length, 1 << 64))

    def _classes(self, grid: np.ndarray, own: np.ndarray, group: np.ndarray, lengths: np.ndarray):
        """For every row and length: a number that rows of one group share if they agree so far; and how far a row agrees with any other."""
        order, shared = Suffixes(np.ascontiguousarray(grid)).sort(group)
        number = np.empty((len(order), len(lengths)), np.int32)
        number[order] = np.cumsum(shared[:, None] < lengths, axis=0, dtype=np.int32)
        most = np.empty(len(order), np.int64)
        most[order] = np.maximum(shared, np.r_[shared[1:], -1])
        return number, np.minimum(most, own)

    def repeats(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bytes left of the anchor) of every window equal to one of an earlier row of its group; rows come in text order."""
        lefts = np.arange(self.side + 1)
        ahead, far = self._classes(self.grid[:, self.side :], self.right, group, self.length - lefts)
        back, near = self._classes(self.grid[:, self.side - 1 :: -1] if self.side else self.grid[:, :0], self.left, group, lefts)
        first = np.maximum(0, self.length - far)
        count = np.maximum(0, np.minimum(near, self.side) - first + 1)
        row, left = np.repeat(np.arange(len(group)), count), ranges(first, count)
        key = (left << 56) | (ahead[row, left].astype(np.int64) << 28) | back[row, left]
        by = np.argsort(key, kind="stable")
        key = key[by]
        again = by[1:][key[1:] == key[:-1]]
        return row[again], left[again]


def _sorted_groups(parts: Iterator[pa.RecordBatch], limit: int = 5_000) -> Iterator[pa.Table]:
    """Tables of whole (h, run) groups from sorted batches."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def ready(final: bool):
        nonlocal held, rows
        whole = pa.Table.from_batches(held).combine_chunks()
        h, run = longs(whole.column(0).combine_chunks()), longs(whole.column(1).combine_chunks())
        cut = len(h) if final else int(np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (run[1:] != run[:-1])])[-1])
        rest = whole.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
        return whole.slice(0, cut)

    for part in parts:
        for i in range(0, part.num_rows, limit):
            held.append(part.slice(i, limit))
            rows += held[-1].num_rows
            if rows >= limit:
                out = ready(False)
                if out.num_rows:
                    yield out
    if rows:
        yield ready(True)


def _repeated(length: int, gram: int):
    """Spans that repeat inside one run of a gram, by suffix sort; of grams with several runs also each window that does not.

    Such a window has two independent hashes in w1 and w2 and no end.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sorted_groups(parts):
            h, r, k, pos, left = (longs(t.column(i).combine_chunks()) for i in range(5))
            wide = t.column(6).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            group = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) - 1
            s = Surroundings(t.column(5).combine_chunks(), left, length, gram)
            row, before = s.repeats(group)
            start = pos[row] - before
            owner, a, b = merged(k[row], start, start + length)
            none = np.zeros(len(a), np.int64)
            yield from batches(INTERVALS, [owner, a, b, none, none])
            if wide.any():
                fresh, col = s.windows()
                keep = wide[fresh] & ~np.isin(fresh * np.int64(length) + s.side - col, row * np.int64(length) + before)
                fresh, col = fresh[keep], col[keep]
                w1, w2 = (s.window_hash(fresh, col, p.base).view(np.int64) for p in (ONE, TWO))
                yield from batches(INTERVALS, [k[fresh], pos[fresh] + col - s.side, np.full(len(fresh), -1, np.int64), w1, w2])

    return run


def _cut(with_text: bool):
    """Counts, kept bytes' digest and removed spans of each document; the kept bytes too if asked for."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts, 2, 1 << 22):
            data, offsets = text_buffer(part.column(2))
            lists = part.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            a, b = (longs(lists.flatten().field(i)) for i in range(2))
            owner, a, b = merged(np.repeat(np.arange(len(counts)), counts), a, b)
            edge = np.searchsorted(owner, np.arange(len(counts) + 1))
            rows = []
            for i in range(len(counts)):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                spans = list(zip(a[edge[i] : edge[i + 1]].tolist(), b[edge[i] : edge[i + 1]].tolist(), strict=True))
                kept, now = [], lo
                for x, y in spans:
                    kept.append(data[now : lo + x])
                    now = lo + y
                whole = b"".join([*kept, data[now:hi]])
                rows.append((hi - lo, hi - lo - len(whole), len(spans), hashlib.sha256(whole).hexdigest(), [v for s in spans for v in s], whole.decode("utf-8", "ignore") if with_text else None))
            n, gone, runs, sha, flat, whole = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(flat, pa.list_(pa.int64())), pa.array(whole, pa.string()), part.column(4)],
                names=["_k", "_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "carry"],
            )

    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k, a, b): byte spans, possibly overlapping, whose union is what repeats earlier text.

    ``keyed`` holds a unique long ``_k`` in text order and a string ``text``.
    """
    if not 8 <= gram <= length <= (1 << RIGHT_BITS) - 1:
        raise ValueError("8 <= gram <= length < 1024")
    texts = keyed.select("_k", "text").where(F.octet_length("text") >= length)
    found = spread(texts).mapInArrow(_found(length, gram), "h long, ctx long, k long, loc long")
    sorted_ = found.repartition("h").sortWithinPartitions("h", "ctx", "k", "loc")
    spans = stored(sorted_.mapInArrow(_split(length), "k long, a long, b long, h long, run long"))
    certain = spans.where("run < 0").select("k", "a", "b")
    wanted = spans.where("run >= 0").groupBy("k").agg(F.collect_list(F.struct("a", "h", "run")).alias("at"))
    contexts = stored(texts.join(wanted, texts["_k"] == wanted["k"]).select("_k", "text", "at").mapInArrow(_contexts(length, gram), "h long, run long, k long, pos long, l int, bytes binary"))
    wide = contexts.select("h").where("run > 0").distinct().withColumn("wide", F.lit(True))
    marked = contexts.join(wide, "h", "left").select(*contexts.columns, F.coalesce("wide", F.lit(False)).alias("wide"))
    ordered = marked.repartition("h", "run").sortWithinPartitions("h", "run", "k", "pos")
    solved = stored(ordered.mapInArrow(_repeated(length, gram), "k long, a long, b long, w1 long, w2 long"))
    across = solved.where("b < 0").select("w1", "w2", "k", "a")
    first = across.groupBy("w1", "w2").agg(F.min(F.struct("k", "a")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = across.join(first, ["w1", "w2"]).where(F.struct("k", "a") > F.col("first"))
    return certain.unionAll(solved.where("b >= 0").select("k", "a", "b")).unionAll(later.select("k", "a", (F.col("a") + length).alias("b")))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end, ...), kept, and the columns ``carry``.

    ``kept`` is the text left, null without ``with_text``; bytes of a character that was cut go with it.
    """
    held = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.struct(F.lit(True).alias("_row"), *carry).alias("carry"))
    keyed = row_keyed(held, "_id", "text", carry=("carry",))
    spans = repeated_spans(keyed, length, gram)
    lists = spans.groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = keyed.join(lists, keyed["_k"] == lists["k"], "left").select("_k", "_id", "text", F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans"), "carry")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    out = joined.mapInArrow(_cut(with_text), f"_k long, _id {kinds['_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept string, carry {kinds['carry']}")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", *[F.col("carry")[c].alias(c) for c in carry])


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup(table(spark, sf, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
