"""N-gram Jaccard join: components of documents whose word-shingle sets are similar.

Two documents link when |x & y| >= 0.75 * |x | y| over their distinct 5-word
shingles. No pair is lost and no pair is listed for its own sake.

1. Documents of equal sets become one class (a 64-bit fingerprint of the set).
2. Every class posts its least-hash shingles, a prefix so long that two similar
   classes share several of them. A list of one class falls out; all classes of
   a list go to the bucket of its least class.
3. A class with too few shared shingles falls out, and each may put aside some of
   its lists, overlong ones first, as partners still meet in another. A bucket of
   more than ``BUCKET`` classes is dealt in blocks that meet in pairs.
4. Inside a bucket a T-occurrence search over its inverted lists: with overlap T
   needed, the L longest lists of a set are put aside, the short ones are merged,
   and what occurs T - L times there is probed in the long ones by binary search.
   The overlap found is exact. Only links that join two components are given.
5. Components over these links, then the least doc_id of each.

Shingles are 64-bit hashes of lower-cased words; posted ones are cut to 40 bits,
which can only add candidates. Defined cases: null, empty or blank text has no
shingles and links with nothing; fewer than five words are one shingle; rows that
repeat a doc_id share their result's id; null ids count as no id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexmill.llm.common import U, Powers, batches, longs, mix, spread, stored, table, text_buffer
from lexmill.llm.components import components

WORDS = 5
PERCENT = 75
BUCKET = 2048
CHUNK = 1 << 20
TOKEN_BITS = 40
SLACK = 10

BASE = Powers(0xD1342543DE82EF95)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PLACE = np.array([pow(0xAF251AF3B0F025B5, j + 1, 1 << 64) for j in range(64)], U)

SIGNATURE = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("f", pa.int64())])
POSTING = pa.schema([("token", pa.int64()), ("f", pa.int64())])
MEMBER = pa.schema([("token", pa.int64()), ("leader", pa.int64()), ("f", pa.int64()), ("long", pa.bool_())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of consecutive texts, and the number of words of each text."""
    lo, hi = starts[0], ends[-1]
    raw = data[lo:hi]
    gap = SPACE[raw]
    text = LOWER[raw].astype(U) + U(1)
    n = len(text)
    edge = np.zeros(n + 1, bool)
    edge[starts - lo] = True
    begin = np.flatnonzero(~gap & (edge[:n] | np.r_[True, gap[:-1]]))
    edge[:] = False
    edge[ends - lo] = True
    end = np.flatnonzero(~gap & (edge[1:] | np.r_[gap[1:], True])) + 1
    up, down = BASE.to(n + 1)
    p = np.zeros(n + 1, U)
    np.cumsum(text * up[:n], out=p[1:])
    h = mix((p[end] - p[begin]) * down[begin] + (end - begin).astype(U))
    at = np.searchsorted(begin, np.r_[starts - lo, n])
    return h, np.diff(at)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    rows = len(offsets) - 1
    i = 0
    while i < rows:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right"))
        j = min(rows, max(i + 1, j - 1))
        h, count = _word_hashes(data, offsets[i:j], offsets[i + 1 : j + 1])
        at = np.r_[0, np.cumsum(count)]
        joint = np.zeros(max(0, len(h) - words + 1), U)
        for w in range(words):
            joint += h[w : len(h) - words + 1 + w] * PLACE[w]
        joint = mix(joint)
        for r in range(j - i):
            a, b = at[r], at[r + 1]
            if b - a >= words:
                yield i + r, np.unique(joint[a : b - words + 1])
            elif b > a:
                yield i + r, mix((h[a:b] * PLACE[: b - a]).sum(keepdims=True, dtype=U) + U(b - a))
            else:
                yield i + r, np.zeros(0, U)
        i = j


def fingerprint(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s ^ U(0x9FB21C651E98DF25)).sum(dtype=U) + U(len(s))], U)).view(np.int64)[0])


def slack(n: int) -> int:
    return 1 + n // SLACK


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - -(-percent * n // 100) + slack(n))


def _signatures(words: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, f = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for row, s in shingle_sets(*text_buffer(part.column(1)), words):
                n[row] = len(s)
                f[row] = fingerprint(s) if len(s) else 0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(f, mask=n == 0)], names=["id", "n", "f"])

    return run


def _postings(words: int, percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            seen, tokens, owner = set(), [], []
            for _, s in shingle_sets(*text_buffer(part.column(0)), words):
                if len(s) and (f := fingerprint(s)) not in seen:
                    seen.add(f)
                    tokens.append(s[: prefix_length(len(s), percent)] >> U(64 - TOKEN_BITS))
                    owner.append(np.full(len(tokens[-1]), f, np.int64))
            if tokens:
                yield from batches(POSTING, [np.concatenate(tokens).astype(np.int64), np.concatenate(owner)])

    return run


def _members(limit: int):
    """From (token, f) in order: classes of lists of two and more, with the list's first class."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader, rank, held = (-1, 0), 0, 0, False
        for part in parts:
            token, f = longs(part.column(0)), longs(part.column(1))
            new = (token != np.r_[last[0], token[:-1]]) | (f != np.r_[last[1], f[:-1]])
            carried = last[0]
            token, f = token[new], f[new]
            if not len(token):
                continue
            last = (int(token[-1]), int(f[-1]))
            if token[0] == carried:  # the list goes on: put its leader in front again
                token, f = np.r_[token[0], token], np.r_[leader, f]
                shift, first_out = rank - 1, held
            else:
                shift, first_out = 0, True
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[start, len(token)])
            base = np.repeat(start, size)
            index = np.arange(len(token)) - base
            index[: size[0]] += np.where(np.arange(size[0]) > 0, shift, 0)
            lead = f[base]
            out = np.repeat(size > 1, size)
            if not first_out:
                out[0] = False
            yield from batches(MEMBER, [token[out], lead[out], f[out], (index == limit)[out]])
            leader, rank, held = int(f[start[-1]]), int(index[-1]) + 1, bool(size[-1] == 1 and (len(start) > 1 or first_out))

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


class Search:
    """T-occurrence search over the inverted lists of a bucket."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets], np.int64)
        self.root = np.arange(len(sets))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        self.root[max(a, b)] = min(a, b)
        return a != b

    def similar(self, x: int, y, overlap) -> np.ndarray:
        return 100 * overlap >= self.percent * (self.size[x] + self.size[y] - overlap)

    def index(self, members: np.ndarray) -> None:
        """Inverted lists of some sets: distinct tokens, list bounds, members in order."""
        tokens = np.concatenate([self.sets[i] for i in members]) if len(members) else np.zeros(0, U)
        owner = np.repeat(members, self.size[members])
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        at = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
        self.tokens, self.start = tokens[at], at
        self.count = np.diff(np.r_[at, len(tokens)])
        self.key = np.repeat(np.arange(len(at)), self.count) * np.int64(len(self.sets)) + self.owner

    def lists(self, x: int) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.tokens, self.sets[x])
        at[at == len(self.tokens)] = 0
        return at[self.tokens[at] == self.sets[x]]

    def merge(self, lists: np.ndarray) -> np.ndarray:
        """How often every set occurs in the lists."""
        count = self.count[lists]
        total = int(count.sum())
        ends = np.cumsum(count)
        at = np.arange(total) - np.repeat(ends - count, count) + np.repeat(self.start[lists], count)
        return np.bincount(self.owner[at], minlength=len(self.sets))

    def partners(self, x: int) -> np.ndarray:
        """Every indexed set similar to x, x itself left out."""
        need = -(-self.percent * int(self.size[x]) // 100)
        lists = self.lists(x)
        if len(lists) < need:
            return np.zeros(0, np.int64)
        lists = lists[np.argsort(self.count[lists], kind="stable")]
        aside = min(need - 1, int(need / (0.01 * np.log(1 + int(self.count[lists[-1]])) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        seen = self.merge(short)
        seen[x] = 0
        found = np.flatnonzero(seen >= max(1, need - aside))
        found = found[self.root[found] != self.root[x]]
        # the part of the long lists that is still missing, by size of both sets
        needed = -(-self.percent * (self.size[x] + self.size[found]) // (100 + self.percent))
        found = found[(seen[found] + aside >= needed) & (self.size[found] * 100 >= self.percent * self.size[x]) & (self.size[x] * 100 >= self.percent * self.size[found])]
        out = []
        for y in found:
            probe = long * np.int64(len(self.sets)) + y
            at = np.searchsorted(self.key, probe)
            at[at == len(self.key)] = 0
            both = int(seen[y]) + int((self.key[at] == probe).sum())
            if self.similar(x, y, both):
                out.append(y)
        return np.array(out, np.int64)

    def links(self) -> list[tuple[int, int]]:
        """Links that join components; all pairs of different components are searched."""
        n = len(self.sets)
        if n == 2:
            return [(0, 1)] if self.similar(0, 1, _overlap(*self.sets)) else []
        out = []
        self.index(np.arange(n))
        if n > 16:  # a large group of near copies is one star around any of its members
            for x in range(min(n, 8)):
                if self.find(x) == x:
                    both = self.merge(self.lists(x))
                    for y in np.flatnonzero(self.similar(x, np.arange(n), both)):
                        if self.join(x, int(y)):
                            out.append((x, int(y)))
            roots = np.array([self.find(i) for i in range(n)])
            big = np.bincount(roots).argmax()
            rest = np.flatnonzero(roots != big)
            self.root = roots
            if not len(rest):
                return out
            self.index(rest)
        for x in range(n):
            for y in self.partners(x):
                if self.join(x, int(y)):
                    out.append((x, int(y)))
            if x % 64 == 63 and n > 64:
                self.root = np.array([self.find(i) for i in range(n)])
        return out


def _bucket_links(words: int, percent: int):
    """Links inside each bucket; rows come as (leader, i, j, text), buckets together."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([longs(rows.column(c).combine_chunks()) for c in range(3)], 1)
        edges = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
        sets = [s for _, s in shingle_sets(*text_buffer(rows.column(3).combine_chunks()), words)]
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = {fingerprint(s): s for s in sets[a:b] if len(s)}
            ids, own = list(own), list(own.values())
            if len(own) > 1:
                out += [(ids[x], ids[y]) for x, y in Search(own, percent).links()]
        if out:
            pairs = np.array(out, np.int64)
            yield from batches(LINK, [pairs[:, 0], pairs[:, 1]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            held.append(part)
            if sum(p.num_rows for p in held) < 1000 and sum(p.nbytes for p in held) < CHUNK:
                continue
            whole = pa.Table.from_batches(held)
            key = np.stack([longs(whole.column(c).combine_chunks()) for c in range(3)], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1))
            if not len(cuts):
                continue
            yield from solve(whole.slice(0, int(cuts[-1]) + 1))
            held = whole.slice(int(cuts[-1]) + 1).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, n, f): size and fingerprint of every row's set; f is null for an empty one."""
    kind = dict(docs.dtypes)[id_col]
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))).mapInArrow(_signatures(words), f"id {kind}, n long, f long")


def _routes(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(leader, f) of every class that has to be compared in the leader's bucket.

    Similar classes share at least ``need`` posted tokens. A class with fewer
    shared tokens has no partner. Each class may put aside less than half of that
    number: two partners then still keep one token in common. It puts aside those
    of overlong lists, then those of the leaders it shares least with.
    """
    over = members.where("long").select("token").distinct()
    marked = members.join(over.withColumn("over", F.lit(1)), "token", "left")
    shared = marked.groupBy("f", "leader").agg(F.count("*").alias("c"), F.max(F.coalesce("over", F.lit(0))).alias("over")).join(classes, "f")
    need = F.floor(F.col("n") * percent / (100 * SLACK)) + 1
    running = W.partitionBy("f").orderBy(F.desc("over"), "c", "leader").rowsBetween(W.unboundedPreceding, 0)
    ranked = shared.withColumn("aside", F.sum("c").over(running)).withColumn("all", F.sum("c").over(W.partitionBy("f")))
    return ranked.where((F.col("all") >= need) & (F.col("aside") > F.floor((need - 1) / 2))).select("leader", "f")


def class_links(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between classes that span every component."""
    posted = spread(docs.select(F.col(text_col).alias("t"))).mapInArrow(_postings(words, percent), "token long, f long")
    members = stored(posted.repartition("token").sortWithinPartitions("token", "f").mapInArrow(_members(bucket), "token long, leader long, f long, long boolean"))
    classes = signed.where("f is not null").groupBy("f").agg(F.max("n").alias("n"), F.min("id").alias("id"))
    routes = stored(_routes(members, classes, percent))
    size = routes.groupBy("leader").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / bucket).cast("int")
    mine = F.pmod(F.xxhash64("f"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    dealt = routes.join(size, "leader").select("f", "leader", F.explode(pairs).alias("p"))
    by_doc = dealt.join(classes, "f").groupBy("id").agg(F.collect_list(F.struct("leader", "p.i", "p.j")).alias("at"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t"))
    sent = texts.join(by_doc, F.col("_id").eqNullSafe(F.col("id"))).select(F.explode("at").alias("r"), "t").select("r.leader", "r.i", "r.j", "t")
    return sent.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(_bucket_links(words, percent), "a long, b long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bucket: int = BUCKET) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    signed = stored(signatures(docs, id_col, text_col, words))
    named = components(class_links(docs, signed, id_col, text_col, words, percent, bucket), "a", "b", "f", "c")
    least = signed.where("f is not null").groupBy("f").agg(F.min("id").alias("least")).join(named, "f", "left").withColumn("c", F.coalesce("c", "f"))
    label = least.join(least.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("f", "component_id")
    return signed.join(label, "f", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join(table(spark, sf, "documents"))
