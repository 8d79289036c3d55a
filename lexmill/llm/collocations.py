"""Phrase collocations: n-grams found by Rabin-Karp fingerprints.

A text is lower-cased (A-Z), split at marks into pieces and at blanks into words.
Prefix polynomials over the bytes of a stretch of text give every word's hash,
prefix polynomials over the words' hashes every n-gram's fingerprint, which also
holds the language. Per length, tasks count their fingerprints, the shuffle adds
the counts, and fingerprints below the threshold go. An n-gram is counted only if
both n-grams one word shorter passed a filter of the frequent ones: a set of bits
of bounded size, which may let too much through and never too little.

Fingerprints only choose. In the last pass an occurrence whose fingerprint
passes points to its place in the text; each task compares the bytes behind the
pointers of a fingerprint with those of the first (others are counted by their
own text), and only then writes the phrase out. Counts of equal phrases are added
up, so a collision costs time and changes no count.

Defined cases: null and empty texts have no words; a null language is ``und``
(and pooled with that name); rows with equal or null ids are documents each; ties
in score and count go by the phrase's bytes; an empty table gives no rows; a very
long text is hashed in stretches, a word is held whole. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import Powers, U, mix, pieces, ranges, stored, table, text_buffer
from lexmill.operators.common import broadcast_if_small, first_n

LONGEST = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
COVERED = 80
UNKNOWN = "und"
MARKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

STRETCH = 1 << 21
FILTER_BITS = 1 << 27
HELD = 1 << 21
SPLITS = 8
PROBES = 3
WORD_BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POWERS = {WORD_BASE: Powers(WORD_BASE), GRAM_BASE: Powers(GRAM_BASE)}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(MARKS)] = 2


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial of the values and the powers that shift a difference to place 0."""
    up, down = _POWERS[base].to(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out, down


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends, pieces and documents of all words."""
    low = _LOWER[buffer[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    kind = _KIND[low]
    inside = np.zeros(len(low) + 2, np.bool_)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    borders = np.unique(offsets[1:-1])
    borders = borders[(borders > 0) & (borders < len(low))]
    borders = borders[inside[borders] & inside[borders + 1]]
    if len(borders):  # a text that ends in a word, next to one that begins with a word
        starts, ends = np.sort(np.r_[starts, borders]), np.sort(np.r_[ends, borders])
    doc = np.searchsorted(offsets, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts) + doc
    return low, starts, ends, piece, doc


class Stretch:
    """Consecutive words of a buffer and the fingerprints of their n-grams."""

    def __init__(self, low, starts, ends, piece, langs, own: int, mask: int):
        self.own, self.piece, self.langs, self.mask = own, piece, langs, U(mask)
        base = starts[0]
        hashed, down = _prefix(low[base : ends[-1]].astype(U) + U(1), WORD_BASE)
        self.words = mix((hashed[ends - base] - hashed[starts - base]) * down[starts - base])
        self.prefix, self.down = _prefix(self.words, GRAM_BASE)

    def whole(self, k: int) -> np.ndarray:
        """Which places begin k words of one piece."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[k - 1 : k - 1 + n] == self.piece[:n]

    def prints(self, k: int, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the k words from each place."""
        polynomial = (self.prefix[at + k] - self.prefix[at]) * self.down[at]
        return mix(polynomial + self.langs[at] * U(2 * k + 1)) & self.mask

    def frequent(self, k: int, filters: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, fingerprints) of n-grams whose shorter n-grams pass the filter of their length."""
        whole = np.flatnonzero(self.whole(k))
        if k > 1 and len(whole):
            shorter = np.flatnonzero(self.whole(k - 1))
            passed = np.zeros(len(self.piece) + 1, np.bool_)
            passed[shorter[contained(filters[k - 1], self.prints(k - 1, shorter))]] = True
            whole = whole[passed[whole] & passed[whole + 1]]
        whole = whole[whole < self.own]
        return whole, self.prints(k, whole)


def stretches(low, starts, ends, piece, langs, mask: int, size: int = STRETCH) -> Iterator[tuple[int, Stretch]]:
    """Words in runs of about ``size`` bytes; a run also holds the words that its last n-grams need."""
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size)))
        t = min(n, j + LONGEST - 1)
        yield i, Stretch(low, starts[i:t], ends[i:t], piece[i:t], langs[i:t], j - i, mask)
        i = j


# -- filters of frequent fingerprints --------------------------------------------------


def _places(prints: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return mix(prints + U(0xA0761D6478BD642F * (probe + 1) & ((1 << 64) - 1))) & U(bits - 1)


def contained(words_of: np.ndarray, prints: np.ndarray) -> np.ndarray:
    ok = np.arange(len(prints))
    for probe in range(PROBES):
        at = _places(prints[ok], 64 * len(words_of), probe)
        ok = ok[(words_of[at >> U(6)] >> (at & U(63))) & U(1) == 1]
    out = np.zeros(len(prints), np.bool_)
    out[ok] = True
    return out


def _set_bits(bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prints = part.column(0).to_numpy().astype(np.int64).view(U)
            at = np.unique(np.concatenate([_places(prints, bits, probe) for probe in range(PROBES)]))
            word, first = np.unique(at >> U(6), return_index=True)
            value = np.bitwise_or.reduceat(U(1) << (at & U(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    return run


def filter_of(prints: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """Set of bits of a stored column of fingerprints; its size follows their number up to ``most`` bits."""
    bits = min(most, 1 << max(16, (16 * prints.count()).bit_length()))
    rows = prints.mapInArrow(_set_bits(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, U)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(U)
    return out


# -- passes over the texts ---------------------------------------------------------------


def _lang_hashes(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    coded = pc.fill_null(column, UNKNOWN).dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in names], U)
    return names, hashes, coded.indices.to_numpy()


def _stretches_of(part: pa.RecordBatch, mask: int):
    """(names, word arrays, language code per word, first word, stretch) of every stretch of a batch."""
    names, hashes, codes = _lang_hashes(part.column(0))
    buffer, offsets = text_buffer(part.column(1))
    low, starts, ends, piece, doc = words(buffer, offsets)
    lang = codes[doc]
    for first, stretch in stretches(low, starts, ends, piece, hashes[lang], mask):
        yield names, (low, starts, ends), lang, first, stretch


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    prints = np.concatenate([p for p, _ in held])
    order = np.argsort(prints)
    prints = prints[order]
    first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
    return prints[first], np.add.reduceat(np.concatenate([c for _, c in held])[order], first)


def _count(k: int, filters: dict[int, Broadcast], mask: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        got = {n: b.value for n, b in filters.items()}

        def out(prints, counts):
            for i in range(0, len(prints), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(prints[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], names=["print", "n"])

        for part in pieces(parts, 1, STRETCH):
            for *_, stretch in _stretches_of(part, mask):
                prints, counts = np.unique(stretch.frequent(k, got)[1], return_counts=True)
                held.append((prints, counts.astype(np.int64)))
                size += len(prints)
                if size > 2 * HELD:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD:
                        yield from out(*held[0])
                        held, size = [], 0
        if size:
            yield from out(*_merged(held))

    return run


def joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one blank between them, and their places there."""
    sizes = ends - starts
    new_ends = np.cumsum(sizes + 1) - 1
    text = np.full((int(new_ends[-1]) if len(sizes) else 0) + 9, 32, np.uint8)  # spare bytes for lanes
    text[ranges(new_ends - sizes, sizes)] = low[ranges(starts, sizes)]
    return text, new_ends - sizes, new_ends


def _lanes(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of a buffer that ends in eight spare bytes."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))


_LANE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def equal_bytes(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of ``left`` from each a equal those of ``right`` from each b, over ``sizes`` bytes."""
    x, y = _lanes(left), _lanes(right)
    out, at, j = np.ones(len(a), np.bool_), np.arange(len(a)), 0
    while len(at := at[sizes[at] > j]):
        differ = (x[a[at] + j] ^ y[b[at] + j]) & _LANE_MASKS[np.minimum(8, sizes[at] - j)]
        out[at[differ != 0]] = False
        j += 8
    return out


class Phrases:
    """Phrases of one task: fingerprints point to bytes kept once, counts are of equal bytes only."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.prints, self.slots = np.zeros(0, U), np.zeros(0, np.int64)
        self.offsets, self.k, self.lang, self.n = (np.zeros(m, np.int64) for m in (1, 0, 0, 0))
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.odd: Counter = Counter()

    def __len__(self) -> int:
        return len(self.n) + len(self.odd)

    def _keep(self, prints, starts, sizes, k, lang, text) -> None:
        """New fingerprints with the bytes of their first occurrence."""
        used = int(self.offsets[-1])
        need = used + int(sizes.sum()) + 8
        if need > len(self.bytes):
            self.bytes = np.r_[self.bytes[:used], np.zeros(2 * need - used, np.uint8)]
        self.bytes[used : need - 8] = text[ranges(starts, sizes)]
        slots = np.arange(len(self.n), len(self.n) + len(prints))
        at = np.searchsorted(self.prints, prints)
        self.prints, self.slots = np.insert(self.prints, at, prints), np.insert(self.slots, at, slots)
        self.offsets = np.r_[self.offsets, used + np.cumsum(sizes)]
        self.k, self.lang, self.n = np.r_[self.k, k], np.r_[self.lang, lang], np.r_[self.n, np.zeros(len(prints), np.int64)]

    def add(self, prints, starts, sizes, k, lang, text) -> None:
        """Count occurrences: each meets the bytes its fingerprint points to; those that differ count by their own."""
        found, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
        at = np.searchsorted(self.prints, found)
        new = first[self.prints[np.minimum(at, len(self.prints) - 1)] != found] if len(self.prints) else first
        if len(new):
            self._keep(prints[new], starts[new], sizes[new], k[new], lang[new], text)
        slot = self.slots[np.searchsorted(self.prints, found)][inverse]
        same = (sizes == self.offsets[slot + 1] - self.offsets[slot]) & (k == self.k[slot]) & (lang == self.lang[slot])
        same[same] = equal_bytes(text, starts[same], self.bytes, self.offsets[slot[same]], sizes[same])
        self.n += np.bincount(slot[same], minlength=len(self.n))
        for i in np.flatnonzero(~same).tolist():
            self.odd[int(lang[i]), int(k[i]), text[starts[i] : starts[i] + sizes[i]].tobytes()] += 1

    def rows(self, names: list[str], size: int = 100_000) -> Iterator[pa.RecordBatch]:
        """Batches of (lang, k, phrase, n)."""
        langs, columns = pa.array(names, pa.string()), ["lang", "k", "phrase", "n"]
        for i in range(0, len(self.n), size):
            j = min(len(self.n), i + size)
            own = self.bytes[self.offsets[i] : self.offsets[j]]
            phrases = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(self.offsets[i : j + 1] - self.offsets[i]), pa.py_buffer(own)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(self.lang[i:j])), pa.array(self.k[i:j].astype(np.int32)), phrases, pa.array(self.n[i:j])], names=columns)
        odd = list(self.odd.items())
        for i in range(0, len(odd), size):
            keys, counts = zip(*odd[i : i + size], strict=True)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array([x[0] for x in keys])), pa.array([x[1] for x in keys], pa.int32()), pa.array([x[2] for x in keys], pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=columns)


def _materialise(filters: dict[int, Broadcast], mask: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {n: b.value for n, b in filters.items()}
        held, codes, sizes = Phrases(), {}, Counter()
        for part in pieces(parts, 1, STRETCH):
            for names, (low, starts, ends), lang, first, stretch in _stretches_of(part, mask):
                mine = np.array([codes.setdefault(x, len(codes)) for x in names])[lang[first : first + len(stretch.piece)]]
                sizes.update(dict(zip(*(x.tolist() for x in np.unique(mine[: stretch.own], return_counts=True)), strict=True)))
                text, s, e = joined(low, starts[first : first + len(mine)], ends[first : first + len(mine)])
                places = []
                for k in got:
                    at, prints = stretch.frequent(k, got)
                    ok = contained(got[k], prints)
                    at = at[ok]
                    places.append((prints[ok], s[at], e[at + k - 1] - s[at], np.full(len(at), k), mine[at]))
                held.add(*(np.concatenate(x) for x in zip(*places, strict=True)), text)
            if len(held) > HELD // 2 or held.offsets[-1] > 48 * HELD:
                yield from held.rows(list(codes))
                held.clear()
        yield from held.rows(list(codes))
        if sizes:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(codes)).take(pa.array(list(sizes))), pa.array([0] * len(sizes), pa.int32()), pa.array([""] * len(sizes)), pa.array(list(sizes.values()), pa.int64())], names=["lang", "k", "phrase", "n"])

    return run


def phrases_written(texts: DataFrame, filters: dict[int, Broadcast], mask: int) -> DataFrame:
    """(lang, k, phrase, n) counted per task; a phrase comes once a task (or once each time a task's store is full).

    A frequent phrase stands in nearly every split of the texts, so a task reads
    up to ``SPLITS`` of them in turn, as long as every core has a task.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    few = texts.coalesce(max(cores, -(-texts.rdd.getNumPartitions() // SPLITS)))
    return few.mapInArrow(_materialise(filters, mask), "lang string, k int, phrase string, n long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
                     filter_bits: int = FILTER_BITS, print_bits: int = 64) -> DataFrame:
    """(lang, k, phrase, n) of every phrase of up to ``longest`` words met ``least`` times or more in its language.

    Rows with k = 0 hold the number of words of a language. ``print_bits``
    shortens fingerprints, which makes collisions common and changes no row.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    mask, filters = (1 << print_bits) - 1, {}
    for k in range(1, longest + 1):
        counted = texts.mapInArrow(_count(k, {k - 1: filters[k - 1]} if k > 1 else {}, mask), "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))
        filters[k] = docs.sparkSession.sparkContext.broadcast(filter_of(stored(counted.where(F.col("n") >= least).select("print")), filter_bits))
    return stored(phrases_written(texts, filters, mask).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0)))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 scale: int = SCALE, covered: int = COVERED, filter_bits: int = FILTER_BITS, print_bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases by their weakest cut."""
    counts = frequent_phrases(docs, text_col, lang_col, least, longest, filter_bits, print_bits)
    phrases = counts.where("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"))
    part = lambda start, size: F.array_join(F.slice("_w", start, size), " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda start: F.array_join(F.slice("_w", start, size), " "))))
    longer = phrases.where("k >= 3").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    free = phrases.join(longer, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("_longer") < F.lit(covered).cast("decimal(3,0)") * F.col("a"))).drop("_longer")
    cuts = free.select("lang", "phrase", "a", "k", "_w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("_cut"))
    cuts = cuts.select("lang", "phrase", "a", "_cut", part(F.lit(1), F.col("_cut")).alias("_first"), part(F.col("_cut") + 1, F.col("k") - F.col("_cut")).alias("_rest"))
    known = broadcast_if_small(counts.where("k >= 1").select("lang", F.col("phrase").alias("_part"), F.col("n").alias("_n")))
    for side, name in (("_first", "l"), ("_rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("_part").alias(side), F.col("_n").alias(name)), ["lang", side])
    # A count has at most 20 digits and the scale 18, so the product is exact; the quotient is at most half the scale.
    scored = cuts.withColumn("score", F.expr(f"(cast({scale} as decimal(18,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "_cut", "a", "l", "r")).alias("_m")).select("lang", "phrase", "_m.a", "_m.l", "_m.r", "_m.score")
    ranked = first_n(weakest, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], top, "rank")
    sizes = counts.where("k = 0").select("lang", "n")
    return ranked.join(broadcast_if_small(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    out = collocations(table(spark, sf, "documents"))
    return out.withColumn("rank", F.col("rank").cast("long"))


OP12_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k))
), c AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS n FROM g GROUP BY ALL),
f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE n >= {LEAST}),
s AS (
  SELECT lang, n, k, ws, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM f WHERE k >= 3)
), m AS (SELECT lang, array_to_string(ws[i : i + size - 1], ' ') AS phrase, max(n) AS longer FROM s GROUP BY ALL),
free AS (SELECT f.* FROM f LEFT JOIN m USING (lang, phrase) WHERE k >= 2 AND (longer IS NULL OR 100 * longer < {COVERED} * n)),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM free),
scored AS (
  SELECT u.lang, u.phrase, u.n AS a, a1.n AS l, a2.n AS r, u.cut, {SCALE}::HUGEINT * u.n // (a1.n + a2.n) AS score
  FROM cuts u JOIN f a1 ON a1.lang = u.lang AND a1.phrase = array_to_string(u.ws[1 : u.cut], ' ')
  JOIN f a2 ON a2.lang = u.lang AND a2.phrase = array_to_string(u.ws[u.cut + 1 : u.k], ' ')
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest),
total AS (SELECT lang, sum(n) AS n FROM c WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
