"""Jaccard join, suffix dedup, components, top-k: against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from lexmill.llm import jaccard_join as jaccard, suffix_dedup as suffix, topk
from lexmill.llm.components import components


def groups(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    rows = pairs + [(None, 1), (7, None), (3, 3)] + pairs[:5]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    want = groups([p for p in pairs if p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(2)
    vocabulary = [f"w{i}é" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 120]))
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w) + (" " + passage if g % 3 == 0 else ""))
    rows += ["", None, " \n\t", "one two", "ONE  two", "x", rows[0], rows[0].upper(), passage, "a b c d e", "a\tb\nc d  e"]
    return list(enumerate(rows))


@pytest.mark.parametrize("bucket", [2, 2048])
def test_jaccard_join(spark, near_copies, bucket):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in near_copies], "doc_id long, text string, token string, f long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df, bucket=bucket).collect()}
    sets = {i: shingles(t) for i, t in near_copies}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links)
    assert got == {i: (len(s), want.get(i, i)) for i, s in sets.items()}


def test_jaccard_join_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (0, "z")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0, None), (-1, 2, 1), (0, 1, 0), (1, 2, 1), (1, 2, 1)]
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_search_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = [np.unique(np.r_[base[: 80 - 4 * (i % 9)], rng.integers(0, 1 << 60, i % 30).astype(np.uint64)]) for i in range(40)] + [np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64)) for _ in range(10)]
    got = groups(jaccard.Search(sets).links())
    pairs = [(a, b) for a in range(50) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    assert got == groups(pairs)


def removed(rows, length):
    """Counts and digests by a plain scan; rows are in order."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone, new = bytearray(len(b)), []
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
            new.append(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(suffix, "RUN", 8)
    monkeypatch.setattr(suffix, "SEGMENT", 300)
    line = "the common line in all "
    texts = []
    for i in range(110):
        t = "".join(rng.choice("abé") for _ in range(rng.randint(0, 80)))
        if rng.random() < 0.7:
            t += line[rng.randint(0, 3) :] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))
        if i % 9 == 0:
            t = "x" * rng.randint(10, 60) + t
        texts.append(texts[rng.randrange(len(texts))] if i % 13 == 12 else t)
    texts += ["ab" * 900, "é" * 500, "\x00" * 40, None, ""]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, k string, _k long").repartition(4)
    got = suffix.suffix_dedup(df, length=20, gram=8, carry=("k",)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows, 20)
    assert {r.k for r in got} == {"c"} and all("�" not in r.kept for r in got)


def test_suffix_dedup_of_long_texts(spark):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2 * suffix.SEGMENT + 1000))
    seam = suffix.SEGMENT
    rows = [(1, text), (2, text[2 * seam - 30 : 2 * seam + 30] + "!")]
    got = suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), length=20, gram=8).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert got == removed(rows, 20) and got[0][2] == 0


def test_suffix_dedup_repeated_ids(spark):
    a, b = "q" * 5 + "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz!"
    rows = [(3, b), (3, a), (None, a), (None, None), (1, "short")]
    got = suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=20, gram=8).collect()
    ordered = [(None, None), (None, a), (1, "short"), (3, b), (3, a)]
    assert sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted((n, g, s) for _, n, g, _, s in removed(ordered, 20))
    assert suffix.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_sort_survives_collisions(monkeypatch):
    rows = np.array([[2, 3, 1, 4], [2, 3, 1, 1], [9, 1, 1, 1], [2, 3, 1, 4]], np.uint8)
    s = suffix.Suffixes(rows)
    s.hash[:] = 0  # every hash collides
    order, shared = s.sort(np.zeros(4, np.int64))
    assert [rows[i].tolist() for i in order] == sorted(rows.tolist()) and shared.tolist() == [-1, 3, 4, 0]


@pytest.mark.parametrize("cells", [(4096, 16_384), (2, 5)])
def test_top_k(spark, monkeypatch, cells):
    monkeypatch.setattr(topk, "QUERY_BLOCK", cells[0])
    monkeypatch.setattr(topk, "SHARD_ROWS", cells[1])
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=3), 1)], 1) for i in range(60)]
    rows += [(50, None, 1), (61, [1.0, None, 2.0], 1), (62, [float("nan"), 1.0, 1.0], 1), (63, [float("inf"), 0.0, 0.0], 1), (100, [1.0, 2.0], 1), (101, [1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (7, [5.0, 5.0, 5.0], 1), (64, [1e12, 0.0, 0.0], 1), (65, [0.5] * 3, 1), (66, [0.5] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk.top_k(df.where("vec_id % 10 = 0"), df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in ((i, v) for i, v in ok if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
