"""The pipeline's stages, each against a plain version on its own input."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline
from lexmill.llm import pieces, suffix_dedup
from test_pairs import groups, shingles
from test_texts import plain_counts


def plain_cut(rows, length):
    """Texts without the bytes of strings that start earlier."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = text.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdéfgh", k=rng.randint(2, 8))) for _ in range(500)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for i in range(70):
        words = rng.choices(vocabulary, k=rng.randint(60, 140))
        rows.append((i, " ".join(words) + (f" {passage}" if i % 7 == 0 else ""), "en", f"s{i % 2}"))
        if i % 10 == 0:
            words[5] = "changed"
            rows.append((100 + i, " ".join(words) + (f" {passage}" if i % 7 == 0 else ""), "en", "s0"))
    rows += [(200, "too short", "en", "s0"), (201, None, None, None), (202, "a b c " * 80, "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    frames = [docs]
    for _, stage in pipeline.STAGES:
        frames.append(suffix_dedup.stored(stage(spark, frames[-1], "")))
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    assert all(f.columns == list(pipeline.COLUMNS) for f in frames[1:-1])

    def base_fails(text):
        n, *_, repeats = plain_counts(text)
        return n < 50 or 100 * repeats > 50 * n

    assert set(texts[1]) == {i for i, t in texts[0].items() if not base_fails(t)}
    sets = {i: shingles(t) for i, t in texts[1].items()}
    root = groups([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert set(texts[2]) == {i for i in sets if root.get(i, i) == i} and len(texts[2]) < len(texts[1])
    assert texts[3] == plain_cut(texts[2].items(), suffix_dedup.LENGTH) and texts[3] != texts[2]
    assert set(texts[4]) <= set(texts[3]) and all(texts[4][i] == texts[3][i] for i in texts[4]) and len(texts[4]) > len(texts[3]) // 2
    model = pieces.Pieces(pieces.model_path())
    for r in frames[-1].collect():
        assert r.ids == model.encode([texts[4][r.doc_id]])[0].tolist() and r.round_trip
    assert {r.doc_id for r in frames[-1].collect()} == set(texts[4])


def test_empty_and_whole(spark, sf):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    out = pipeline.run(spark, sf)
    assert out.count() > 50 and out.where("not round_trip").count() == 0
