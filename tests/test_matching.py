"""Level matching and example matching."""

import random

from pyspark.sql import functions as F

from lexmill import fixed
from lexmill.operators import examples as ex
from lexmill.operators import levels as lv
from lexmill.operators.common import find_terms
from lexmill.plans.match import match_levels

LEX = "entry_id string, headword string, reading string, writings array<string>, readings array<string>, level string, major string, glosses array<string>"


def lexicon(spark):
    rows = [
        ("1", "学校", "がっこう"), ("2", "橋", "はし"), ("3", "箸", "はし"), ("4", "雨", "あめ"), ("5", "空", "そら"),
        ("6", "本", "ほん"), ("7", "本", "もと"),
    ]
    return spark.createDataFrame(
        [(i, w, r, [w], [r], "A", fixed.NOUN, ["g"]) for i, w, r in rows], LEX
    )


LISTS = "level string, q string, a string, source_file string, source_url string, line_ord int"


def test_tiers(spark):
    lists = spark.createDataFrame(
        [
            ("N5", "学校", "ガッコウ", "n5", "u5", 1), ("N3", "学校", "がっこう", "n3", "u3", 2),
            ("N5", "はし", "はし", "n5", "u5", 3), ("N4", "あめ", "あめ", "n4", "u4", 4),
            ("N4", "空", "から", "n4", "u4", 5), ("N1", "無", "む", "n1", "u1", 6), ("N2", "本", "ぽん", "n2", "u2", 7),
        ],
        LISTS,
    )
    meanings = spark.createDataFrame([("N5", "学校", "school", 1), ("N5", "学 校", "later", 2)], "level string, q string, a string, line_ord int")
    out = match_levels(lexicon(spark), lists, meanings)
    got = {r["writing"]: r for r in out["decided"].collect()}
    assert {w: (r["rule"], r["confidence"]) for w, r in got.items()} == {
        "学校": ("exact_writing_reading", "high"), "はし": ("reading_only_multiple", "ambiguous"),
        "あめ": ("reading_only_unique", "medium"), "空": ("writing_only_unique", "low"), "無": ("unmatched", "none"),
        "本": ("writing_only_multiple", "ambiguous"),
    }
    merged = got["学校"]
    assert (merged["level"], merged["source_file"], merged["source_url"], merged["meaning"]) == ("N5", "n5;n3", fixed.LEVEL_SOURCE_PAGE, "school")
    split = [out[k].select("writing").distinct().count() for k in ("matches", "ambiguous", "unmatched")]
    assert split == [3, 2, 1] and sum(split) == len(got)
    assert out["ambiguous"].count() == 4
    preview = {r["entry_id"]: (r["ref_level"], r["ref_confidence"]) for r in out["preview"].collect()}
    assert preview == {"1": ("N5", "high"), "4": ("N4", "medium")}
    counts = {r["level"]: (r["candidates"], r["matched"], r["matched_high_medium"]) for r in out["level_counts"].collect()}
    assert counts["N5"] == (2, 1, 1) and counts["N4"] == (2, 2, 1)
    assert {(r["measure"], r["value"]): r["n"] for r in out["outcome_counts"].collect()}[("confidence", "ambiguous")] == 2


def test_order_does_not_matter(spark):
    rng = random.Random(7)
    rows = [(f"N{rng.randint(1, 5)}", rng.choice("あいうえお"), rng.choice("あいうえお"), f"f{i % 3}", "u", i) for i in range(80)]
    a = spark.createDataFrame(rows, LISTS)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    b = spark.createDataFrame(shuffled, LISTS).repartition(5)
    key = lambda df: sorted(map(str, df.collect()))
    one, two = (lv.dedupe_candidates(lv.with_keys(lv.expand_candidates(x))) for x in (a, b))
    assert key(one) == key(two)


def test_substring_join_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abcあい𠮟 ") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    terms = sorted({"".join(rng.choice("abcあい𠮟") for _ in range(rng.randint(1, 4))) for _ in range(60)})
    found = find_terms(
        spark.createDataFrame(texts, "id int, text string"), ["id"], "text", spark.createDataFrame([(t,) for t in terms], "term string")
    )
    expected = {(i, t) for i, text in texts for t in terms if t in text}
    rows = [(r["id"], r["term"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_examples(spark):
    lex = spark.createDataFrame(
        [("1", "学校", ["学校"], fixed.NOUN, [], 5, "A"), ("2", "学校", ["学校"], fixed.NOUN, [], None, "A"), ("3", "向かう", ["向かう"], fixed.VERB, ["Godan verb"], 9, "B")],
        "entry_id string, headword string, writings array<string>, major string, pos array<string>, freq_rank int, level string",
    )
    s = spark.createDataFrame(
        [("10", "私は学校へ行きます"), ("11", "学校です。それは学校ですよ、ほんとうに。いいえ。"), ("12", "学校は遠いので歩いて向かった。"), ("13", "短い")],
        "sentence_id string, text string",
    )
    t = spark.createDataFrame([("20", "我去学校上学去了"), ("21", "去学校上学"), ("22", "学"), ("23", "这是学校，那是学校。")], "sentence_id string, text string")
    links = spark.createDataFrame(
        [("10", "20", 1), ("10", "21", 2), ("10", "22", 3), ("11", "23", 4), ("12", "21", 5), ("13", "21", 6)], "src string, dst string, line_ord int")
    pairs = ex.linked_sentences(s, t, links)
    assert {r["sentence_id"]: r["translation_id"] for r in pairs.collect()} == {"10": "21", "11": "23", "12": "21"}
    found = ex.match_examples(pairs, ex.entry_terms(lex)).collect()
    got = {(r["entry_id"], r["rank_in_entry"]): r["sentence_id"] for r in found}
    assert got == {("1", 1): "11", ("1", 2): "12", ("2", 1): "11", ("2", 2): "12", ("3", 1): "12"}
    assert {r["term"] for r in found if r["entry_id"] == "3"} == {"向かった"}
    totals = ex.example_totals(ex.match_examples(pairs, ex.entry_terms(lex, ["A"]))).first()
    assert (totals["covered_entries"], totals["examples"]) == (2, 4)
    shown = ex.attach_examples(lex.select("entry_id"), ex.match_examples(pairs, ex.entry_terms(lex)), 1)
    assert all(len(r["examples"]) == 1 for r in shown.collect())
