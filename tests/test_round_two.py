"""Substring join, budget, replies, readers, variants and searches on edge cases."""

import random

from pyspark.sql import functions as F

from lexmill.operators import common, gloss as gl, search as se, translate as tr
from lexmill.operators.variants import variant_forms, variant_rows
from lexmill.sources import readers, sinks


def test_terms_are_found_by_code_points(spark):
    texts = spark.createDataFrame([(1, "x𠮟ab"), (2, "𠮟る!"), (3, ""), (4, None), (5, "る𠮟る")], "id int, text string")
    terms = spark.createDataFrame([("?ab", 1), ("?る", 2), ("𠮟る", 3), ("ab", 4), ("", 5), ("る", 6), ("る", 7)], "term string, entry int")
    got = sorted((r.id, r.term, r.entry) for r in common.find_terms(texts, ["id"], "text", terms).collect())
    assert got == [(1, "ab", 4), (2, "る", 6), (2, "る", 7), (2, "𠮟る", 3), (5, "る", 6), (5, "る", 7), (5, "𠮟る", 3)]
    assert common.find_terms(texts, ["id"], "text", terms.limit(0)).count() == 0


def test_terms_equal_a_plain_search(spark):
    rng = random.Random(6)
    letters = "abé𠮟"
    texts = [(i, "".join(rng.choices(letters, k=rng.choice([3, 40, 700])))) for i in range(30)]
    terms = {"".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(80)} | {texts[9][1][5:305]}
    got = {(r.id, r.term) for r in common.find_terms(spark.createDataFrame(texts, "id int, t string"), ["id"], "t", spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(i, t) for i, text in texts for t in terms if t in text}


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    got = common.running_totals(spark.createDataFrame(rows, "k int, v int").repartition(7, "v"), ["k"], {"before": F.col("v")}).collect()
    assert {r.k: r.before for r in got} == {k: sum(v for _, v in rows[:k]) for k, _ in rows}


def test_budget_beyond_an_int(spark):
    rows = spark.createDataFrame([(i % 3, 1 + i % 5, f"e{i:03}") for i in range(200)], "p int, size int, id string")
    kept = tr.within_budget(rows, "p", "size", ["p", "size", "id"], budget=2**33)
    assert kept.count() == 200
    few = tr.within_budget(rows, "p", "size", ["p", "size", "id"], budget=50)
    want, spent = [], 0
    for p, size, i in sorted((i % 3, 1 + i % 5, f"e{i:03}") for i in range(200)):
        if spent + size > 50:
            break
        want.append(i)
        spent += size
    assert sorted(r.id for r in few.collect()) == sorted(want)


def test_replies_fall_through(spark):
    body = '[{"id":"a","translation":"","translations":["y"]},{"id":"b","translation":null,"translations":"z"},{"id":"c","translation":[],"translations":["w"]},{"id":"d","translation":"p","translations":["q"]},{"id":"e"}]'
    got = {r.entry_id: r.translation for r in tr.parse_replies(spark.createDataFrame([(1, body)], "batch int, content string")).collect()}
    assert got == {"a": ["y"], "b": ["z"], "c": ["w"], "d": ["p"]}


def test_sentence_quotes(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('1\tjpn\t"He said ""hi"" now."\n2\tjpn\tplain "inside" text\n3\tjpn\t"open quote only\n4\tjpn\t back\\slash \n', encoding="utf-8")
    got = {r.sentence_id: r.text for r in readers.read_sentences(spark, str(path)).collect()}
    assert got["1"] == 'He said "hi" now.' and got["2"] == 'plain "inside" text' and got["4"] == "back\\slash"
    assert got["3"] in ("open quote only", '"open quote only')


def test_study_lists_come_back(spark, tmp_path):
    rows = [("u1", "e1", "starred"), ("u1", "e2", "learned"), ("u2", "e1", "learned")]
    sinks.write_study_data(spark.createDataFrame(rows, "user_id string, entry_id string, status string"), str(tmp_path / "own"))
    own = {(r.entry_id, r.status) for r in readers.read_study_data(spark, str(tmp_path / "own")).collect()}
    assert own == {("e1", "starred"), ("e2", "learned"), ("e1", "learned")}
    (tmp_path / "one.json").write_text('{"progress": {"starred": ["x", ""], "learned": ["y"]}}')
    one = {(r.entry_id, r.status) for r in readers.read_study_data(spark, str(tmp_path / "one.json")).collect()}
    assert one == {("x", "starred"), ("y", "learned")}


def test_blank_kanji_reading_matches_nothing(spark):
    docs = spark.createDataFrame([("1", ["学校"], ["がっこう"], ["学", "校"])], "entry_id string, writing_forms array<string>, reading_forms array<string>, kanji array<string>")
    find = lambda reading: se.matching(docs, se.SearchRequest(kanji="学", kanji_reading=reading)).count()
    assert find("-") == 0 and find("がっ") == 1 and find("こう") == 0


def test_doubled_marks_become_one(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert df.select(gl._finish(F.lit("a；; b"), F.lit("")).alias("t")).first()["t"] == "a；b"


def test_variants_without_a_limit(spark):
    runs = spark.createDataFrame([("学国会",), ("食",)], "run string")
    pairs = [(k, f"{k}{i}", i) for k in "学国会" for i in range(3)]
    variants = spark.createDataFrame(pairs, "kanji string, variant string, ord int")
    got = {r["run"]: (len(r.forms), r.whole) for r in variant_forms(runs, "run", variants).collect()}
    assert got == {"学国会": (1 + 9, False), "食": (1, True)}
    free = {r["run"]: (set(r.forms), r.whole) for r in variant_forms(runs, "run", variants, limit=None).collect()}
    rows = variant_rows(runs, "run", variants).collect()
    assert len(rows) == 65 and free["学国会"][1] and {r.form for r in rows if r["run"] == "学国会"} == free["学国会"][0]


def test_compatibility_forms(spark):
    """Every character that NFKC changes, alone and in pairs that compose, is seen as such."""
    import re
    import unicodedata

    texts = [chr(c) for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xF900, 0x10000)] + ["か\u3099", "e\u0301", "ｶﾞ", "Ａｂ", "ﬁ", "①", "学校 abc é"]
    stable = re.compile(common.NFKC_STABLE)
    assert not [t for t in texts if stable.match(t) and unicodedata.normalize("NFKC", t) != t]
    pairs = [a + b for a in "eかガ学ᄀ" for b in map(chr, range(0x300, 0x3200)) if unicodedata.normalize("NFKC", a + b) != a + b]
    assert not [p for p in pairs if stable.match(p)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.t for r in common.with_nfkc(df, "t").collect()}
    assert got == {i: unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)} | {-1: None}


def test_search_tables_with_wide_forms(spark):
    rows = [("1", "Ｔｅｓｔ学", "ｶﾞｯｺｳ", ["Ｔｅｓｔ学"], ["ｶﾞｯｺｳ"], ["学"]), ("2", "学校", "がっこう", ["学校"], ["がっこう"], ["学", "校"])]
    lex = spark.createDataFrame(rows, "entry_id string, headword string, reading string, writings array<string>, readings array<string>, kanji array<string>")
    terms = {(r.entry_id, r.kind, r.term) for r in se.search_terms(lex).collect()}
    assert {("1", "writing", "test学"), ("1", "reading", "がっこう"), ("2", "writing", "学校"), ("2", "reading", "がっこう"), ("2", "kanji", "校")} <= terms
