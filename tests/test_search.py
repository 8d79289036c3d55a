"""Search, kanji index, export, progress."""

import random

from pyspark.sql import functions as F

from lexmill import fixed
from lexmill.operators import facets as fc
from lexmill.operators import kanji as kj
from lexmill.operators import lexicon as lx
from lexmill.operators import search as se
from lexmill.operators.progress import fold_toggles, replace_progress
from lexmill.operators.variants import combine_choices, variant_forms
from lexmill.plans.build import ordered_lexicon
from lexmill.operators import gloss
from lexmill.plans.publish import export_tables
from lexmill.sources import sinks

import pytest

SCHEMA = (
    "entry_id string, doc_pos int, headword string, reading string, writings array<string>, readings array<string>, kanji array<string>,"
    " major string, level string, pos array<string>, transitivity string, conjugation string, cluster string, tags array<string>,"
    " glosses array<string>, freq_rank int, freq_count string, freq_pmw string, freq_pos string, ref_level string, translation string,"
    " translation_source string"
)


def row(i, word, reading, major=fixed.NOUN, pos=("noun (common)",), rank=None, kanji=None, gloss="x", level="A", trans="", cluster="c"):
    kanji = kanji if kanji is not None else [c for c in word if "一" <= c <= "鿿"]
    return (str(i), i, word, reading, [word], [reading], kanji, major, level, list(pos), trans, "", cluster, [], [gloss], rank, None, "1.5", "", "", None, None)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        row(1, "学校", "がっこう", rank=50, gloss="school"), row(2, "学", "がく", rank=900, gloss="learning"),
        row(3, "学校生活", "がっこうせいかつ", rank=5, gloss="school life"), row(4, "食べる", "たべる", fixed.VERB, ("Ichidan verb", "transitive verb"), 7, trans=fixed.TRANSITIVE, cluster="v"),
        row(5, "カード", "カード", rank=None, gloss="card 国"), row(6, "国学", "こくがく", rank=70), row(7, "雨", "あめ", rank=None),
    ]
    lex = ordered_lexicon(spark.createDataFrame(rows, SCHEMA)).cache()
    variants = spark.createDataFrame([("国", "國", 0), ("國", "国", 0), ("学", "學", 0), ("學", "学", 0)], "kanji string, variant string, ord int")
    docs = se.search_docs(lex, variants).cache()
    terms = se.search_terms(lex, variants).cache()
    return lex, docs, terms, variants


def ids(df):
    return [r["entry_id"] for r in df.collect()]


def test_tokens_and_scores(tables):
    lex, docs, terms, variants = tables
    def run(text, **kw):
        return [(r["entry_id"], r["score"]) for r in se.search(docs, terms, se.SearchRequest(text=text, **kw)).collect()]

    assert run("学校") == [("1", 40), ("3", 0)]
    assert run("ガッコウ")[0] == ("1", 32)
    assert run("gakkou")[0] == ("1", 30) and run("gakko")[0] == ("1", 30)
    assert run("学")[0] == ("2", 40) and dict(run("学"))["1"] == 20
    assert run("学校 zzz") == []
    assert run("國學") == [("6", 40)]
    assert run("kaado") == [("5", 30)]
    assert run("school") == [("3", 0), ("1", 0)]
    assert run("school", term_only=True) == []
    assert [i for i, _ in run("学校", manual_sort=True)] == ["3", "1"]


def test_facets_and_sorts(tables):
    lex, docs, terms, variants = tables
    find = lambda **kw: ids(se.search(docs, terms, se.SearchRequest(**kw), variants))
    assert find() == ["3", "4", "1", "6", "2", "7", "5"]
    assert find(major=fixed.VERB) == ["4"] and find(part_group="transitive_verb") == ["4"]
    assert find(kanji="学") == ["3", "1", "6", "2"]
    assert find(kanji="学", kanji_reading="がく") == ["6", "2"]
    assert find(kanji="校", kanji_reading="こう") == ["3", "1"]
    assert find(kanji="校", kanji_reading="う") == []
    assert find(transitivity=fixed.TRANSITIVE) == ["4"]
    assert find(major=fixed.NOUN, transitivity=fixed.TRANSITIVE) == ["3", "1", "6", "2", "7", "5"]
    assert find(sort="reading")[:2] == ["7", "5"]
    assert find(page=2, page_size=3) == ["6", "2", "7"] and find(page=9, page_size=3) == ["5"]
    assert sorted(find(sort="random", seed=1)) == sorted(find(sort="random", seed=2))


def test_collation(spark):
    df = spark.createDataFrame([(w,) for w in ["い", "ア", "あ", "漢", "か", "が"]], "w string")
    got = [r["w"] for r in df.orderBy(F.collate("w", "ja"), "w").collect()]
    assert set(got[:2]) == {"ア", "あ"} and got[2:] == ["い", "か", "が", "漢"]


def test_status(spark, tables):
    lex, docs, terms, variants = tables
    progress = spark.createDataFrame([("u", "1", "learned"), ("u", "2", "starred"), ("w", "3", "learned")], "user_id string, entry_id string, status string")
    find = lambda status: ids(se.search(docs, terms, se.SearchRequest(status=status), progress=progress, user_id="u"))
    assert find("learned") == ["1"] and find("starred") == ["2"] and find("unlearned") == ["3", "4", "6", "2", "7", "5"]


def test_batch_equals_single(spark, tables):
    lex, docs, terms, variants = tables
    texts = ["学校", "ガッコウ", "gakko", "学", "学校 zzz", "school life", "国", "card 国", "x", "た べ"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {}
    for r in se.batch_search(docs, terms, queries).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["entry_id"], r["score"]))
    for i, text in enumerate(texts):
        single = [(r["entry_id"], r["score"]) for r in se.search(docs, terms, se.SearchRequest(text=text)).collect()]
        assert got.get(i, []) == single, text


def test_variants(spark, tables):
    *_, variants = tables
    df = spark.createDataFrame([("国学",), ("abc",)], "run string")
    got = {r["run"]: r["forms"] for r in variant_forms(df, "run", variants).collect()}
    assert got == {"国学": ["国学", "国學", "國学", "國學"], "abc": ["abc"]}
    many = spark.createDataFrame([([["a", "1", "2"], ["b", "3"], ["c"], ["d", "4", "5", "6"], ["e", "7"]],)], "c array<array<string>>")
    forms = many.select(combine_choices(F.col("c")).alias("f")).first()["f"]
    assert forms[0] == "13c47" and "2bcde" in forms and "1bcde" in forms and len(forms) == 1 + 2 + 1 + 3 + 1


def test_kanji_index(spark, tables):
    lex, docs, terms, variants = tables
    facts = spark.createDataFrame([("学", fixed.JOYO_LABEL, "ガク", "まな.ぶ"), ("国", fixed.JOYO_LABEL, "コク", "くに")], "kanji string, status string, on_readings string, kun_readings string")
    tree = lx.kanji_tree(lex, facts)
    meta = {r["kanji"]: r for r in kj.kanji_metadata(tree).collect()}
    assert meta["学"]["noun_count"] == 3 and meta["学"]["on_readings"] == "ガク"
    assert [w["word"] for w in meta["学"]["sample_words"]] == ["学", "学校", "学校生活", "国学"]
    index = kj.kanji_index(lex, kj.kanji_metadata(tree)).cache()
    look = lambda q: [r["kanji"] for r in kj.search_kanji(index, q, variants).collect()]
    assert look("") [0] == "学" and look("學") == ["学"] and look("まなぶ") == [] and look("まな.ぶ") == ["学"]
    assert look("manabu") == ["学"] and look("koku") == ["国"]
    d = kj.kanji_detail(index, terms, lex, "学").first()
    assert d["count"] == 4 and d["on_readings"] == ["ガク"] and [e["entry_id"] for e in d["own_entries"]] == ["2"] and d["entry_readings"] == ["がく"]


def test_export(tables):
    lex, docs, terms, variants = tables
    out = export_tables(lex, lx.kanji_tree(lex, None))
    entry = {r["id"]: r for r in out["entries"].collect()}["1"]
    assert (entry["rank"], entry["pmw"], entry["word"], entry["kanji"]) == (50, 1.5, "学校", ["学", "校"])
    stats = {(r["facet"], r["value"]): r["n"] for r in out["stats"].collect()}
    assert stats[("major", fixed.NOUN)] == 6 and stats[("transitivity", fixed.TRANSITIVE)] == 1 and ("ref_level", "") not in stats
    tree = {(r["major"], r["cluster"]): (r["major_n"], r["n"]) for r in fc.category_tree(lex).collect()}
    assert tree == {(fixed.NOUN, "c"): (6, 6), (fixed.VERB, "v"): (1, 1)}
    s = fc.result_summary(lex.where("entry_id in ('1','4')")).first()
    assert (s["results"], s["majors"], s["kanji"]) == (2, 2, 3)


def sequential_fold(events):
    state = set()
    for user, entry, status, action, ts, seq in sorted(events, key=lambda e: (e[4], e[5])):
        if action == "clear":
            state = {s for s in state if s[0] != user}
        else:
            state ^= {(user, entry, status)}
    return state


EVENTS = "user_id string, entry_id string, status string, action string, ts int, seq int"


def random_events(n=120, seed=5):
    rng = random.Random(seed)
    return [(rng.choice("uvw"), rng.choice("123"), rng.choice(["starred", "learned"]), "clear" if rng.random() < 0.05 else "toggle", i // 3, i) for i in range(n)]


def test_progress_fold(spark):
    events = random_events()
    got = {tuple(r) for r in fold_toggles(spark.createDataFrame(events, EVENTS)).collect()}
    assert got == sequential_fold(events)
    current = spark.createDataFrame([("u", "1", "starred"), ("v", "2", "learned")], "user_id string, entry_id string, status string")
    imported = spark.createDataFrame([("u", "9", "learned"), ("u", "9", "learned")], "user_id string, entry_id string, status string")
    assert {tuple(r) for r in replace_progress(current, imported).collect()} == {("v", "2", "learned"), ("u", "9", "learned")}


def test_progress_stream(spark, tmp_path):
    from lexmill.streaming import progress as sp

    events = random_events(60, 9)
    for i in range(3):
        spark.createDataFrame(events[i * 20:(i + 1) * 20], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sp.log_events(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
    log = spark.read.schema(EVENTS).parquet(str(tmp_path / "log"))
    assert {tuple(r) for r in sp.current_progress(log).collect()} == sequential_fold(events)
    q = sp.stream_parity(stream).writeStream.outputMode("complete").format("memory").queryName("parity").trigger(availableNow=True).start()
    q.awaitTermination(120)
    plain = [e for e in events if e[3] == "toggle"]
    got = {(r["user_id"], r["entry_id"], r["status"]) for r in spark.table("parity").where("is_set").collect()}
    assert got == sequential_fold(plain)


def test_translation_stream(spark, tmp_path):
    from lexmill.streaming import translations as st

    schema = "entry_id string, translation array<string>, source string, created_at int, seq int"
    for i, rows in enumerate([[("1", ["a"], "s", 1, 1), ("1", ["b"], "s", 2, 2)], [("2", ["c"], None, 3, 3), ("1", ["d"], "s", 4, 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    st.log_records(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "log"))
    lex = spark.createDataFrame([("1",), ("2",), ("3",)], "entry_id string")
    got = {r["entry_id"]: (r["translation"], r["translation_source"]) for r in st.current_overrides(lex, log, "label").collect()}
    assert got == {"1": ("d", "s"), "2": ("c", "label")}


def test_export_meta_and_counters(spark, tmp_path):
    one = lambda text, schema: spark.createDataFrame(text, schema)
    tables = {"entries": one([("a",), ("b",)], "entry_id string"), "kanji_index": one([("学", 2)], "kanji string, count int"),
              "clusters": one([], "major string, cluster string, count long"), "stats": one([("level", "A", 2)], "facet string, value string, count int")}
    sinks.write_app_tables(tables, str(tmp_path), {"master": "m.csv"})
    meta = spark.read.json(f"{tmp_path}/meta").first()
    assert (meta.entries, meta.kanji, meta.source.master) == (2, 1, "m.csv") and meta.generated_at
    sinks.write_app_tables(tables, f"{tmp_path}/plain")
    assert spark.read.json(f"{tmp_path}/plain/meta").first().entries == 2
    outcomes = one([(o,) for o in ("translated", "queued", "queued", "skipped", "preserved")], "outcome string")
    assert tuple(gloss.outcome_counters(outcomes).first()) == (3, 1, 2, 1)
    assert tuple(gloss.outcome_counters(outcomes.limit(0)).first()) == (0, 0, 0, 0)
