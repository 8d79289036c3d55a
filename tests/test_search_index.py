"""Stored search index and pages: same rows as the plain search, read from few parts and few postings."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill import fixed
from lexmill.operators import paging, search as se, search_index as si
from lexmill.plans.build import ordered_lexicon
from tests.test_search import SCHEMA, row

SYLLABLES = ["か", "が", "く", "せ", "ツ", "た", "べ", "る", "学", "校", "国", "雨"]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = []
    for i in range(1, 301):
        word = "".join(rng.choices(SYLLABLES, k=rng.randrange(1, 6)))
        verb = rng.random() < 0.3
        rows.append(row(i, word, "".join(rng.choices(SYLLABLES[:8], k=rng.randrange(1, 6))), fixed.VERB if verb else fixed.NOUN,
                        ("transitive verb",) if verb else ("noun",), rng.choice([None, rng.randrange(1, 50)]), gloss=" ".join(rng.choices(["school", "rain", "to eat", "x" * 600 + "tail"], [5, 5, 5, 1], k=2)), level=rng.choice("ABC")))
    lex = ordered_lexicon(spark.createDataFrame(rows, SCHEMA))
    docs, terms = se.search_docs(lex).cache(), se.search_terms(lex).cache()
    index = si.write_index(docs, terms, str(tmp_path_factory.mktemp("index")), part_rows=20, page_rows=50)
    return docs, terms, index


def requests():
    rng = random.Random(9)
    texts = ["", "学", "学校", "か", "kaku", "taberu", "school", "rain school", "xxtail", "zzz", "学 school", "ガ", "l r", "テル", "学学学学"]
    for text in texts:
        yield se.SearchRequest(text=text, page=rng.choice([1, 2, 3, 99]), page_size=rng.choice([3, 24, 500]), term_only=rng.random() < 0.3,
                               levels=rng.choice([(), ("A", "B")]), major=rng.choice(["", fixed.NOUN]), sort=rng.choice(["rank", "rank", "reading", "word", "random"]),
                               transitivity=rng.choice(["", fixed.TRANSITIVE]), manual_sort=rng.random() < 0.2)
    yield se.SearchRequest(page=7, page_size=13)
    yield se.SearchRequest(text="か", page=4, page_size=13)


def page_rows(df):
    return [(r["entry_id"], r["score"]) for r in df.collect()]


def test_index_gives_the_pages_of_the_plain_search(world):
    docs, terms, index = world
    for request in requests():
        # the plain page by a full sort of everything
        found = se.ranked(se.matching(docs, request), terms, request).orderBy(*se.result_order(request)).collect()
        last = max(1, -(-len(found) // request.page_size))
        start = (min(request.page, last) - 1) * request.page_size
        want = [(r["entry_id"], r["score"]) for r in found[start : start + request.page_size]]
        assert page_rows(si.indexed_search(index, request)) == want, request
        assert page_rows(se.search(docs, terms, request)) == want, request


def test_index_with_variants_and_progress(spark, world):
    docs, _, index = world
    progress = spark.createDataFrame([(str(i), "learned", "u") for i in range(1, 300, 3)], "entry_id string, status string, user_id string")
    variants = spark.createDataFrame([("学", "學", 0)], "kanji string, variant string, ord int")
    for request in (se.SearchRequest(text="か", status="unlearned"), se.SearchRequest(kanji="学", kanji_reading="か"), se.SearchRequest(text="school", status="learned")):
        ids = lambda df: sorted(r["entry_id"] for r in df.collect())
        want = ids(se.matching(docs, request, variants, progress, "u"))
        assert ids(si.indexed_matching(index, request, variants, progress, "u")) == want and want


def scanned_rows(df):
    """Rows that the file scans of a collected plan put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
            continue
        if "FileSourceScan" in node.getClass().getSimpleName():
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_token_reads_few_postings_and_few_parts(world):
    docs, terms, index = world
    request = se.SearchRequest(text="xxtail")
    held = si.candidates(index, request)
    assert scanned_rows(held) < index.grams.count() / 5
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "gram" in plan(held).split("PushedFilters: [")[1].split("]")[0]
    assert "part" in plan(si.indexed_matching(index, request)).split("PartitionFilters: [")[1].split("]")[0]


def test_deep_pages_open_one_part(world):
    _, _, index = world
    request = se.SearchRequest(page=12, page_size=10)
    page = si.indexed_search(index, request)
    assert scanned_rows(page) <= 2 * 20 + 20 and "Offset" not in page._jdf.queryExecution().toString()
    assert {r["rows"] for r in index.directory.collect()} and index.docs.count() == sum(r["rows"] for r in index.directory.collect())


def test_following_pages_by_key(world):
    docs, _, index = world
    order = [r["entry_id"] for r in docs.orderBy(*se.result_order(se.SearchRequest())).collect()]
    got, last = [], None
    for _ in range(40):
        page = si.following(index, last, 9).collect()
        if not page:
            break
        got += [r["entry_id"] for r in page]
        last = index.docs.where(F.col("entry_id") == got[-1])
    assert got == order


def test_pages_of_empty_and_equal_rows(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(50)], "a int, b int").repartition(5)
    got = [r["b"] for p in range(1, 8) for r in paging.dealt_page(rows, [F.col("a"), F.col("b")], p, 8).collect()][:50]
    assert got == [b for _, b in sorted((i % 3, i) for i in range(50))]
    assert paging.dealt_page(rows.limit(0), [F.col("a")], 4, 8).count() == 0
    assert paging.next_page(rows.withColumn("p", F.lit(0)), "p", ["a", "b"], rows.where("b = 47").withColumn("p", F.lit(0)), 5).count() == 0


def test_postings_come_once_and_need_no_shuffle_to_be_told_apart(spark, world, tmp_path, monkeypatch):
    columns = "entry_id string, source_ord int, writing_text string, reading_text string, search_text string, part int"
    rows = [("1", 1, "ab", None, "ab abc abab", 0), ("2", 2, "", "xyz", "x" * 30, 0), ("2", 2, "", "xyz", "x" * 30, 0), ("3", 3, None, None, None, 0), (None, 4, "a", "b", "c", 1), (None, 4, "a", "b", "c", 1)]
    want = {(f, t[i : i + n], r[5], r[0]) for r in rows for f, t in zip(("writing", "reading", "all"), r[2:5]) for i in range(len(t or "")) for n in (1, 2, 3)}
    want = {(f, t, p, e) for f, t, p, e in want if t}
    for block in (4096, 4):
        monkeypatch.setattr(si, "BLOCK", block)
        docs = spark.createDataFrame(rows, columns)
        assert sorted(map(tuple, si.search_grams(docs).collect()), key=str) == sorted(want, key=str)
        assert si._repeats(docs) and si._repeats(docs.where("entry_id = '1'")) == (block == 4)
    assert not si._repeats(docs.limit(0))
    docs, terms, index = world
    monkeypatch.setattr(si, "BLOCK", 4096)
    assert not si._repeats(index.docs) and "Aggregate" not in si._posting_rows(index.docs)._jdf.queryExecution().toString()
    monkeypatch.setattr(si, "BLOCK", 64)
    again = si.write_index(docs, terms, str(tmp_path), part_rows=20, page_rows=50)
    assert si._repeats(again.docs) and again.grams.count() == again.grams.distinct().count()
    assert again.grams.exceptAll(index.grams).count() == 0 == index.grams.exceptAll(again.grams).count()
