"""Work that grows with the input only: substring join, example picks, NFKC, places in groups."""

import random

from pyspark.sql import Window as W, functions as F

from lexmill.functions import text as tx
from lexmill.operators import common, examples as ex


def test_terms_that_begin_alike_do_not_multiply(spark):
    terms = spark.range(3000).select(F.concat(F.lit("the abcdefgh"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("term"))
    texts = spark.range(300).select("id", F.concat(F.lit("see the abcdefgh"), F.lpad((F.col("id") * 20).cast("string"), 5, "0"), F.lit(" zz")).alias("t"))
    pieces = common.term_pieces(texts, ["id"], "t", terms)
    assert 150 <= pieces.count() < 400
    assert common.find_terms(texts, ["id"], "t", terms).count() == 150


def test_stretches_of_the_terms_characters_hold_the_same_terms(spark):
    texts = spark.createDataFrame([(1, "ab-ab ab.cd\nab"), (2, "a\x01b ]^[ cab"), (3, None), (4, "a b")], "id int, t string")
    for words in (["ab", "cd", "a"], ["a b", "]^[", "\x01"], [chr(0x4E00 + i) for i in range(600)] + ["a b"]):
        terms = spark.createDataFrame([(w,) for w in words], "term string")
        got = sorted((r.id, r.term) for r in common.find_terms(texts, ["id"], "t", terms).collect())
        assert got == sorted((r.id, w) for r in texts.collect() for w in words if r.t and w in r.t)


def test_example_picks_equal_plain_ones(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 3)))
    # ids repeat, with the same text and with texts of other lengths
    pairs = [(rng.choice(["s1", "s2", "s3", f"s{i}"]), " ".join(word() for _ in range(rng.randint(1, 9))), "t" * rng.randint(1, 40), f"t{i}") for i in range(60)]
    pairs += pairs[:5]
    terms = list({(word(), f"e{rng.randint(1, 6)}", rng.choice([None, 1, 2, 3])) for _ in range(40)})
    p = spark.createDataFrame(pairs, "sentence_id string, sentence string, translation string, translation_id string").repartition(4)
    t = spark.createDataFrame(terms, "term string, entry_id string, freq_rank int")
    found = ex.match_examples(p, t, 2)
    best = {}
    for s, sentence, translation, _ in pairs:
        for term, e, rank in terms:
            if term in sentence:
                score = (1, abs(len(sentence) - 24), abs(len(translation) - 24), ex.fixed.UNRANKED_EXAMPLE if rank is None else rank, term)
                best[e, s] = min(best.get((e, s), score), score)
    want = set()
    for e in {e for e, _ in best}:
        ordered = sorted((score, s) for (x, s), score in best.items() if x == e)
        want |= {(e, s, i + 1, score[4]) for i, (score, s) in enumerate(sorted(ordered, key=lambda o: (o[0][:4], o[1]))[:2])}
    assert {(r.entry_id, r.sentence_id, r.rank_in_entry, r.term) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("WindowGroupLimit [term" in line for line in plan.split("\n"))  # cut before the shuffle


def test_text_of_stable_characters_is_not_sent_to_python(spark):
    df = spark.createDataFrame([("ｶﾞ①",), ("かなkana漢字",), (None,), ("",)], "t string")
    got = [r.n for r in df.select(tx.nfkc("t").alias("n")).collect()]
    assert got == ["ガ1", "かなkana漢字", None, ""]
    assert df.where("t = ''").repartition(1).select(tx.nfkc("t").alias("n")).first().n == ""
    plan = df.select(tx.nfkc(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("ArrowEvalPython"):]
    assert "RLIKE" in plan and "ArrowEvalPython [_nfkc(t#" not in sent


def test_places_in_groups_that_span_tasks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), i * 7 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, h int, x int").repartition(5)
    want = df.withColumn("place", F.row_number().over(W.partitionBy("g", "h").orderBy("x")))
    got = common.places_within(df, ["g", "h"], [F.col("x")], "place")
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
