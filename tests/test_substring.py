"""Substring join: both plans, the set of bits, positions and terms of every length."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import common


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, -1])
def test_terms_equal_a_plain_search_in_both_plans(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rng = random.Random(11)
    letters = "abé𠮟 \n"
    texts = [(rng.choice([i, None, 5]), "".join(rng.choices(letters, k=rng.choice([0, 3, 40, 300, 900])))) for i in range(40)] + [(99, None), (98, "x" * 5000 + "end")]
    terms = {"".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(150)} | {"x" * 9 + "end", "x" * 4000, "x" * 700 + "end"}
    terms |= {t[5:305] for _, t in texts if t and len(t) > 400}
    df = spark.createDataFrame(texts, "id int, t string").repartition(3)
    given = spark.createDataFrame([(t, n) for t in terms for n in (1, 2)] + [("", 3), (None, 4)], "term string, n int")
    got = [(r.id, r.term, r.n) for r in common.find_terms(df, ["id"], "t", given).collect()]
    want = {(i, t, n) for i, text in texts for t in terms if text and t in text for n in (1, 2)}
    assert len(got) == len(set(got)) and set(got) == want


def test_the_set_of_bits_never_loses_an_anchor(spark):
    words = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("anchor"))
    for most in (64, 1 << 12, 1 << 20):
        may_be = common.anchor_filter(words, 5000, most)
        seen = spark.range(20000).select("id", may_be(F.concat(F.lit("w"), "id")).alias("ok")).where("ok")
        assert seen.where("id < 5000").count() == 5000
    assert seen.count() < 5300  # and lets little else through


def test_long_terms_travel_as_eight_characters(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    df = spark.createDataFrame([(1, "abcdefghij" * 50)], "id int, t string")
    plan = common.find_terms(df, ["id"], "t", spark.createDataFrame([("cdefghijab" * 9,)], "term string"))
    assert [r.term for r in plan.collect()] == ["cdefghijab" * 9]
