"""Japanese order: plain keys against the collation of the JVM."""

import random

from pyspark.sql import Window as W, functions as F

from lexmill.functions import collation as co


def test_keys_equal_the_collation(spark):
    rng = random.Random(11)
    kana, latin = "あいかがきぎはばぱひびぴうゔつっやゃよょわんアカガハバパウヴッャー々", "aebEéèêñöøaà zA1-9. _"
    words = {"".join(rng.choice(a) for _ in range(rng.randint(0, n))) for a, n in ((kana, 4), (latin, 4), (kana + latin + "学校亜唖人丂仮", 3)) for _ in range(500)}
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    ranks = rows.select("w", F.dense_rank().over(W.orderBy(F.collate("w", "ja"))).alias("c"), F.dense_rank().over(W.orderBy(*co.japanese_keys("w"))).alias("k"))
    assert [r for r in ranks.collect() if r.c != r.k] == []


def test_keys_of_odd_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("ー" * 3,), ("かーーか",), ("ガ",), ("が",)], "w string")
    keys = [tuple(r) for r in rows.select(*co.japanese_keys("w")).collect()]
    assert keys[0] == keys[1] == ("", "", "") and keys[4] == keys[5]
    assert keys[3][0] == "かああか" and keys[2][0] == co.LONG * 3
