"""Exact batches, versioned tables, kept stream state, resumable translation run."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.operators import progress as pg
from lexmill.operators.batches import request_batches
from lexmill.operators.versions import Versions
from lexmill.plans.translation_run import translation_run
from lexmill.streaming import progress as sp, translations as st


def plain_batches(rows, max_rows, max_chars):
    out, batch, held, used = {}, 0, 0, 0
    for i, size, count in sorted(rows):
        size, count = size or 0, max(1, count or 1)
        if held and (held + count > max_rows or used + size > max_chars):
            batch, held, used = batch + 1, 0, 0
        held, used = held + count, used + size
        out[i] = batch
    return out


@pytest.mark.parametrize("part_rows", [1, 7, 1000])
def test_batches_equal_one_loop(spark, part_rows):
    rng = random.Random(part_rows)
    rows = [(i, rng.choice([None, 0, 1, 5, 30, 200]), rng.choice([None, 1, 1, 2, 9])) for i in rng.sample(range(1000), 90)]
    df = spark.createDataFrame(rows, "id int, chars int, n int").repartition(4)
    got = {r.id: r.batch for r in request_batches(df, ["id"], "chars", 5, 60, "n", part_rows).collect()}
    assert got == plain_batches(rows, 5, 60)
    got = {r.id: r.batch for r in request_batches(df, ["id"], "chars", 3, 10**9, None, part_rows).collect()}
    assert got == plain_batches([(i, s, 1) for i, s, _ in rows], 3, 10**9)
    assert request_batches(df.limit(0), ["id"], "chars").count() == 0


def test_versions_commit_once_and_survive_a_crash(spark, tmp_path, monkeypatch):
    table = Versions(spark, f"{tmp_path}/v")
    df = spark.range(3)
    same = lambda d: d.distinct()
    assert table.current() is None and table.append(df, "a", 0, same) and not table.append(df, "a", 0, same)
    with monkeypatch.context() as m:  # dies between the data and the manifest
        m.setattr(Versions, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.append(spark.range(10, 12), "a", 1, same)
    assert sorted(r.id for r in table.current().collect()) == [0, 1, 2]
    assert table.append(spark.range(10, 12), "a", 1, same, most=1)  # run again, and compacted
    assert table.append(spark.range(2), "b", 0, same, most=1) and len(table.state()["parts"]) == 1
    assert sorted(r.id for r in table.current().collect()) == [0, 1, 2, 10, 11]
    assert table.vacuum() > 0 and table.current().count() == 5 and table.vacuum() == 0
    with pytest.raises(RuntimeError):
        table._put(f"{tmp_path}/v/manifest/{table.number():010}.json", "{}")


def test_compacted_toggles_fold_alike(spark):
    rng = random.Random(8)
    t0 = datetime(2024, 1, 1)
    events = []
    for i in range(400):
        late = rng.randrange(0, 50)
        events.append((rng.choice("uvw"), str(rng.randrange(3)), rng.choice(["a", "b"]), "clear" if rng.random() < 0.06 else "toggle", t0 + timedelta(minutes=i * 10 - late), i))
    schema = "user_id string, entry_id string, status string, action string, ts timestamp, seq int"
    want = sorted(map(tuple, pg.fold_toggles(spark.createDataFrame(events, schema)).collect()))
    kept = spark.createDataFrame([], schema)
    for a in range(0, 400, 50):
        kept = spark.createDataFrame(pg.compact_toggles(kept.unionByName(spark.createDataFrame(events[a : a + 50], schema)), "1 hour").collect(), schema)
    assert sorted(map(tuple, pg.fold_toggles(kept).collect())) == want and kept.count() < 40


def test_streams_keep_a_bounded_state(spark, tmp_path):
    schema = "user_id string, entry_id string, status string, action string, ts timestamp, seq int"
    for n in range(3):
        rows = [("u", str(i), "a", "toggle", datetime(2024, 1, 1 + n), n * 10 + i) for i in range(2 + n)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        sp.keep_progress(stream, f"{tmp_path}/log", f"{tmp_path}/ck", lateness="1 hour", most=1).awaitTermination()
    log = Versions(spark, f"{tmp_path}/log")
    assert sorted(r.entry_id for r in sp.kept_progress(log).collect()) == ["0", "1", "3"] and len(log.state()["parts"]) == 1
    assert log.current().count() < 9

    records = "entry_id string, translation array<string>, source string, created_at timestamp, seq int"
    cache = Versions(spark, f"{tmp_path}/cache")
    for n, word in enumerate(["old", "new", "newer"]):
        batch = spark.createDataFrame([("1", [word], None, datetime(2024, 1, 1), n), ("2", [word], "s", datetime(2024, 1, 3 - n), n)], records)
        assert st.add_records(cache, batch, n, most=1) and not st.add_records(cache, batch, n, most=1)
    assert {r.entry_id: r.translation for r in st.cached_records(cache).collect()} == {"1": ["newer"], "2": ["old"]}


LEX = "entry_id string, doc_pos int, headword string, reading string, level string, major string, pos array<string>, glosses array<string>, translation string, translation_source string"


class Killed(Exception):
    pass


@pytest.mark.parametrize("dies_at", [0, 2, 3, 4, 5])
def test_translation_run_resumes(spark, tmp_path, monkeypatch, dies_at):
    lexicon = spark.createDataFrame([(str(i), i, f"w{i}", "r", "A" if i < 30 else "B", "n", ["n"], [f"g{i}"], "", "") for i in range(40)], LEX)
    audit = spark.createDataFrame([("entries", "40", "")], "item string, amount string, note string")
    asked = []

    def ask(requests):
        asked.append(requests.count())
        items = requests.select("batch", F.explode("items").alias("i")).select("batch", F.get_json_object("i", "$.id").alias("id"))
        answered = items.where("id % 10 <> 0").unionByName(items.select("batch", F.lit("39").alias("id")))  # one nobody asked for
        return answered.groupBy("batch").agg(F.to_json(F.struct(F.collect_list(F.struct("id", F.array(F.concat(F.lit("t"), "id")).alias("translation"))).alias("items"))).alias("content"))

    def go():
        cache, run = Versions(spark, f"{tmp_path}/cache"), Versions(spark, f"{tmp_path}/run")
        return translation_run(lexicon, audit, ask, cache, run, "svc", "2024-01-01 00:00:00", levels=("A",), max_rows_per_batch=4)

    real, commits = Versions._put, []

    def put(self, path, text):
        commits.append(path)
        if len(commits) == dies_at:
            raise Killed
        real(self, path, text)

    monkeypatch.setattr(Versions, "_put", put)
    if dies_at:
        with pytest.raises(Killed):
            go()
    out = go()
    assert out.counts == {"asked": 30, "answered": 27, "missing": 3, "overrides": 27}
    assert len(asked) == (2 if dies_at == 3 else 1)  # asked again only where the replies were never committed
    rows = {r.entry_id: (r.translation, r.translation_source, r.updated) for r in out.lexicon.collect()}
    assert rows["11"] == ("t11", "svc", True) and rows["20"] == ("", "", False) and rows["39"] == ("", "", False)
    assert {r["item"]: r["amount"] for r in out.audit.collect()} == {"entries": "40", "translation_overrides": "27"}
    assert st.cached_records(Versions(spark, f"{tmp_path}/cache")).count() == 27
    before = len(commits)
    assert go().counts == out.counts and len(commits) == before  # a finished run changes nothing
