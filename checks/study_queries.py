"""Study progress and the two streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import feeds as fd
from lexmill.operators import progress as pg
from lexmill.operators.common import checkpoint_dir
from lexmill.operators.translate import cache_overrides, latest_records
from lexmill.operators.versions import Versions
from lexmill.streaming import progress as sp
from lexmill.streaming import translations as st


def toggles(spark, sf):
    e = fd.table(spark, sf, "events")
    return _as_toggles(e)


def _as_toggles(e):
    """Purchases clear a user's lists; every other event toggles one mark."""
    return e.select(
        "user_id", (F.col("event_id") % 7).cast("string").alias("entry_id"),
        F.when(F.col("event_type") == "view", "starred").otherwise("learned").alias("status"),
        F.when(F.col("event_type") == "purchase", "clear").otherwise("toggle").alias("action"), "ts", F.col("event_id").alias("seq"),
    )


_TOGGLES = """
WITH t AS (SELECT user_id, CAST(event_id % 7 AS VARCHAR) AS entry_id, CASE WHEN event_type = 'view' THEN 'starred' ELSE 'learned' END AS status,
  CASE WHEN event_type = 'purchase' THEN 'clear' ELSE 'toggle' END AS action, ts, event_id AS seq FROM events),
c AS (SELECT user_id, max((ts, seq)) AS cleared FROM t WHERE action = 'clear' GROUP BY user_id)"""
SQL_FOLD = _TOGGLES + """
SELECT t.user_id, entry_id, status FROM t LEFT JOIN c USING (user_id)
WHERE action = 'toggle' AND (cleared IS NULL OR (ts, seq) > cleared) GROUP BY ALL HAVING count(*) % 2 = 1"""
SQL_PARITY = _TOGGLES + """
SELECT user_id, entry_id, status, count(*) AS toggles, count(*) % 2 = 1 AS is_set FROM t WHERE action = 'toggle' GROUP BY ALL"""


def q_study_progress(spark, sf):
    return pg.fold_toggles(toggles(spark, sf))


def q_toggle_parity(spark, sf):
    t = toggles(spark, sf)
    return pg.toggle_parity(t.where(F.col("action") == "toggle"))


def _event_stream(spark, sf):
    schema = fd.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _run_folder(spark):
    """A fresh folder of this run inside the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark)}/lexmill/stream-{uuid.uuid4().hex}"


def q_streamed_progress(spark, sf):
    """The stream logs the events; the fold of its log is the current state."""
    folder = _run_folder(spark)
    events = _as_toggles(_event_stream(spark, sf))
    sp.log_events(events, f"{folder}/log", f"{folder}/ck").awaitTermination()
    return sp.current_progress(spark.read.schema(toggles(spark, sf).schema).parquet(f"{folder}/log"))


def q_streamed_cache(spark, sf):
    """Latest translation record per id, kept by a stream of events."""
    folder = _run_folder(spark)
    e = _event_stream(spark, sf)
    records = e.select(
        F.col("user_id").cast("string").alias("entry_id"), F.array("event_type").alias("translation"), F.lit(None).cast("string").alias("source"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    st.log_records(records, f"{folder}/log", f"{folder}/ck").awaitTermination()
    users = fd.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("entry_id")).distinct()
    return st.current_overrides(users, spark.read.parquet(f"{folder}/log"), "events").select("entry_id", "translation", "translation_source")


def _slices(df, n=5):
    """Whole-table slices by time, so that rows of one time stay together."""
    return [df.where(F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000), F.lit(n)) == i) for i in range(n)]


def q_kept_progress(spark, sf):
    """Five batches, out of order and each given twice, kept as a compacted snapshot and its tail."""
    log = Versions(spark, _run_folder(spark))
    for n, part in enumerate(_slices(toggles(spark, sf))):
        for _ in range(2):
            sp.add_events(log, part, n, lateness="100 years", most=2)
    return sp.kept_progress(log)


def q_kept_progress_in_order(spark, sf):
    """Five batches in the order of time, the older part folded to set marks at each compaction."""
    log = Versions(spark, _run_folder(spark))
    t = toggles(spark, sf)
    span = t.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b")).first()
    step = (span.b - span.a) // 5 + 1 if span.a is not None else 1
    for n in range(5):
        sp.add_events(log, t.where(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(span.a)) / step) == n), n, lateness="1 hour", most=1)
    return sp.kept_progress(log)


def q_kept_cache(spark, sf):
    """Records in five batches, each given twice, kept as a versioned cache."""
    cache = Versions(spark, _run_folder(spark))
    e = fd.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("entry_id"), F.array("event_type").alias("translation"), F.lit(None).cast("string").alias("source"), "ts", F.col("event_id").alias("seq"))
    for n, part in enumerate(_slices(e)):
        for _ in range(2):
            st.add_records(cache, part.withColumnRenamed("ts", "created_at"), n, most=2)
    return cache_overrides(e.select("entry_id").distinct(), st.cached_records(cache), "events").select("entry_id", "translation", "translation_source")


SQL_CACHE = """SELECT CAST(user_id AS VARCHAR) AS entry_id, arg_max(event_type, (ts, event_id)) AS translation, 'events' AS translation_source
FROM events GROUP BY user_id"""


def q_latest_records(spark, sf):
    e = fd.table(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return latest_records(e, "user_id", F.struct("ts", "event_id")).select("user_id", "event_type", "value", "event_id")


SQL_LATEST = """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY user_id"""


def q_replaced_progress(spark, sf):
    current = pg.fold_toggles(toggles(spark, sf))
    imported = fd.table(spark, sf, "labels").where(F.col("toxic") == 1).select(
        (F.col("doc_id") % 50).alias("user_id"), F.col("doc_id").cast("string").alias("entry_id"), F.lit("learned").alias("status"))
    return pg.replace_progress(current, imported)


SQL_REPLACED = f"""WITH cur AS ({SQL_FOLD}), imp AS (SELECT DISTINCT doc_id % 50 AS user_id, CAST(doc_id AS VARCHAR) AS entry_id, 'learned' AS status FROM labels WHERE toxic = 1)
SELECT * FROM cur WHERE user_id NOT IN (SELECT user_id FROM imp) UNION ALL SELECT * FROM imp"""

QUERIES = {
    "study_progress": (q_study_progress, SQL_FOLD),
    "toggle_parity": (q_toggle_parity, SQL_PARITY),
    "kept_progress": (q_kept_progress, SQL_FOLD),
    "kept_progress_in_order": (q_kept_progress_in_order, SQL_FOLD),
    "kept_cache": (q_kept_cache, SQL_CACHE),
    "streamed_progress": (q_streamed_progress, SQL_FOLD),
    "streamed_cache": (q_streamed_cache, SQL_CACHE),
    "latest_records": (q_latest_records, SQL_LATEST),
    "replaced_progress": (q_replaced_progress, SQL_REPLACED),
}
