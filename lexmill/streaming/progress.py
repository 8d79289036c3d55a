"""Study toggles as a stream, with the batch rules unchanged."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexmill.operators.progress import compact_toggles, fold_toggles, toggle_parity
from lexmill.operators.versions import Versions

MOST_FOLDERS = 8
LATENESS = "1 day"


def stream_parity(toggles: DataFrame) -> DataFrame:
    """Running parity per mark; write it in update mode."""
    return toggle_parity(toggles.where(F.col("action") == "toggle"))


def log_events(events: DataFrame, log: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append toggle and clear events to a log, exactly once.

    The log is partitioned by status; ``current_progress`` folds it with the
    batch rule, clears included.
    """
    return (
        events.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)
        .partitionBy("status").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def current_progress(log: DataFrame) -> DataFrame:
    return fold_toggles(log)


def keep_progress(events: DataFrame, folder: str, checkpoint: str, lateness: str = LATENESS, source: str = "events",
                  most: int = MOST_FOLDERS, trigger: dict | None = None) -> StreamingQuery:
    """Keep the events that still decide the lists: a compacted snapshot and the tail behind it.

    Each micro-batch is stored once and named by a manifest with its id. When
    there are more than ``most`` folders, all become one: events older than the
    newest by ``lateness`` fold to one toggle per set mark and one clear per user
    (see ``compact_toggles``), the others stay. So a read grows with the marks
    that are set and the tail, and not with the log's age.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        add_events(Versions(batch.sparkSession, folder), batch, batch_id, lateness, source, most)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def add_events(log: Versions, batch: DataFrame, batch_id: int, lateness: str = LATENESS, source: str = "events", most: int = MOST_FOLDERS) -> bool:
    return log.append(batch, source, batch_id, partial(compact_toggles, lateness=lateness), most)


def kept_progress(log: Versions) -> DataFrame | None:
    rows = log.current()
    return None if rows is None else fold_toggles(rows)
