"""Translation cache and overrides kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexmill.operators.common import last_per_key
from lexmill.operators.translate import cache_overrides
from lexmill.operators.versions import Versions

MOST_FOLDERS = 8


def log_records(records: DataFrame, log: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each micro-batch to the cache, already reduced to one record per id.

    Every batch writes its own folder in overwrite mode, so a batch that is
    run again after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = last_per_key(batch, ["entry_id"], F.struct("created_at", "seq"))
        latest.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return (
        records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current_cache(log: DataFrame) -> DataFrame:
    """Latest record per id over all batches."""
    return last_per_key(log, ["entry_id"], F.struct("created_at", "batch", "seq"))


def current_overrides(lexicon: DataFrame, log: DataFrame, source_label: str) -> DataFrame:
    return cache_overrides(lexicon, current_cache(log), source_label)


def compact_cache(records: DataFrame) -> DataFrame:
    """One record per id, the latest; it keeps its batch, so later batches compare as before."""
    return last_per_key(records, ["entry_id"], F.struct("created_at", "batch", "seq"))


def upsert_records(records: DataFrame, folder: str, checkpoint: str, source: str = "records", most: int = MOST_FOLDERS, trigger: dict | None = None) -> StreamingQuery:
    """Keep a versioned cache: a micro-batch is reduced, stored and named by a manifest that carries its id.

    A batch that runs again, or again after a crash before the manifest was in
    place, changes nothing. A read opens at most ``most`` folders however old
    the stream is. ``source`` names the stream where several write to a folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        add_records(Versions(batch.sparkSession, folder), batch, batch_id, source, most)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def add_records(cache: Versions, batch: DataFrame, batch_id: int, source: str = "records", most: int = MOST_FOLDERS) -> bool:
    return cache.append(compact_cache(batch.withColumn("batch", F.lit(batch_id).cast("long"))), source, batch_id, compact_cache, most)


def cached_records(cache: Versions) -> DataFrame | None:
    rows = cache.current()
    return None if rows is None else compact_cache(rows)
