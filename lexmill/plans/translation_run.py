"""One translation run: pending rows to requests, replies to cache, overrides, lexicon and audit.

Every step is stored and committed once under the run's folder. A run that was
killed is started again with the same arguments and goes on behind its last
committed step: no request is sent twice, no record is lost or doubled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lexmill import fixed
from lexmill.operators import translate as tr
from lexmill.operators.batches import request_batches
from lexmill.operators.versions import Versions
from lexmill.streaming.translations import cached_records, compact_cache


@dataclass(frozen=True)
class TranslationRun:
    requests: DataFrame
    missing: DataFrame
    overrides: DataFrame
    lexicon: DataFrame
    audit: DataFrame
    counts: dict[str, int]


def _cache(cache: Versions, like: DataFrame) -> DataFrame:
    rows = cached_records(cache)
    return like.sparkSession.createDataFrame([], "entry_id string, translation array<string>, source string") if rows is None else rows


def translation_run(lexicon: DataFrame, audit: DataFrame, ask: Callable[[DataFrame], DataFrame], cache: Versions, run: Versions, source_label: str,
                    created_at: str, levels: tuple[str, ...] = (), order: tuple[str, ...] = ("doc_pos", "entry_id"), max_rows: int = 0, force: bool = False,
                    max_rows_per_batch: int = fixed.BATCH_ROWS, max_chars: int = fixed.BATCH_CHARS) -> TranslationRun:
    """Translate what the cache lacks.

    ``ask`` turns requests (batch, items) into replies (batch, content); the
    caller owns the service. ``run`` is a folder of this run, ``cache`` the one
    that runs share. ``created_at`` is the run's time, given so that a resumed
    run writes the same records. Entries without an answer are in ``missing``
    and stay pending for the next run.
    """

    def prepare() -> dict[str, DataFrame]:
        rows = lexicon.where(F.col("level").isin(list(levels))) if levels else lexicon
        open_ = tr.pending(rows, _cache(cache, lexicon), force)
        if max_rows:
            open_ = open_.where((F.col("entry_id") != "") & (F.size("glosses") > 0)).orderBy(*order).limit(max_rows)
        sized = tr.request_rows(open_).join(open_.select("entry_id", *[c for c in order if c != "entry_id"]), "entry_id")
        return {"asked": request_batches(sized, list(order), "item_chars", max_rows_per_batch, max_chars)}

    asked = run.step("prepare", prepare)["asked"]
    ordered = F.array_sort(F.collect_list(F.struct(*order, "item")))
    requests = run.step("requests", lambda: {"requests": asked.groupBy("batch").agg(F.transform(ordered, lambda x: x["item"]).alias("items"))})["requests"]
    replies = run.step("replies", lambda: {"replies": ask(requests)})["replies"]

    def read() -> dict[str, DataFrame]:
        parsed = tr.parse_replies(replies.select("batch", "content"))
        # an answer counts for a row that its batch asked for
        wanted = parsed.join(asked.select("batch", "entry_id"), ["batch", "entry_id"], "left_semi")
        records = wanted.select("entry_id", "translation", F.lit(source_label).alias("source"), F.lit(created_at).cast("timestamp").alias("created_at"), F.col("batch").alias("seq"))
        return {"records": records, "missing": tr.missing_replies(asked.select("entry_id"), records)}

    got = run.step("read", read)
    # The cache notes the run by its folder, so records go in once even if the run dies right after.
    cache.append(compact_cache(got["records"].withColumn("batch", F.lit(cache.number() + 1).cast("long"))), run.folder, 0, compact_cache)
    overrides = run.step("overrides", lambda: {"overrides": tr.cache_overrides(lexicon, _cache(cache, lexicon), source_label)})["overrides"]

    def apply() -> dict[str, DataFrame]:
        done = tr.apply_overrides(lexicon, overrides)
        updates = overrides.agg(F.count("*").cast("string").alias("amount")).select(
            F.lit("translation_overrides").alias("item"), "amount", F.lit(source_label).alias("note"))
        return {"lexicon": done, "audit": tr.upsert_audit(audit, updates)}

    applied = run.step("apply", apply)
    counts = {"asked": asked.count(), "answered": got["records"].count(), "missing": got["missing"].count(), "overrides": overrides.count()}
    return TranslationRun(requests, got["missing"], overrides, applied["lexicon"], applied["audit"], counts)
