"""Study progress: a log of toggles folded to the current lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fold_toggles(events: DataFrame) -> DataFrame:
    """(user_id, entry_id, status) currently set.

    ``events``: user_id, entry_id, status, action (``toggle`` or ``clear``), ts, seq.
    A mark is set after an odd number of toggles since the user's last clear.
    Counts combine on the map side, so a very active user is no hot task; the
    clears are one row per user that ever cleared.
    """
    at = F.struct("ts", "seq")
    clears = events.where(F.col("action") == "clear").groupBy("user_id").agg(F.max(at).alias("cleared"))
    toggles = events.where(F.col("action") == "toggle")
    live = toggles.join(clears, "user_id", "left").where(F.col("cleared").isNull() | (at > F.col("cleared")))
    return toggle_parity(live).where("is_set").select("user_id", "entry_id", "status")


def toggle_parity(toggles: DataFrame) -> DataFrame:
    return toggles.groupBy("user_id", "entry_id", "status").agg(
        F.count("*").alias("toggles"), (F.count("*") % 2 == 1).alias("is_set")
    )


def compact_toggles(events: DataFrame, lateness: str) -> DataFrame:
    """Fewer events of the same fold, also together with any event that is at most ``lateness`` behind the newest.

    Of the events before that horizon a user's last clear stays, and of each
    mark that is set after it the last toggle; pairs of toggles cancel. Toggles
    that arrive later than that still count right, as parity does not ask for
    order; a clear that arrives later ends what the kept toggle stands for.
    """
    at = F.struct("ts", "seq")
    horizon = events.agg((F.max("ts") - F.expr(f"interval {lateness}")).alias("h")).scalar()
    marked = events.withColumn("_old", F.coalesce(F.col("ts") < horizon, F.lit(True)))
    old = marked.where("_old").drop("_old")
    clears = old.where(F.col("action") == "clear").groupBy("user_id").agg(F.max(at).alias("_c"), F.max_by(F.struct(*events.columns), at).alias("_row"))
    live = old.where(F.col("action") == "toggle").join(clears.select("user_id", "_c"), "user_id", "left").where(F.col("_c").isNull() | (at > F.col("_c")))
    marks = live.groupBy("user_id", "entry_id", "status").agg(F.count("*").alias("_n"), F.max_by(F.struct(*events.columns), at).alias("_row")).where("_n % 2 = 1")
    return marked.where(~F.col("_old")).drop("_old").unionByName(clears.select("_row.*")).unionByName(marks.select("_row.*"))


def replace_progress(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported lists replace the lists of the users they belong to."""
    others = current.join(imported.select("user_id").distinct(), "user_id", "left_anti")
    return others.unionByName(imported.select("user_id", "entry_id", "status").distinct())
