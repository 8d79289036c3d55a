"""Chat formatting: every dialogue from the side of each of its speakers.

For each participant of a conversation the dialogue is rendered with that speaker
as assistant, all others as named users and system turns as they are. A rendered
dialogue is given as its segments in order, with the span of each in the whole
and the span of it that is trained on (the assistant's words and their end mark).
Segments of one dialogue lie in several tasks if it is large: rows are dealt by
range, and the lengths before a task are added from its predecessors' sums.

Defined cases: null roles are the speaker ``unknown``; null texts are empty; null
conversation ids are one conversation; rows of one turn are ordered by role and
text; repeated rows are segments each; a conversation of system turns only has no
participant and no rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexmill.llm.common import stored, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def perspectives(turns: DataFrame) -> DataFrame:
    """One row per (turn, participant): conv_id, turn, speaker, perspective, as_role, segment, body (characters before the words)."""
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    sides = plain.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    rows = plain.join(sides, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    as_role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit(OPEN), as_role, F.when(as_role == "user", F.concat(F.lit(" name="), "speaker")).otherwise(""), F.lit("\n"))
    return rows.select("conv_id", "perspective", "turn", "speaker", as_role.alias("as_role"), F.concat(head, "text", F.lit(CLOSE)).alias("segment"), F.length(head).cast("long").alias("body"))


def rendered(turns: DataFrame) -> DataFrame:
    """Segments with position, start and end in the dialogue, and train_start and train_end (null where not trained on)."""
    order = ["turn", "speaker", "segment"]
    dealt = perspectives(turns).repartitionByRange("conv_id", "perspective", *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt)
    size = F.length("segment").cast("long")
    own = dealt.groupBy("conv_id", "perspective", "_part").agg(F.sum(size).alias("_chars"), F.count("*").alias("_rows"))
    before = W.partitionBy("conv_id", "perspective").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = own.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_v"), F.col("_part").alias("_p"), *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("_chars", "_rows")])
    inside = W.partitionBy("conv_id", "perspective", "_part").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = dealt.withColumns({"_n": F.row_number().over(inside), "_end": F.sum(size).over(upto)})
    at = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_v")) & (F.col("_part") == F.col("_p"))
    end = F.col("_chars_before") + F.col("_end")
    trained = F.col("as_role") == "assistant"
    return rows.join(base, at).select(
        "conv_id", "perspective", (F.col("_rows_before") + F.col("_n")).cast("long").alias("position"), "turn", "speaker", "as_role", "segment",
        (end - size).alias("start"), end.alias("end"), F.when(trained, end - size + F.col("body")).alias("train_start"), F.when(trained, end - 1).alias("train_end"),
    )


def op7_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return rendered(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


OP7_SQL = f"""
WITH p AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM p WHERE speaker <> '{SYSTEM}'
), r AS (
  SELECT p.*, perspective, CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS as_role
  FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), h AS (SELECT *, '{OPEN}' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r
), g AS (SELECT *, head || text || '{CLOSE.strip()}' || chr(10) AS segment FROM h
), o AS (
  SELECT *, row_number() OVER w AS position, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM g
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment)
)
SELECT conv_id, perspective, position, turn, speaker, as_role, segment, "end" - length(segment) AS start, "end",
  CASE WHEN as_role = 'assistant' THEN "end" - length(segment) + length(head) END AS train_start,
  CASE WHEN as_role = 'assistant' THEN "end" - 1 END AS train_end
FROM o
"""
