"""Writers.

Folders of part files, as Spark writes them; Parquet between jobs, CSV, TSV
and JSON for exchange. Arrays are joined and NULLs blanked only here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from lexmill import fixed


def publish(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select and rename to the published columns, every value a string."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def value(name):
        if name not in types:
            return F.lit("")
        c = F.col(name)
        if isinstance(types[name], T.ArrayType):
            c = F.array_join(c, fixed.LIST_SEPARATOR)
        return F.coalesce(c.cast("string"), F.lit(""))

    return df.select(*[value(name).alias(published) for published, name in columns.items()])


def write_csv(df: DataFrame, path: str, columns: dict[str, str], sep: str = ",") -> None:
    (
        publish(df, columns).write.mode("overwrite").option("header", True).option("sep", sep)
        .option("escape", '"').option("emptyValue", "").csv(path)
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_lexicon(lexicon: DataFrame, tree: DataFrame, clusters: DataFrame, audit: DataFrame, folder: str) -> None:
    """The six lexicon outputs. ``lexicon`` should be a stored table."""
    order = master_order()
    master = lexicon.orderBy(*order)
    write_csv(master, f"{folder}/master_lexicon", fixed.MASTER_COLUMNS)
    write_csv(
        lexicon.where(F.col("major") == fixed.VERB).orderBy(*order), f"{folder}/verbs_by_transitivity", fixed.MASTER_COLUMNS
    )
    write_csv(
        lexicon.where(F.col("major").isin(fixed.I_ADJ, fixed.NA_ADJ)).orderBy(*order),
        f"{folder}/adjective_clusters", fixed.MASTER_COLUMNS,
    )
    write_csv(tree.orderBy("major", "level", "sort_reading", "word", "doc_pos", "ord"), f"{folder}/noun_kanji_tree", fixed.KANJI_TREE_COLUMNS)
    write_csv(clusters.orderBy("major", F.desc("entries"), "cluster"), f"{folder}/cluster_summary", fixed.CLUSTER_COLUMNS)
    write_csv(audit, f"{folder}/source_audit", fixed.AUDIT_COLUMNS)


def master_order() -> list:
    reading = F.when(F.coalesce(F.col("reading"), F.lit("")) == "", F.col("headword")).otherwise(F.col("reading"))
    return [F.col("major"), F.col("level"), reading, F.col("headword"), F.col("doc_pos"), F.col("entry_id")]


def write_matches(result: dict[str, DataFrame], folder: str) -> None:
    """Candidates, matches, ambiguous, unmatched and the entry preview."""
    base = {p: n for p, n in fixed.MATCH_COLUMNS.items() if n in
            ("level", "writing", "reading", "meaning", "source", "source_file", "source_url", "note")}
    write_csv(result["candidates"], f"{folder}/candidates", base)
    write_csv(result["matches"], f"{folder}/matches", fixed.MATCH_COLUMNS)
    write_csv(result["ambiguous"], f"{folder}/ambiguous", fixed.MATCH_COLUMNS)
    write_csv(result["unmatched"], f"{folder}/unmatched", {**base, "匹配规则": "rule"})
    write_csv(result["preview"], f"{folder}/entry_preview", fixed.PREVIEW_COLUMNS)


def write_examples(examples: DataFrame, folder: str) -> None:
    ordered = examples.orderBy(F.col("entry_id").try_cast("bigint"), "entry_id", "rank_in_entry")
    write_csv(ordered, f"{folder}/examples", fixed.EXAMPLE_COLUMNS)


def write_overrides(overrides: DataFrame, folder: str) -> None:
    write_csv(overrides, f"{folder}/overrides", fixed.OVERRIDE_COLUMNS, sep="\t")


def write_repair_queue(queue: DataFrame, folder: str) -> None:
    write_json(queue, f"{folder}/repair_queue")


def append_cache(records: DataFrame, folder: str) -> None:
    write_json(records, folder, mode="append")


def export_totals(export: dict[str, DataFrame]) -> DataFrame:
    """One row: how many entries and kanji an export holds."""
    entries = export["entries"].agg(F.count("*").alias("entries"))
    return entries.withColumn("kanji", export["kanji_index"].agg(F.count("*")).scalar())


def write_app_tables(export: dict[str, DataFrame], folder: str, sources: dict[str, str] | None = None) -> None:
    """Export tables side by side instead of one document holding them all.

    ``meta`` has the time, the totals and what the tables were made from (``sources``: name -> path).
    """
    for name in ("entries", "clusters", "kanji_index", "stats"):
        write_json(export[name], f"{folder}/{name}")
    made_from = F.struct(*[F.lit(path).alias(name) for name, path in (sources or {}).items()]) if sources else F.lit(None).cast("string")
    meta = export_totals(export).select(F.current_timestamp().alias("generated_at"), made_from.alias("source"), "entries", "kanji")
    write_json(meta, f"{folder}/meta")


def write_study_data(progress: DataFrame, folder: str) -> None:
    """Study lists as rows, one folder per status; no user's list is gathered."""
    rows = progress.select("user_id", "entry_id", "status")
    rows.write.mode("overwrite").partitionBy("status").json(folder)
