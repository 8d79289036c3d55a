"""A training-corpus pipeline: each stage reads what its predecessor kept and writes Parquet for the next one."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import table
from lexmill.llm.jaccard_join import jaccard_join
from lexmill.llm.mixing import mix_documents
from lexmill.llm.pieces import encode
from lexmill.llm.quality import quality_rules
from lexmill.llm.suffix_dedup import suffix_dedup
from lexmill.operators.common import checkpoint_dir, drop_folders, owned_cuts, roots

#: Tables that finished stages stored on their way.
_LEFT: list[str] = []


def release(spark: SparkSession, docs: DataFrame) -> None:
    """Drop what earlier stages stored on their way, but for anything that ``docs`` still reads."""
    read = roots(docs)
    gone = [path for path in _LEFT if not any(path in r for r in read)]
    _LEFT[:] = [path for path in _LEFT if path not in gone]
    drop_folders(spark, gone)


def stage(fn):
    """A stage that starts by releasing its predecessors' tables and notes its own."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, docs)
        with owned_cuts() as cuts:
            out = fn(spark, docs, sf_dir)
        _LEFT.extend(cuts)
        return out

    return run_stage


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id.

    A row without an id, or without words, is in no group. Rows that repeat an id
    are one document and stay or go together.
    """
    groups = jaccard_join(docs.select("doc_id", "text"))
    gone = groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat earlier ones; bytes of a character that was cut go with it."""
    cut = suffix_dedup(docs.select("doc_id", "text", "lang", "source"), carry=("lang", "source"))
    out = cut.select("doc_id", F.col("kept").alias("text"), "lang", "source")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities."""
    return mix_documents(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, ids, n_tokens, ids_crc32, round_trip."""
    return encode(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixing),
    ("SentencePiece encoding", tokens),
]

#: Covariance fits, components and suffix sorts have no SQL form here; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are stored in the shared folder, the last ones stay."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/lexmill/{spark.sparkContext.applicationId}/corpus-{uuid.uuid4().hex}"
    for i, (_, apply) in enumerate(STAGES):
        apply(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            drop_folders(spark, [f"{folder}/{i - 1}"])
    release(spark, docs)
    return docs
