"""Export and search tables of a built lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.operators import facets as fc
from lexmill.operators import kanji as kj
from lexmill.operators import search as se
from lexmill.operators.search_index import SearchIndex, write_index
from lexmill.sources import sinks

FACETS = ["major", "level", "ref_level", "transitivity"]


def cluster_order() -> list:
    return [F.col("major"), F.desc("count"), F.col("cluster")]


def export_tables(lexicon: DataFrame, tree: DataFrame, out: str | None = None, sources: dict[str, str] | None = None) -> dict[str, DataFrame]:
    facets = [c for c in FACETS if c in lexicon.columns]
    tables = {
        "entries": fc.export_entries(lexicon),
        "clusters": lexicon.groupBy("major", "cluster").agg(F.count("*").alias("count")).orderBy(*cluster_order()),
        "kanji_index": kj.kanji_index(lexicon, kj.kanji_metadata(tree)).orderBy(F.desc("count"), "kanji"),
        "stats": fc.facet_counts(lexicon, facets),
    }
    if out:
        sinks.write_app_tables(tables, out, sources)
    return tables


def write_search_tables(lexicon: DataFrame, out: str, variants: DataFrame | None = None, collation: str = "ja") -> SearchIndex:
    """Store the search index of a lexicon: entries by rank, gram postings, exact terms, rank directory."""
    return write_index(se.search_docs(lexicon, variants), se.search_terms(lexicon, variants), out, collation)
