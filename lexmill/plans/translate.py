"""Dictionary translation of a lexicon, with the repair queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill import fixed
from lexmill.functions.classify import has_source_prefix
from lexmill.operators import gloss as gl
from lexmill.sources import sinks


def translate_lexicon(lexicon: DataFrame, tables: DataFrame, reverse: DataFrame | None = None, out: str | None = None,
                      levels: tuple[str, ...] = ("A",), preserve_prefixes: tuple[str, ...] = (),
                      threshold: float = fixed.CONFIDENCE_THRESHOLD, max_rows: int = 0, instruction: str = "") -> dict[str, DataFrame]:
    """Overrides, repair queue, outcome counts and the published counters."""
    rows = lexicon.where(F.col("level").isin(list(levels))) if levels else lexicon
    if "translation_source" in rows.columns:
        rows = rows.where(~has_source_prefix("translation_source", preserve_prefixes))
    if max_rows:
        rows = rows.where(F.size("glosses") > 0).orderBy("doc_pos", "entry_id").limit(max_rows)
    asked = rows.select(F.explode("glosses").alias("gloss"), "major")
    translated = gl.translate_glosses(asked, tables, reverse)
    overrides = gl.entry_translations(rows, translated, threshold=threshold)
    queue = gl.repair_queue(rows, overrides, instruction)
    outcomes = gl.translation_outcomes(lexicon, overrides, list(levels), preserve_prefixes)
    if out:
        sinks.write_parquet(overrides, f"{out}/tables/translations")
        overrides = overrides.sparkSession.read.parquet(f"{out}/tables/translations")
        queue = gl.repair_queue(rows, overrides, instruction)
        outcomes = gl.translation_outcomes(lexicon, overrides, list(levels), preserve_prefixes)
        sinks.write_overrides(overrides, out)
        sinks.write_repair_queue(queue, out)
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("rows"))
    return {"overrides": overrides, "queue": queue, "outcomes": outcomes, "counts": counts, "counters": gl.outcome_counters(outcomes)}
