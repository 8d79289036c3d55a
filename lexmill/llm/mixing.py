"""Mixing to target weights: iterative proportional fitting over source, language and topic.

Tokens are summed per (source, language, topic) cell. Rounds of fitting scale the
cells so that their sums meet the target of each source, each language and each
topic in turn; a cell is never scaled above its tokens, what it cannot give is
asked of the other cells of its side, and rounds go on until the sums settle. A
document is kept with the probability fitted / present weight of its cell, drawn by
a hash of its id. What infeasible targets miss is returned with the cells, as is
whether the sums settled. The query ``op8_mixing`` fits ROUNDS rounds, which its SQL
can state, and returns what they miss.

The topic of a text is a bucket of its most frequent word of at least
``TOPIC_LETTERS`` letters (ties: the least word); another topic column may be
given. Targets not given are the present shares to the power ``TEMPER``. Cells are
combined before any shuffle, so a source that holds a third of all rows is a few
rows here. Only DataFrame functions are used.

Defined cases: null text has no tokens; null source, language or id count as the
empty string; a cell without tokens has probability 0; rows of one id share
their draw; a text without long words has topic -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexmill.llm.common import stored, table
from lexmill.llm.quality import let, words_of

TOPICS = 8
TOPIC_LETTERS = 4
TEMPER = 0.7
SHARE = 0.8
ROUNDS = 8
#: Blocks of rounds at most, and the move of a weight, as a share of its cell, that counts as settled.
BLOCKS = 12
SETTLED = 1e-5
#: A cell this close to its tokens holds them all: the order of a sum does not decide it.
FULL = 1 - 1e-9
#: Cells that one task holds while fitting.
FEW_CELLS = 100_000
SEED = "mix-1"
SIDES = ("source", "lang", "topic")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def topic_of(words: Column, topics: int = TOPICS) -> Column:
    """Bucket of the most frequent long word."""
    long = F.sort_array(F.filter(words, lambda w: F.length(w) >= TOPIC_LETTERS))

    def most(s: Column) -> Column:
        # a run that ends at i began where its word first stands; only ends are compared
        start = F.struct(F.lit("").alias("now"), F.lit(0).alias("n"), F.lit("").alias("word"), F.lit(0).alias("top"))

        def step(a: Column, w: Column) -> Column:
            n = F.when(a["now"] == w, a["n"] + 1).otherwise(1)
            return F.struct(w.alias("now"), n.alias("n"), F.when(n > a["top"], w).otherwise(a["word"]).alias("word"), F.greatest(n, a["top"]).alias("top"))

        return F.aggregate(s, start, step, lambda a: a["word"])

    word = let(long, most)
    bucket = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % topics
    return F.when(word == "", F.lit(-1).cast("long")).otherwise(bucket)


def with_tokens(docs: DataFrame, text: Column, topic: Column | None = None) -> DataFrame:
    """``docs`` with n_tokens (words) and topic."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    both = let(words_of(lowered), lambda w: F.struct(F.size(w).cast("long").alias("n"), (topic if topic is not None else topic_of(w)).alias("t")))
    return docs.withColumn("_both", both).withColumns({"n_tokens": F.col("_both.n"), "topic": F.col("_both.t")}).drop("_both")


def fitted_cells(cells: DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, share: float = SHARE, blocks: int | None = BLOCKS) -> DataFrame:
    """``cells`` (source, lang, topic, base) with probability, the tokens that each side's target misses (short_source ...) and settled.

    At most ``blocks`` times ``rounds`` rounds, fewer if they settle; ``rounds`` of them if ``blocks`` is None.
    """
    targets = targets or {}
    cells = stored(cells)
    # Cells are one row per (source, lang, topic). Where they are measured few they stay in one task, and no
    # round shuffles them; beyond that every side is a shuffle of its own.
    few = cells.count() <= FEW_CELLS
    held_in = lambda df: df.coalesce(1) if few else df
    now = held_in(cells).crossJoin(F.broadcast(cells.agg(F.sum("base").alias("total"))))
    for side in SIDES:
        mine = F.sum("base").over(W.partitionBy(side))
        if side in targets:
            given = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets[side].items() for x in kv]), F.col(side)), F.lit(0.0))
            now = now.withColumn(f"t_{side}", given)
        else:
            now = now.withColumn(f"t_{side}", F.pow(mine / F.col("total"), F.lit(temper)))
        # a side's wishes sum to the tokens asked for
        first = F.row_number().over(W.partitionBy(side).orderBy(*SIDES)) == 1
        now = now.withColumn(f"_once_{side}", F.when(first, F.col(f"t_{side}")).otherwise(0.0))
    now = held_in(stored(now))
    now = now.crossJoin(F.broadcast(now.agg(*[F.sum(f"_once_{s}").alias(f"_all_{s}") for s in SIDES])))
    now = now.withColumns({f"t_{s}": F.col(f"t_{s}") / F.col(f"_all_{s}") * F.col("total") * share for s in SIDES})
    now = held_in(stored(now.select(*SIDES, "base", *[f"t_{s}" for s in SIDES], F.col("base").cast("double").alias("w"))))
    most = rounds * (blocks or 1)
    done, settled = 0, False
    while done < most and not (blocks and settled):
        some = min(4, most - done)  # rounds between two stored tables
        now = now.withColumn("before", F.col("w"))
        for _ in range(some):
            for side in SIDES:
                here, wish, full = W.partitionBy(side), F.col(f"t_{side}"), F.col("w") >= F.col("base") * FULL
                mine, held = F.sum("w").over(here), F.sum(F.when(full, F.col("w")).otherwise(0.0)).over(here)
                raised = F.when(full | (mine <= held), F.col("w")).otherwise(F.least(F.col("base").cast("double"), F.col("w") * (wish - held) / (mine - held)))
                lowered = F.when(mine > 0, F.col("w") * wish / mine).otherwise(0.0)
                now = now.withColumn("w", F.when(mine < wish, raised).otherwise(lowered))
        now = held_in(stored(now))
        done += some
        settled = not now.where(F.abs(F.col("w") - F.col("before")) > SETTLED * F.col("base")).limit(1).count()
    probability = F.when(F.col("base") > 0, F.round(F.least(F.col("w") / F.col("base"), F.lit(1.0)), 6)).otherwise(0.0)
    now = now.withColumn("probability", probability)
    short = [(F.col(f"t_{s}") - F.sum(F.col("base") * F.col("probability")).over(W.partitionBy(s))).alias(f"short_{s}") for s in SIDES]
    return now.select(*SIDES, "base", "probability", *short, F.lit(settled).alias("settled"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _drawn(counted: DataFrame, doc_id: Column, source: Column, lang: Column, **options) -> DataFrame:
    """Stored rows with n_tokens and topic, and _source, _lang, probability, kept and what the sides' targets miss."""
    side = {"source": F.coalesce(source, F.lit("")), "lang": F.coalesce(lang, F.lit("")), "topic": F.col("topic")}
    cells = counted.groupBy(*[c.alias(n) for n, c in side.items()]).agg(F.sum("n_tokens").alias("base"))
    fitted = stored(fitted_cells(cells, **options)).select(*[F.col(s).alias(f"_{s}") for s in SIDES], "probability", *[F.col(f"short_{s}").alias(f"_short_{s}") for s in SIDES])
    at = (side["source"] == F.col("_source")) & (side["lang"] == F.col("_lang")) & (side["topic"] == F.col("_topic"))
    return counted.join(fitted, at).withColumn("kept", draw(doc_id) < F.col("probability"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, **options) -> DataFrame:
    """``docs`` with n_tokens, topic, probability and kept (columns of these names are replaced); rows are stored once."""
    row = F.col("_row")
    counted = stored(with_tokens(docs.select(F.struct(*docs.columns).alias("_row")), row[text_col], topic))
    new = ["n_tokens", "topic", "probability", "kept"]
    return _drawn(counted, row[id_col], row[source_col], row[lang_col], **options).select(*[row[c].alias(c) for c in docs.columns if c not in new], *new)


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    counted = stored(with_tokens(docs, F.col("text")).drop("text"))
    rows = _drawn(counted, F.col("doc_id"), F.col("source"), F.col("lang"), blocks=None)
    return rows.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), "topic", "n_tokens", "probability", "kept", *[F.round(f"_short_{s}", 2).alias(f"short_{s}") for s in SIDES])


def _sql() -> str:
    steps, last = [], "r0"
    for i in range(ROUNDS * len(SIDES)):
        side = SIDES[i % len(SIDES)]
        full, here = f"w >= base * {FULL!r}", f"OVER (PARTITION BY {side})"
        raised = f"CASE WHEN {full} OR mine <= held THEN w ELSE least(base, w * (t_{side} - held) / (mine - held)) END"
        steps.append(f"s{i + 1} AS (SELECT *, sum(w) {here} AS mine, sum(CASE WHEN {full} THEN w ELSE 0 END) {here} AS held FROM {last})")
        steps.append(f"r{i + 1} AS (SELECT * EXCLUDE (mine, held) REPLACE (CASE WHEN mine < t_{side} THEN {raised} WHEN mine > 0 THEN w * t_{side} / mine ELSE 0 END AS w) FROM s{i + 1})")
        last = f"r{i + 1}"
    marginals = ", ".join(f"m_{s} AS (SELECT {s}, pow(sum(base) / (SELECT sum(base) FROM cells), {TEMPER}) AS t FROM cells GROUP BY {s})" for s in SIDES)
    wishes = ", ".join(f"m_{s}.t / (SELECT sum(t) FROM m_{s}) * (SELECT sum(base) FROM cells) * {SHARE} AS t_{s}" for s in SIDES)
    joins = " ".join(f"JOIN m_{s} USING ({s})" for s in SIDES)
    short = ", ".join(f"round(t_{s} - sum(base * probability) OVER (PARTITION BY {s}), 2) AS short_{s}" for s in SIDES)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), k AS (SELECT *, row_number() OVER () AS k FROM d
), u AS (SELECT k, unnest(list_filter(words, lambda x: length(x) >= {TOPIC_LETTERS})) AS word FROM k
), f AS (SELECT k, word, count(*) AS n FROM u GROUP BY k, word
), b AS (SELECT k, arg_min(word, (-n, word)) AS word FROM f GROUP BY k
), t AS (
  SELECT doc_id, source, lang, len(words)::BIGINT AS n_tokens,
    CASE WHEN b.word IS NULL THEN -1 ELSE ('0x' || substr(md5(b.word), 1, 8))::BIGINT % {TOPICS} END AS topic
  FROM k LEFT JOIN b USING (k)
), cells AS (SELECT source, lang, topic, sum(n_tokens) AS base FROM t GROUP BY ALL
), {marginals}, r0 AS (SELECT cells.*, base::DOUBLE AS w, {wishes} FROM cells {joins}
), {", ".join(steps)}, p AS (
  SELECT *, CASE WHEN base > 0 THEN round(least(w / base, 1), 6) ELSE 0 END AS probability FROM {last}
), m AS (SELECT source, lang, topic, probability, {short} FROM p)
SELECT doc_id, source, lang, topic, n_tokens, probability, {", ".join(f"short_{s}" for s in SIDES)},
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)} < probability AS kept
FROM t JOIN m USING (source, lang, topic)
"""


OP8_SQL = _sql()
