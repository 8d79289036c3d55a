"""Quality rules: fixed rules, then robust multivariate outliers per language and source.

Every text gives counts of words, characters, symbols, repeated lines and repeated
word windows. Fixed rules reject texts that are too short or repeat themselves.
The counts give a vector of rates on a grid of 1/GRID. For every (language,
source) a minimum-covariance-determinant estimate is fitted from two starts -
medians with median deviations, and the mean and covariance of all rows - by
concentration steps: keep the share ``SUPPORT`` of the rows that lie nearest, take
their mean and covariance, measure all rows anew, until no estimate moves or
``STEPS`` are done. Each group keeps the start of least determinant. A row is
rejected if its Mahalanobis distance is beyond ``CUTOFF`` on the side of more
symbols, repeats or capitals.

All statistics cover all rows. Rows of one group and grid point are one weighted
row, combined before the shuffle; distances are counted in bins, so quantiles
are aggregates too and no group is sorted or gathered. Small groups take the
estimate of their language, then that of all rows (a rollup). Only DataFrame
functions are used.

Defined cases: null text has no words and fails the base rules; null language or
source counts as the empty string; a table without rows gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.llm.common import stored, table
from lexmill.operators.common import broadcast_if_small

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GRID = 20
SUPPORT = 0.75
#: At most so many steps; they end when no estimate moves.
STEPS = 12
MIN_GROUP = 100
#: The 0.975 quantile of a chi-square of DIM degrees of freedom.
CUTOFF = 12.8325
#: Least standard deviation of each coordinate, small against its range; one repeated line in a short text is no outlier.
FLOORS = (0.1, 0.2, 1.0, 0.3, 0.2)
DIM = len(FLOORS)
#: The median of a chi-square of DIM degrees of freedom.
CHI_MEDIAN = 4.3515
BIN = 50.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_of(text: Column) -> Column:
    """Words between blanks, tabs and line ends."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " ", -1), "")


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first included.

    Window hashes and their places are sorted as one number each; equal
    neighbours are compared by whole hash, and the places covered are counted.
    """

    def count(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long"))).cast("int")

        def places(h: Column) -> Column:
            packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

            def twice(s: Column) -> Column:
                def same(x: Column, y: Column) -> Column:
                    return F.coalesce((F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)) & (F.get(h, x.bitwiseAND(mask).cast("int")) == F.get(h, y.bitwiseAND(mask).cast("int"))), F.lit(False))

                return F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))

            return F.sort_array(F.transform(let(packed, twice), lambda x: x.bitwiseAND(mask)))

        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        covered = let(let(hashes, places), lambda q: F.aggregate(q, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"]))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(covered)

    return let(words, count)


def text_counts(text: Column) -> dict[str, Column]:
    """The counts of a text by name."""
    t = F.coalesce(text, F.lit(""))
    blank = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(t, "\n", -1), lambda x: without(x, blank) > 0)
    words = words_of(text)
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return {
        "_words": both,
        "word_chars": without(t, blank).cast("long"),
        "n_symbols": (F.length(t) - without(t, SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_capitals": (F.length(t) - without(t, CAPITALS)).cast("long"),
    }


def with_counts(docs: DataFrame, text: Column) -> DataFrame:
    out = docs.withColumns(text_counts(text))
    out = out.withColumns({"n_words": F.col("_words.n"), "n_repeat_words": F.col("_words.r")}).drop("_words")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def vector() -> list[Column]:
    """Rates of a text on the grid, as whole numbers of 1/GRID."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    rates = [
        F.log(chars / words),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(1000 * F.col("n_dup_lines") / words),
        F.log1p(100 * F.col("n_repeat_words") / words),
        F.log1p(100 * F.col("n_capitals") / chars),
    ]
    return [F.round(x * GRID).cast("int").alias(f"v{i}") for i, x in enumerate(rates)]


V = [f"v{i}" for i in range(DIM)]
GROUP = ["level", "lang_", "source_"]
RUN = [*GROUP, "start"]
PARTS = [f"m{i}" for i in range(DIM)] + [f"s{i}{j}" for j in range(DIM) for i in range(j, DIM)]
FACTORS = [f"l{i}{j}" for j in range(DIM) for i in range(j, DIM)]


def _factor(df: DataFrame) -> DataFrame:
    """Columns l00 ... from s00 ...; each is computed once."""
    for j in range(DIM):
        for i in range(j, DIM):
            rest = F.col(f"s{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return df


def distance(df: DataFrame) -> DataFrame:
    """Column d2: squared Mahalanobis distance of v0 ... from m0 ... under the factor l00 ..."""
    for i in range(DIM):
        z = F.col(f"v{i}") / GRID - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        df = df.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    squares = reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)])
    return df.withColumn("d2", squares).drop(*[f"z{i}" for i in range(DIM)])


def _moments(rows: DataFrame, n: Column, keys: list[str]) -> DataFrame:
    """Mean m0 ... and covariance s00 ... of weighted rows, FLOORS added."""
    x = [F.col(v) / GRID for v in V]
    sums = rows.groupBy(*keys).agg(n.alias("n"), F.sum("w").alias("h"), *[F.sum(x[i] * F.col("w")).alias(f"t{i}") for i in range(DIM)], *[F.sum(x[i] * x[j] * F.col("w")).alias(f"u{i}{j}") for j in range(DIM) for i in range(j, DIM)])
    return sums.select(*keys, "n", *[(F.col(f"t{i}") / F.col("h")).alias(f"m{i}") for i in range(DIM)], *[(F.col(f"u{i}{j}") / F.col("h") - F.col(f"t{i}") * F.col(f"t{j}") / F.col("h") / F.col("h") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for j in range(DIM) for i in range(j, DIM)])


def few(df: DataFrame) -> DataFrame:
    """A table of one row per group, stored, measured, and broadcast while it is small: points are then not dealt by group."""
    return broadcast_if_small(stored(df))


def fit(vectors: DataFrame) -> DataFrame:
    """One row per group of every level: n, centre m0 ..., factor l00 ..., scale.

    ``vectors`` holds GROUP, v0 ... and the number of rows ``w`` at that point.
    """
    median = [F.percentile(v, 0.5, F.col("w")).alias(f"c{i}") for i, v in enumerate(V)]
    centre = few(vectors.groupBy(*GROUP).agg(F.sum("w").alias("n"), *median))
    off = [F.percentile(F.abs(F.col(v) - F.col(f"c{i}")), 0.5, F.col("w")).alias(f"q{i}") for i, v in enumerate(V)]
    deviation = vectors.join(centre, GROUP).groupBy(*GROUP).agg(F.first("n").alias("n"), *[F.first(f"c{i}").alias(f"c{i}") for i in range(DIM)], *off)
    sigma = [F.greatest(1.4826 * F.col(f"q{i}") / GRID, F.lit(FLOORS[i])) for i in range(DIM)]
    robust = deviation.select(*GROUP, "n", *[(F.col(f"c{i}") / GRID).alias(f"m{i}") for i in range(DIM)], *[(sigma[i] * sigma[i] if i == j else F.lit(0.0)).alias(f"s{i}{j}") for j in range(DIM) for i in range(j, DIM)])
    starts = [robust.withColumn("start", F.lit(0)), _moments(vectors, F.sum("w"), GROUP).withColumn("start", F.lit(1))]
    estimate = few(_factor(reduce(DataFrame.unionByName, starts)))
    for _ in range(STEPS):
        before = estimate
        measured = distance(vectors.join(before, GROUP)).withColumn("bin", F.floor(F.log1p("d2") * BIN).cast("int")).select(*RUN, "n", *V, "w", "bin")
        near = measured.groupBy(*RUN).agg(F.percentile("bin", SUPPORT, F.col("w")).alias("within"))
        inner = measured.join(few(near), RUN).where(F.col("bin") <= F.ceil("within"))
        estimate = few(_factor(_moments(inner, F.first("n"), RUN)))
        moves = reduce(lambda a, b: a | b, [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > 1e-9 for c in PARTS])
        if not before.alias("a").join(estimate.alias("b"), RUN).where(moves).limit(1).count():
            break
    volume = reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in range(DIM)])
    estimate = few(estimate.groupBy(*GROUP).agg(F.min_by(F.struct("n", *PARTS, *FACTORS), F.struct(F.round(volume, 9), "start")).alias("best")).select(*GROUP, "best.*"))
    half = distance(vectors.join(estimate, GROUP)).withColumn("bin", F.floor(F.log1p("d2") * BIN).cast("int")).groupBy(*GROUP).agg(F.percentile("bin", 0.5, F.col("w")).alias("half"))
    scale = F.greatest((F.exp(F.col("half") / BIN) - 1) / CHI_MEDIAN, F.lit(1.0))
    return stored(estimate.join(half, GROUP).withColumn("scale", scale).drop("half"))


def with_verdict(counted: DataFrame, lang: Column, source: Column) -> DataFrame:
    """``counted`` with d2 (scaled squared distance) and kept; ``counted`` is read several times, so it should be stored."""
    columns = counted.columns
    rows = counted.select("*", *vector(), F.coalesce(lang, F.lit("")).alias("lang_"), F.coalesce(source, F.lit("")).alias("source_"))
    points = rows.groupBy("lang_", "source_", *V).agg(F.count("*").alias("w"))
    points = stored(points)
    every = reduce(DataFrame.unionByName, [
        points.withColumn("level", F.lit(0)),
        points.groupBy("lang_", *V).agg(F.sum("w").alias("w")).withColumns({"level": F.lit(1), "source_": F.lit("")}),
        points.groupBy(*V).agg(F.sum("w").alias("w")).withColumns({"level": F.lit(2), "lang_": F.lit(""), "source_": F.lit("")}),
    ])
    fitted = fit(stored(every))
    # each (language, source) takes its own estimate, or that of its language, or the one of all rows
    own = fitted.where("level = 0")
    by_lang = fitted.where("level = 1").select(F.col("lang_").alias("_l"), F.col("n").alias("_n"))
    level = own.select("lang_", "source_", "n").join(by_lang, F.col("lang_") == F.col("_l")).select("lang_", "source_", F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("_n") >= MIN_GROUP, 1).otherwise(2).alias("level"))
    chosen = level.select(F.col("lang_").alias("_lang"), F.col("source_").alias("_source"), "level", F.when(F.col("level") < 2, F.col("lang_")).otherwise("").alias("lang_"), F.when(F.col("level") < 1, F.col("source_")).otherwise("").alias("source_"))
    estimate = chosen.join(fitted.drop("n"), GROUP).drop(*GROUP).withColumnsRenamed({"_lang": "lang_", "_source": "source_"})
    measured = distance(rows.join(few(estimate), ["lang_", "source_"], "left"))
    worse = reduce(F.greatest, [F.col(f"v{i}") / GRID - F.col(f"m{i}") - FLOORS[i] for i in range(1, DIM)])
    outlier = F.coalesce((F.col("d2") / F.col("scale") > CUTOFF) & (worse > 0), F.lit(False))
    return measured.withColumns({"d2": F.col("d2") / F.col("scale"), "kept": ~F.col("base_failed") & ~outlier}).select(*columns, "d2", "kept")


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with the counts, base_failed, d2 and kept; columns of these names are replaced."""
    row = F.col("_row")
    counted = stored(with_counts(docs.select(F.struct(*docs.columns).alias("_row")), row[text_col]))
    new = [*BASE, "base_failed", "d2", "kept"]
    return with_verdict(counted, row[lang_col], row[source_col]).select(*[row[c].alias(c) for c in docs.columns if c not in new], *new)


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    counted = stored(with_counts(docs, F.col("text")).drop("text"))
    return with_verdict(counted, F.col("lang"), F.col("source")).select("doc_id", *BASE, "base_failed", "kept")
