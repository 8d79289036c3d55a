"""Shared building blocks: size-checked broadcast, picks, substring matching."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexmill.functions.text import NFKC_STABLE, nfkc

BROADCAST_BYTES = 64 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """Approximate width of a row of a narrow table."""
    widths = [F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) + 16 for c in df.columns]
    return reduce(lambda a, b: a + b, widths)


def text_bytes(df: DataFrame) -> int:
    """Size of a narrow table, measured, not guessed."""
    return int(df.agg(F.sum(row_bytes(df))).first()[0] or 0)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a join side for broadcast only after measuring it.

    Above the limit the side stays unmarked: Spark shuffles both sides by key
    and adaptive execution splits the partitions of hot keys.
    """
    return F.broadcast(df) if text_bytes(df) <= limit else df


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a scratch folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store an intermediate table in the shared folder and read it back.

    Later steps start from the stored rows, so a lost executor costs a re-read
    and not the whole plan, and the join planner knows the table's real size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lexmill/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    for owner in _OWNERS:
        owner.append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


_OWNERS: list[list[str]] = []


@contextmanager
def owned_cuts() -> Iterator[list[str]]:
    """The folders of all tables that ``cut_lineage`` stores inside the block, for their owner to drop."""
    mine: list[str] = []
    _OWNERS.append(mine)
    try:
        yield mine
    finally:
        _OWNERS[:] = [o for o in _OWNERS if o is not mine]


def roots(df: DataFrame) -> set[str]:
    """Folders and files that a DataFrame's plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out: set[str] = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            out |= set(leaf.relation().location().rootPaths().mkString("\n").split("\n"))
    return out


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared file system, and let Spark clean the shuffle files that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    jvm.System.gc()


def with_nfkc(df: DataFrame, column: str) -> DataFrame:
    """Compatibility form of a text column; only rows that it can change go to Python."""
    stable = F.coalesce(F.col(column).rlike(NFKC_STABLE), F.lit(True))
    return df.where(stable).unionByName(df.where(~stable).withColumn(column, nfkc(column)))


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Give a plain scan at least one task per core.

    A file with one row group is one task however much work each row needs.
    Such a scan is hash-partitioned by its key before that work; a table with
    more splits than cores, as any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.select(key).rdd.getNumPartitions() >= 4 * cores else df.repartition(4 * cores, key)


def first_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rn") -> DataFrame:
    """First n rows of every key.

    Filtering ``row_number`` by a constant lets Spark keep only n rows per key
    in each task before the shuffle, so a hot key never travels whole.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def running_totals(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with columns that sum each value over all rows before a row, in one global order.

    Rows are dealt by range and stored with their part; the parts' sums are
    added up first, then each part runs on alone. No window spans all rows.
    """
    dealt = cut_lineage(df.withColumns({f"_{n}": v for n, v in values.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in values])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumns({f"_local_{n}": F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in values})
    joined = local.join(base, F.col("_part") == F.col("_p"))
    return joined.withColumns({n: F.col(f"_base_{n}") + F.col(f"_local_{n}") for n in values}).select(*df.columns, *values)


def places_within(df: DataFrame, groups: list[str], order: list, name: str) -> DataFrame:
    """``df`` with each row's place (from 1) in its group, in an order that tells all rows apart.

    Rows are dealt by range of group and order and stored with their part; a
    part counts on from its group's rows in earlier parts. No task holds a group.
    """
    dealt = cut_lineage(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()))
    held = dealt.groupBy("_part", *groups).agg(F.count("*").alias("_rows"))
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = held.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    local = dealt.withColumn("_place", F.row_number().over(W.partitionBy("_part", *groups).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_part") == F.col("_p"))
    return local.join(base, same).select(*df.columns, (F.col("_base") + F.col("_place")).cast("int").alias(name))


def ordered_list(order: Column, value: Column) -> Column:
    """Aggregate: values of a bounded group in the given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Latest row of every key, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


ANCHORS = (256, 64, 16, 8, 4, 2, 1)
TEXT_BLOCK = 64


def anchor_length(term: Column) -> Column:
    """Longest of the anchor lengths that a term has."""
    length = F.length(term)
    out = None
    for n in ANCHORS[:-1]:
        out = F.when(length >= n, n) if out is None else out.when(length >= n, n)
    return out.otherwise(1)


def overlapping_blocks(text: Column, longest: int, size: int = TEXT_BLOCK) -> Column:
    """Array of (n, text): blocks of n characters, each with the ``longest`` - 1 characters that follow it."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.element_at(F.transform(F.array(cut), lambda bs: F.transform(bs, lambda b, i: F.struct(
        F.length(b).alias("n"), F.concat(b, F.left(F.coalesce(F.get(bs, i + 1), F.lit("")), F.lit(longest - 1))).alias("text")))), 1)


FILTER_BITS = 1 << 27


def _probes(word: Column, bits: int) -> list[Column]:
    """Places of a string in a set of bits."""
    h = F.xxhash64(word)
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def anchor_filter(strings: DataFrame, rows: int, most: int = FILTER_BITS) -> Callable[[Column], Column]:
    """Test whether a string may be in the only column of ``strings`` (never wrong about one that is).

    The set of bits is built by aggregation, has at most ``most`` bits and
    reaches the tasks as one array value.
    """
    bits = min(most, 1 << max(12, (16 * rows).bit_length()))
    places = strings.select(F.explode(F.array(*_probes(F.col(strings.columns[0]), bits))).alias("p"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(mask).alias("b"))
    every = strings.sparkSession.range(0, bits // 64, 1, 1).withColumnRenamed("id", "w").join(words, "w", "left")
    held = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"])).scalar()

    def test(string: Column) -> Column:
        bit = lambda p: F.call_function("getbit", F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
        return reduce(lambda a, b: a & b, [bit(p) for p in _probes(string, bits)])

    return test


def find_terms(texts: DataFrame, keep: list[str], text_col: str, terms: DataFrame) -> DataFrame:
    """Rows of ``terms`` for every term that occurs inside a text.

    ``keep`` names the narrow columns of ``texts`` (id, lengths) that go with
    each hit; the pieces that ``term_pieces`` finds meet the terms by equality.
    """
    terms = terms.where(F.length("term") > 0)
    pieces = term_pieces(texts, keep, text_col, terms)
    if pieces is None:
        return texts.select(*keep).limit(0).join(terms.limit(0), F.lit(True))
    return pieces.distinct().join(broadcast_if_small(terms), "term")


ALPHABET = 500


def _compact(text: Column, words: DataFrame) -> Column:
    """The text's stretches of characters that terms have, each once; it holds the same terms as the text.

    Terms of more than ``ALPHABET`` characters leave the text as it is.
    """
    characters = words.select(F.explode(F.regexp_extract_all("term", F.lit("(?s)."), F.lit(0))).alias("c")).distinct().limit(ALPHABET + 1)
    codes = {ord(r["c"]) for r in characters.collect()}
    if len(codes) > ALPHABET:
        return text
    between = next(chr(c) for c in range(1, ALPHABET + 2) if c not in codes)
    stretch = "[" + "".join(f"\\x{{{c:x}}}" for c in sorted(codes)) + "]+"
    return F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(stretch), F.lit(0))), between)


def term_pieces(texts: DataFrame, keep: list[str], text_col: str, terms: DataFrame) -> DataFrame | None:
    """(keep..., term): every piece of a text that is a term, perhaps repeated, and few that are none.

    Without any term, None. A text is cut into blocks and each position of a
    block is a row. Terms are classed by an anchor, their first 256, 64, 16, 8,
    4, 2 or 1 characters; a set of bits of the anchors drops most positions of
    a class. What is left takes the lengths that terms of the class have, and a
    set of bits of the whole terms drops nearly all pieces that are none. No
    piece meets terms that only begin alike, and nothing is shuffled.
    Positions are code points, so no code point is cut.
    """
    words = cut_lineage(terms.where(F.length("term") > 0).select("term").distinct())
    anchored = words.withColumn("n", anchor_length(F.col("term"))).withColumn("anchor", F.left("term", F.col("n")))
    longest, rows = anchored.agg(F.max(F.length("term")), F.count("*")).first()
    if not rows:
        return None
    anchors = anchored.select("anchor").distinct()
    classes: dict[int, list[int]] = {}
    for n, length in anchored.select("n", F.length("term")).distinct().collect():  # at most the longest term's length in rows
        classes.setdefault(n, []).append(length)
    begins, whole = anchor_filter(anchors, anchors.count()), anchor_filter(words, rows)
    block = max(TEXT_BLOCK, 2 * longest)
    blocks = texts.select(*keep, F.explode(overlapping_blocks(_compact(F.col(text_col), words), longest, block)).alias("_b"))
    places = blocks.select(*keep, F.col("_b.text").alias("_text"), F.explode(F.sequence(F.lit(1), F.col("_b.n"))).alias("_i"))
    near = min(longest, ANCHORS[2])
    starts = places.withColumn("_piece", F.substring("_text", F.col("_i"), F.lit(near)))

    def piece(n: Column) -> Column:
        own = F.left("_piece", n)
        return own if longest <= near else F.when(n <= near, own).otherwise(F.substring("_text", F.col("_i"), n))

    # one row a class keeps the test one short expression; a single character counts where it first stands in its block
    classed = starts.withColumn("_a", F.explode(F.array(*[F.lit(n) for n in sorted(classes)])))
    own = piece(F.col("_a"))
    begun = classed.where((F.length(own) == F.col("_a")) & begins(own) & ((F.col("_a") > 1) | (F.instr(F.col("_text"), own) == F.col("_i"))))
    lengths = F.create_map(*[x for n, ks in sorted(classes.items()) for x in (F.lit(n), F.array(*[F.lit(k) for k in sorted(ks)]))])
    tried = begun.withColumn("_n", F.explode(F.element_at(lengths, F.col("_a"))))
    found = tried.select(*keep, "_n", piece(F.col("_n")).alias("term"))
    return found.where((F.length("term") == F.col("_n")) & whole(F.col("term"))).select(*keep, "term")
