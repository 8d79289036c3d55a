"""Source readers.

Each returns a DataFrame and triggers no job. Row order inside a file, where a
rule depends on it, travels as ``line_ord`` = (file, block offset, row id),
which stays right when a file is read in several splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill import fixed
from lexmill.functions.classify import joyo_label
from lexmill.functions.text import clean, maybe_float, maybe_int, split_list, strip, translation_items
from lexmill.functions import text as tx
from lexmill.operators.common import last_per_key

ENTITY_MARK = "\ue000"
DICTIONARY_XML = (
    "ent_seq STRING,"
    "k_ele ARRAY<STRUCT<keb: STRING, ke_pri: ARRAY<STRING>>>,"
    "r_ele ARRAY<STRUCT<reb: STRING, re_pri: ARRAY<STRING>>>,"
    "sense ARRAY<STRUCT<pos: ARRAY<STRING>, misc: ARRAY<STRING>, dial: ARRAY<STRING>, field: ARRAY<STRING>,"
    " gloss: ARRAY<STRUCT<_VALUE: STRING, `_xml:lang`: STRING>>>>"
)
KANJI_XML = (
    "literal STRING, misc STRUCT<grade: STRING>,"
    "reading_meaning STRUCT<rmgroup: ARRAY<STRUCT<reading: ARRAY<STRUCT<_VALUE: STRING, _r_type: STRING>>>>>"
)


def with_line_order(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_ord"),
    )


def _fragments(spark: SparkSession, path: str, element: str, partitions: int | None) -> DataFrame:
    """One row per XML element, cut at its end tag.

    A gzip file arrives in one task, so the raw fragments are spread out
    before any parsing.
    """
    raw = spark.read.option("lineSep", f"</{element}>").text(path)
    parts = raw.select(
        F.monotonically_increasing_id().alias("doc_pos"),
        F.regexp_extract("value", rf"(?s)<{element}>(.*)$", 1).alias("body"),
    ).where(F.col("body") != "")
    spread = parts.repartition(partitions) if partitions else parts.repartition("doc_pos")
    return spread.select("doc_pos", F.concat(F.lit(f"<{element}>"), "body", F.lit(f"</{element}>")).alias("xml"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """(code, label) from the document type definition of a dictionary file."""
    pattern = r'<!ENTITY\s+(\S+)\s+"([^"]*)"\s*>'
    return (
        spark.read.text(path)
        .where(F.col("value").contains("<!ENTITY"))
        .select(F.regexp_extract("value", pattern, 1).alias("code"), F.regexp_extract("value", pattern, 2).alias("label"))
        .where(F.col("code") != "")
        .distinct()
    )


def read_dictionary(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Dictionary XML as (doc_pos, ent_seq, written, spoken, senses).

    Entity references are marked before parsing and expanded from the
    document's own table afterwards.
    """
    named = r"&(?!(?:amp|lt|gt|quot|apos|#\w+);)([^;\s&]+);"
    parsed = _fragments(spark, path, "entry", partitions).select(
        "doc_pos",
        F.from_xml(F.regexp_replace("xml", named, f"{ENTITY_MARK}$1{ENTITY_MARK}"), F.lit(DICTIONARY_XML)).alias("e"),
    )
    entries = shape_dictionary(parsed.select("doc_pos", "e.*"))
    return expand_entities(entries, read_entities(spark, path))


def _texts(items: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.transform(items, strip), lambda x: x != ""), empty)


def shape_dictionary(raw: DataFrame) -> DataFrame:
    """Raw element columns to the entry shape the lexicon operators take."""
    return raw.select(
        "doc_pos",
        strip("ent_seq").alias("ent_seq"),
        F.filter(
            F.transform(
                F.coalesce("k_ele", F.array().cast("array<struct<keb:string,ke_pri:array<string>>>")),
                lambda k: F.struct(strip(k["keb"]).alias("text"), _texts(k["ke_pri"]).alias("tags")),
            ),
            lambda k: k["text"] != "",
        ).alias("written"),
        F.filter(
            F.transform(
                F.coalesce("r_ele", F.array().cast("array<struct<reb:string,re_pri:array<string>>>")),
                lambda r: F.struct(strip(r["reb"]).alias("text"), _texts(r["re_pri"]).alias("tags")),
            ),
            lambda r: r["text"] != "",
        ).alias("spoken"),
        F.transform(
            "sense",
            lambda s: F.struct(
                _texts(s["pos"]).alias("pos"),
                _texts(s["misc"]).alias("misc"),
                _texts(s["dial"]).alias("dial"),
                _texts(s["field"]).alias("field"),
                F.transform(
                    F.coalesce(s["gloss"], F.array().cast("array<struct<_VALUE:string,`_xml:lang`:string>>")),
                    lambda g: F.struct(g["_VALUE"].alias("text"), g["_xml:lang"].alias("lang")),
                ).alias("gloss"),
            ),
        ).alias("senses"),
    )


def expand_entities(entries: DataFrame, entities: DataFrame) -> DataFrame:
    """Replace marked entity codes inside the sense labels by their labels.

    The code table comes from one document header, so it is aggregated into a
    single map value and looked up in place; no row of the dictionary moves.
    """
    table = entities.select(
        F.map_from_entries(F.collect_list(F.struct("code", "label"))).alias("m")
    ).scalar()
    with_table = entries.withColumn("_entities", table)
    mark = ENTITY_MARK

    def expand(x, m):
        code = F.regexp_extract(x, f"^{mark}(.*){mark}$", 1)
        return F.when(code == "", x).otherwise(F.coalesce(F.try_element_at(m, code), code))

    m = F.col("_entities")
    labels = lambda items: F.transform(items, lambda x: expand(x, m))
    return with_table.withColumn(
        "senses",
        F.transform(
            "senses",
            lambda s: F.struct(
                labels(s["pos"]).alias("pos"),
                labels(s["misc"]).alias("misc"),
                labels(s["dial"]).alias("dial"),
                labels(s["field"]).alias("field"),
                s["gloss"].alias("gloss"),
            ),
        ),
    ).drop("_entities")


def read_kanji(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Character XML as (kanji, grade, status, on_readings, kun_readings)."""
    k = _fragments(spark, path, "character", partitions).select(F.from_xml("xml", F.lit(KANJI_XML)).alias("k"))
    readings = F.flatten(F.transform("k.reading_meaning.rmgroup", lambda g: g["reading"]))

    def of_type(name):
        found = F.filter(readings, lambda r: (r["_r_type"] == name) & (r["_VALUE"] != ""))
        return F.coalesce(F.array_join(F.array_distinct(F.transform(found, lambda r: r["_VALUE"])), "、"), F.lit(""))

    grade = F.coalesce(F.col("k.misc.grade"), F.lit(""))
    return k.where(F.coalesce(F.col("k.literal"), F.lit("")) != "").select(
        F.col("k.literal").alias("kanji"),
        grade.alias("grade"),
        joyo_label(grade).alias("status"),
        of_type("ja_on").alias("on_readings"),
        of_type("ja_kun").alias("kun_readings"),
    )


def read_frequency(spark: SparkSession, path: str, max_rank: int | None = None) -> DataFrame:
    """Frequency list, whatever the row order; with ``max_rank`` the rows up to that rank."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    ranked = with_line_order(raw).withColumn("rank", F.col("rank").try_cast("int"))
    within = F.col("rank") <= max_rank if max_rank is not None else F.col("rank").isNotNull()
    return ranked.where(within).select(
        "rank", "lemma", F.col("lForm").alias("form"), F.col("pos").alias("freq_pos"),
        F.col("frequency").alias("freq_count"), F.col("pmw").alias("freq_pmw"), "line_ord",
    )


def read_bilingual(spark: SparkSession, path: str) -> DataFrame:
    """Bilingual dictionary lines as (traditional, simplified, definitions, line_ord)."""
    pattern = r"^(\S+)\s+(\S+)\s+\[[^\]]+\]\s+/(.+)/$"
    line = strip("value")
    return (
        with_line_order(spark.read.text(path))
        .where((line != "") & ~line.startswith("#") & line.rlike(pattern))
        .select(
            F.regexp_extract(line, pattern, 1).alias("traditional"),
            F.regexp_extract(line, pattern, 2).alias("simplified"),
            F.regexp_extract(line, pattern, 3).alias("definitions"),
            "line_ord",
        )
    )


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(sentence_id, lang, text); the last row of a repeated id stays.

    A field in quotes is read whole with doubled quotes as one. A quote that is
    never closed takes the rest of its line.
    """
    raw = with_line_order(spark.read.option("sep", "\t").option("quote", '"').option("escape", '"').schema("sentence_id STRING, lang STRING, text STRING").csv(path))
    rows = raw.where(F.col("text").isNotNull()).withColumn("text", strip("text"))
    return last_per_key(rows, ["sentence_id"], F.col("line_ord")).drop("line_ord")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    raw = with_line_order(spark.read.option("sep", "\t").schema("src STRING, dst STRING").csv(path))
    return raw.where(F.col("dst").isNotNull())


def _table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV/TSV with header. A byte-order mark in front of the header is dropped."""
    df = (
        spark.read.option("header", True).option("sep", sep).option("multiLine", sep == ",")
        .option("escape", '"').csv(path)
    )
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def read_master(spark: SparkSession, path: str, levels: list[str] | None = None) -> DataFrame:
    """Master lexicon CSV back into typed columns and arrays."""
    raw = _table(spark, path)
    lists = {"pos", "kanji", "writings", "readings", "tags", "glosses", "translation"}
    ints = {"freq_rank", "freq_count"}
    cols = []
    for published, name in fixed.MASTER_COLUMNS.items():
        if published not in raw.columns:
            continue
        c = F.col(f"`{published}`")
        if name in lists:
            value = split_list(c)
        elif name in ints:
            value = maybe_int(c)
        elif name == "freq_pmw":
            value = maybe_float(c)
        else:
            value = clean(c)
        cols.append(value.alias(name))
    out = raw.select(*cols)
    return out.where(F.col("level").isin(levels)) if levels else out


def _keyed(spark: SparkSession, path: str, columns: dict[str, str], required: str, sep: str) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    raw = with_line_order(raw)
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    rows = raw.select(*[strip(F.coalesce(F.col(f"`{p}`"), F.lit(""))).alias(n) for p, n in columns.items()], "line_ord")
    rows = rows.where((F.col("entry_id") != "") & (F.col(required) != ""))
    return last_per_key(rows, ["entry_id"], F.col("line_ord")).drop("line_ord")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return _keyed(spark, path, fixed.OVERRIDE_COLUMNS, "translation", "\t")


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    return _keyed(spark, path, fixed.LEVEL_COLUMNS, "ref_level", ",")


QUEUE_SCHEMA = (
    "id STRING, level STRING, word STRING, reading STRING, major STRING, subpos STRING, glosses ARRAY<STRING>,"
    " draft_translation STRING, min_confidence DOUBLE, methods ARRAY<STRING>, instruction STRING"
)


def read_repair_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUEUE_SCHEMA).json(path)


def read_translation_cache(spark: SparkSession, path: str) -> DataFrame:
    """Latest usable record per id from the append-only cache.

    Lines are read as text, so malformed JSON gives NULL and drops out, and a
    translation may be a string or a list.
    """
    raw = with_line_order(spark.read.text(path))
    return cache_records(raw.withColumn("line", F.col("value")))


def cache_records(lines: DataFrame) -> DataFrame:
    json = F.try_parse_json("line")
    get = lambda name, kind="string": F.try_variant_get(F.col("v"), f"$.{name}", kind)
    parsed = lines.select(json.alias("v"), "line_ord").where(F.col("v").isNotNull())
    translations = translation_items(
        F.coalesce(get("translation", "array<string>"), F.array(get("translation")), F.array().cast("array<string>"))
    )
    rows = parsed.select(
        tx.collapse(F.coalesce(get("id"), F.lit(""))).alias("entry_id"),
        get("word").alias("word"),
        get("reading").alias("reading"),
        translations.alias("translation"),
        get("source").alias("source"),
        get("model").alias("model"),
        get("createdAt").alias("created_at"),
        "line_ord",
    ).where((F.col("entry_id") != "") & (F.size("translation") > 0))
    return last_per_key(rows, ["entry_id"], F.col("line_ord")).drop("line_ord")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """Character variants from a text of ``|``-joined groups.

    (kanji, variant, ord). A character that repeats keeps its last group.
    """
    groups = with_line_order(spark.read.text(path)).select(
        F.posexplode(F.split("value", r"\|")).alias("group_pos", "members"), "line_ord"
    )
    return variant_pairs(groups.select("members", F.struct("line_ord", "group_pos").alias("ord")))


def variant_pairs(groups: DataFrame) -> DataFrame:
    chars = F.array_distinct(tx.characters("members"))
    owned = groups.select(chars.alias("chars"), "ord").where(F.size("chars") >= 2)
    owned = owned.select(F.explode("chars").alias("kanji"), "chars", "ord")
    last = owned.groupBy("kanji").agg(F.max_by("chars", "ord").alias("chars"))
    return last.select(
        "kanji", F.posexplode(F.filter("chars", lambda c: c != F.col("kanji"))).alias("ord", "variant")
    )


def read_study_data(spark: SparkSession, path: str) -> DataFrame:
    """Study lists of exported JSON files as (file, entry_id, status).

    Reads single documents with two lists and, below a folder per status, the
    rows that ``write_study_data`` gives.
    """
    lists = "progress STRUCT<starred: ARRAY<STRING>, learned: ARRAY<STRING>>"
    raw = spark.read.schema(lists).option("multiLine", True).json(path).select("progress", F.col("_metadata.file_path").alias("file"))
    tagged = lambda name: F.transform(F.coalesce(F.col(f"progress.{name}"), F.array().cast("array<string>")), lambda x: F.struct(x.alias("entry_id"), F.lit(name).alias("status")))
    whole = raw.select("file", F.explode(F.concat(tagged("starred"), tagged("learned"))).alias("r")).select("file", "r.*")
    own = spark.read.schema("entry_id STRING").json(path).select(F.col("_metadata.file_path").alias("file"), "entry_id")
    rows = own.withColumn("status", F.regexp_extract("file", "/status=([a-z]+)/", 1)).where(F.col("status") != "")
    return whole.unionByName(rows).where(F.col("entry_id") != "").distinct()


def read_level_lists(spark: SparkSession, path: str) -> DataFrame:
    """Decoded level-list table: level, q, a, source_file, source_url."""
    return with_line_order(_table(spark, path))
