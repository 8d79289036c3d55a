"""Text functions over the words and whole texts of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import feeds as fd
from lexmill import fixed
from lexmill.functions import romaji as ro
from lexmill.functions import text as tx

SEP = fixed.LIST_SEPARATOR


def q_search_text(spark, sf):
    """Search form of whole documents written in katakana."""
    d = fd.documents(spark, sf)
    return d.select("doc_id", F.md5(tx.normalize_search(fd.kata(F.lower("text")))).alias("digest"))


SQL_SEARCH_TEXT = f"SELECT doc_id, md5(translate(lower(text), '{fd.LETTERS}', '{fd.HIRA}')) AS digest FROM documents"


def q_match_keys(spark, sf):
    p = fd.table(spark, sf, "part")
    return p.select("p_partkey", tx.normalize_japanese(F.concat(F.lit("　"), fd.kata("p_name"), F.lit(" "))).alias("match_key"))


SQL_MATCH_KEYS = f"SELECT p_partkey, translate(replace(p_name, ' ', ''), '{fd.LETTERS}', '{fd.HIRA}') AS match_key FROM part"


def q_collapsed_text(spark, sf):
    return fd.documents(spark, sf).select("doc_id", F.md5(tx.collapse("text")).alias("digest"), F.length(tx.clean("text")).alias("n"))


SQL_COLLAPSED = r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS digest,
  CAST(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS INTEGER) AS n FROM documents"""


def q_list_fields(spark, sf):
    d = fd.documents(spark, sf).select("doc_id", F.replace("text", F.lit("."), F.lit("；")).alias("t"))
    parts = tx.split_list("t")
    return d.select("doc_id", F.size(parts).alias("items"), F.size(tx.non_empty(parts)).alias("distinct_items"),
                    F.md5(tx.join_list(tx.non_empty(parts))).alias("digest"))


SQL_LIST_FIELDS = r"""
WITH p AS (SELECT doc_id, string_split(replace(text, '.', '；'), '；') AS a FROM documents),
u AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS i FROM p),
t AS (SELECT doc_id, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS x FROM u),
k AS (SELECT * FROM t WHERE x <> ''),
f AS (SELECT doc_id, x, min(i) AS i FROM k GROUP BY doc_id, x)
SELECT d.doc_id, CAST((SELECT count(*) FROM k WHERE k.doc_id = d.doc_id) AS INTEGER) AS items,
  CAST((SELECT count(*) FROM f WHERE f.doc_id = d.doc_id) AS INTEGER) AS distinct_items,
  md5(coalesce((SELECT string_agg(x, '；' ORDER BY i) FROM f WHERE f.doc_id = d.doc_id), '')) AS digest FROM documents d"""


def q_numbers(spark, sf):
    o = fd.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), "o_orderstatus")).otherwise(
        F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")))
    return o.select("o_orderkey", tx.maybe_int(raw).alias("whole"), tx.maybe_float(raw).alias("real"))


SQL_NUMBERS = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(trunc(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) END AS whole,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS real FROM orders"""


def q_script_classes(spark, sf):
    v = fd.vocabulary(spark, sf).select("w", F.when(F.length("w") % 2 == 0, fd.kanji_form("w")).otherwise(fd.kata("w")).alias("t"))
    return v.select("w", tx.has_kanji("t").alias("kanji"), tx.has_kana("t").alias("kana"), tx.kana_only("t").alias("kana_only"),
                    tx.has_japanese("t").alias("japanese"), tx.has_latin("t").alias("latin"), F.array_join(tx.kanji_characters("t"), "").alias("chars"),
                    F.array_join(tx.kanji_runs("t"), "/").alias("runs"))


_T = f"CASE WHEN length(w) % 2 = 0 THEN {fd.SQL_KANJI_FORM} ELSE translate(w, '{fd.LETTERS}', '{fd.KATA}') END"
SQL_SCRIPTS = "WITH " + fd.SQL_VOCAB + f""", x AS (SELECT w, {_T} AS t FROM vocab),
c AS (SELECT w, t, regexp_extract_all(t, '[{fixed.CJK}]') AS a, regexp_extract_all(t, '[{fixed.CJK}]+') AS r FROM x)
SELECT w, regexp_matches(t, '[{fixed.CJK}]') AS kanji, regexp_matches(t, '[{fixed.KANA}]') AS kana, regexp_matches(t, '{fixed.KANA_ONLY}') AS kana_only,
  regexp_matches(t, '[{fixed.KANA}{fixed.CJK}]') AS japanese, regexp_matches(t, '[A-Za-z]') AS latin,
  CASE WHEN len(a) = 2 AND a[1] = a[2] THEN a[1] ELSE array_to_string(a, '') END AS chars,
  CASE WHEN len(r) = 2 AND r[1] = r[2] THEN r[1] ELSE array_to_string(r, '/') END AS runs FROM c"""

# Kana for the romaji query: digraph parts, the small tsu and the long mark occur.
ROMAJI_KANA = "あびくどえふぎはきじかりめにおぱっれしちうゔわゃょー"


def q_romaji(spark, sf):
    v = fd.vocabulary(spark, sf).select("w", F.translate("w", fd.LETTERS, ROMAJI_KANA).alias("kana"))
    roma = ro.kana_to_romaji("kana")
    return v.select("w", roma.alias("romaji"), F.array_join(ro.romaji_variants(roma), SEP).alias("variants"))


def _romaji_sql():
    expr = f"translate(w, '{fd.LETTERS}', '{ROMAJI_KANA}')"
    for table in (fixed.ROMAJI_PAIRS, fixed.ROMAJI_SINGLES):
        for kana, latin in table.items():
            if all(c in ROMAJI_KANA for c in kana):
                expr = f"replace({expr}, '{kana}', '{latin}')"
    expr = f"replace(regexp_replace({expr}, 'っ([a-z])', '\\1\\1', 'g'), 'っ', '')"
    for _ in range(12):
        expr = f"regexp_replace({expr}, '([aeiou])([^aeiouー]*)ー', '\\1\\2\\1', 'g')"
    return f"replace({expr}, 'ー', '')"


SQL_ROMAJI = "WITH " + fd.SQL_VOCAB + f""", r AS (SELECT w, {_romaji_sql()} AS romaji FROM vocab),
c AS (SELECT w, romaji, regexp_replace(romaji, '[^a-z0-9]', '', 'g') AS x FROM r),
f AS (SELECT *, replace(replace(replace(replace(x, 'shi', 'si'), 'chi', 'ti'), 'tsu', 'tu'), 'fu', 'hu') AS y,
  replace(replace(replace(replace(x, 'ou', 'o'), 'oo', 'o'), 'uu', 'u'), 'ei', 'e') AS z FROM c)
SELECT w, romaji, CASE WHEN x = '' THEN '' ELSE x || CASE WHEN y <> x THEN '{SEP}' || y ELSE '' END
  || CASE WHEN z <> x AND z <> y THEN '{SEP}' || z ELSE '' END END AS variants FROM f"""


def q_gloss_keys(spark, sf):
    b = fd.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\. ")).alias("t"))
    wrapped = F.concat(F.lit("  Fig. "), "t", F.lit(" (note) sb sth. "))
    return b.select("conv_id", "turn", F.md5(tx.gloss_key("t")).alias("k1"), F.md5(tx.definition_key(wrapped)).alias("k2"),
                    F.size(tx.latin_tokens("t")).alias("latin"))


SQL_GLOSS_KEYS = r"""
WITH p AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS t FROM conversations),
x AS (SELECT *, replace(replace(regexp_replace(regexp_replace('  Fig. ' || t || ' (note) sb sth. ', '\s*\([^)]*\)', '', 'g'), '^\s+|\s+$', '', 'g'), 'sb', 'somebody'), 'sth', 'something') AS d FROM p),
y AS (SELECT *, regexp_replace(regexp_replace(d, '(?i)\b(fig|lit)\.\s*', '', 'g'), '\bCL:.*', '', 'g') AS e FROM x)
SELECT conv_id, turn, md5(regexp_replace(lower(regexp_replace(t, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS k1,
  md5(regexp_replace(lower(regexp_replace(regexp_replace(e, '^[ .;:,]+|[ .;:,]+$', '', 'g'), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS k2,
  CAST(len(list_filter(regexp_extract_all(t, '[A-Za-z][A-Za-z-]*(?:''[A-Za-z]+)?'), lambda z: lower(z) NOT IN ('e', 'g', 'eg', 'etc'))) AS INTEGER) AS latin FROM y"""


def q_translation_lists(spark, sf):
    c = fd.table(spark, sf, "conversations")
    raw = F.array(F.concat(F.lit("1. "), F.replace("text", F.lit(", "), F.lit("；")), F.lit("; N/A ")))
    return c.select("conv_id", "turn", F.md5(F.array_join(tx.translation_items(raw), "|")).alias("items"),
                    F.md5(tx.compact_translation(F.replace("text", F.lit("."), F.lit("；")))).alias("compact"))


SQL_TRANSLATION_LISTS = r"""
WITH s AS (SELECT conv_id, turn, regexp_split_to_array('1. ' || replace(text, ', ', '；') || '; N/A ', '\s*[;；]\s*|\n+') AS a, text FROM conversations),
u AS (SELECT conv_id, turn, unnest(a) AS raw, generate_subscripts(a, 1) AS i FROM s),
t AS (SELECT conv_id, turn, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '^\d+[.)、]\s*', ''),
   '^[ 。.;；]+|[ 。.;；]+$', '', 'g') AS x FROM u),
k AS (SELECT conv_id, turn, x, min(i) AS i FROM t WHERE x <> '' AND lower(x) NOT IN ('n/a', 'none', 'null') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS rn FROM k),
j AS (SELECT conv_id, turn, string_agg(x, '|' ORDER BY rn) AS items FROM r WHERE rn <= 5 GROUP BY ALL),
c AS (SELECT conv_id, turn, replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '.', '；'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '^[。.;； ]+|[。.;； ]+$', '', 'g'), '；', '、') AS z FROM conversations)
SELECT c.conv_id, c.turn, md5(coalesce(items, '')) AS items, md5(CASE WHEN z = '' THEN '待译' ELSE z END) AS compact
FROM c LEFT JOIN j USING (conv_id, turn)"""


def q_writing_variants(spark, sf):
    p = fd.table(spark, sf, "part")
    raw = F.concat(F.when(F.col("p_size") % 2 == 0, "お・").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("／")), F.lit("  "), F.lower("p_type"))
    reading = F.concat(F.replace(fd.kata("p_name"), F.lit(" "), F.lit("、")), F.lit("（"), "p_type", F.lit("）"))
    return p.select("p_partkey", F.array_join(tx.writing_variants(raw), "|").alias("writings"),
                    F.array_join(tx.reading_variants(reading, "p_brand"), "|").alias("readings"))


SQL_WRITING_VARIANTS = f"""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'お' || a || '|' || a ELSE a END || CASE WHEN b <> a THEN '|' || b ELSE '' END
  || CASE WHEN t NOT IN (a, b) THEN '|' || t ELSE '' END AS writings,
  ka || CASE WHEN kb <> ka THEN '|' || kb ELSE '' END AS readings
FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(p_type) AS t,
  translate(split_part(p_name, ' ', 1), '{fd.LETTERS}', '{fd.KATA}') AS ka, translate(split_part(p_name, ' ', 2), '{fd.LETTERS}', '{fd.KATA}') AS kb FROM part)"""


def q_attributive_forms(spark, sf):
    p = fd.table(spark, sf, "part")
    text = F.concat(F.translate(F.split("p_name", " ")[0], fd.LETTERS, fd.KANJI), F.lit("；"), F.translate("p_type", "ECONMYSALRDU", fd.KANJI[:12]),
                    F.when(F.col("p_size") % 3 == 0, "的；").otherwise(""), F.when(F.col("p_size") % 5 == 0, "、待译").otherwise(""))
    major = F.when(F.col("p_size") % 2 == 0, fixed.I_ADJ).otherwise(fixed.NOUN)
    return p.select("p_partkey", tx.adjust_for_pos(text, major).alias("adjusted"))


SQL_ATTRIBUTIVE = f"""
SELECT p_partkey, CASE WHEN p_size % 2 <> 0 THEN a || '；' || b || CASE WHEN p_size % 3 = 0 THEN '的；' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN '、待译' ELSE '' END
  ELSE a || CASE WHEN length(a) <= 8 THEN '的' ELSE '' END || '；' || b || CASE WHEN p_size % 3 = 0 THEN '的；' WHEN length(b) <= 8 THEN '的' ELSE '' END
    || CASE WHEN p_size % 5 = 0 THEN '、待译' ELSE '' END END AS adjusted
FROM (SELECT *, translate(split_part(p_name, ' ', 1), '{fd.LETTERS}', '{fd.KANJI}') AS a, translate(p_type, 'ECONMYSALRDU', '{fd.KANJI[:12]}') AS b FROM part)"""

FULL = "".join(chr(0xFF41 + i) for i in range(26))
#: Compatibility forms and what they stand for, dealt by part key: half-width kana with marks, a circled digit, a mark apart, a unit.
COMPATIBLE = (("ｶﾞﾊﾟｯ", "がぱっ"), ("①ｦｰ", "1をー"), ("カ\u3099e\u0301", "がé"), ("㎏　Ⅳ", "kg iv"))


def _compatible(n, values) -> F.Column:
    out = F.lit(values[0])
    for i, v in enumerate(values[1:], 1):
        out = F.when(n % len(values) == i, v).otherwise(out)
    return out


def q_compatibility_forms(spark, sf):
    """Full-width names with half-width kana, composed marks and signs: search form, reading key, distinct readings."""
    p = fd.table(spark, sf, "part")
    text = F.concat(F.translate("p_name", fd.LETTERS, FULL), F.lit("　"), _compatible(F.col("p_partkey"), [c for c, _ in COMPATIBLE]))
    key = F.concat(fd.kata("p_name"), F.lit(".‐－"), F.translate("p_name", fd.LETTERS, FULL))
    lists = F.concat("p_brand", F.lit("、 "), "p_type", F.lit(","), "p_brand", F.lit("，,"), "p_name")
    return p.select("p_partkey", tx.normalize_search(text).alias("search"), tx.kanji_reading_key(key).alias("reading_key"),
                    F.array_join(tx.split_readings(lists), SEP).alias("readings"))


_PLAIN = "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN '{plain}'" for i, (_, plain) in enumerate(COMPATIBLE)) + " END"
SQL_COMPATIBLE = f"""SELECT p_partkey, p_name || ' ' || {_PLAIN} AS search,
  translate(replace(p_name, ' ', ''), '{fd.LETTERS}', '{fd.HIRA}') || replace(p_name, ' ', '') AS reading_key, p_brand || '{SEP}' || p_type || '{SEP}' || p_name AS readings FROM part"""

QUERIES = {
    "compatibility_forms": (q_compatibility_forms, SQL_COMPATIBLE),
    "search_text": (q_search_text, SQL_SEARCH_TEXT),
    "match_keys": (q_match_keys, SQL_MATCH_KEYS),
    "collapsed_text": (q_collapsed_text, SQL_COLLAPSED),
    "list_fields": (q_list_fields, SQL_LIST_FIELDS),
    "numbers": (q_numbers, SQL_NUMBERS),
    "script_classes": (q_script_classes, SQL_SCRIPTS),
    "romaji": (q_romaji, SQL_ROMAJI),
    "gloss_keys": (q_gloss_keys, SQL_GLOSS_KEYS),
    "translation_lists": (q_translation_lists, SQL_TRANSLATION_LISTS),
    "writing_variants": (q_writing_variants, SQL_WRITING_VARIANTS),
    "attributive_forms": (q_attributive_forms, SQL_ATTRIBUTIVE),
}
