"""Grading, classification and the tables built from the lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from checks import feeds as fd
from lexmill import fixed
from lexmill.functions import classify as cl
from lexmill.operators import facets as fc
from lexmill.operators import kanji as kj
from lexmill.operators import lexicon as lx
from lexmill.operators.frequency import frequency_keys
from lexmill.plans.publish import cluster_order, export_tables
from lexmill.sources import sinks

SEP = fixed.LIST_SEPARATOR


def classified(spark, sf) -> DataFrame:
    return lx.classify_entries(fd.dictionary(spark, sf), frequency_keys(fd.frequency_list(spark, sf)))


def stored_classified(spark, sf) -> DataFrame:
    return fd.stored(spark, sf, "classified", classified)


def lexicon(spark, sf) -> DataFrame:
    return lx.accepted(stored_classified(spark, sf))


def tree(spark, sf) -> DataFrame:
    return lx.kanji_tree(lexicon(spark, sf), fd.kanji_facts(spark, sf))


WITH = "WITH " + fd.SQL_ENTRIES
ACCEPTED = WITH + ", accepted AS (SELECT * FROM lexicon WHERE reject_reason IS NULL)"
CHARS = f"regexp_extract_all(headword, '[{fixed.CJK}]')"
TREE_SQL = WITH + fd.SQL_KANJI_FACTS + f""",
kan AS (
  SELECT entry_id, doc_pos, level, reading, headword, min(ord) AS ord0, k FROM (
    SELECT entry_id, doc_pos, level, reading, headword, unnest({CHARS}) AS k, generate_subscripts({CHARS}, 1) AS ord
    FROM lexicon WHERE reject_reason IS NULL AND major = '{fixed.NOUN}') GROUP BY ALL),
tree AS (
  SELECT entry_id, doc_pos, level, headword AS word, kan.reading, k AS kanji,
    row_number() OVER (PARTITION BY entry_id ORDER BY ord0) - 1 AS ord, status, on_readings, kun_readings
  FROM kan LEFT JOIN facts ON facts.kanji = kan.k)"""


def q_frequency_keys(spark, sf):
    """Best record per key over per-language token counts."""
    counts = fd.tokens(spark, sf).groupBy("lang", "w").agg(F.count("*").alias("n"))
    records = counts.select(
        (F.lit(100000) - F.col("n")).cast("int").alias("rank"), F.col("w").alias("lemma"), fd.kata("w").alias("form"),
        F.col("lang").alias("freq_pos"), F.col("n").cast("string").alias("freq_count"), F.lit("").alias("freq_pmw"),
        F.col("lang").alias("line_ord"),
    )
    return frequency_keys(records).select("key", "rank", F.col("freq_pos").alias("lang"), "lemma")


SQL_FREQUENCY_KEYS = f"""
WITH tok AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{fd.WORD}')) AS w FROM documents),
c AS (SELECT lang, w, count(*) AS n, translate(w, '{fd.LETTERS}', '{fd.KATA}') AS kata,
      translate(w, '{fd.LETTERS}', '{fd.HIRA}') AS hira FROM tok GROUP BY lang, w),
k AS (SELECT w AS key, * FROM c UNION ALL SELECT kata, * FROM c WHERE kata <> w
      UNION ALL SELECT hira, * FROM c WHERE hira <> kata AND hira <> w)
SELECT key, CAST(100000 - max(n) AS INTEGER) AS rank, arg_min(lang, (100000 - n, lang)) AS lang,
       arg_min(w, (100000 - n, lang)) AS lemma FROM k GROUP BY key"""


def q_frequency_levels(spark, sf):
    ranked = fd.ranked_vocabulary(spark, sf).where(F.col("rank") <= fixed.FREQ_MAX_RANK)
    return ranked.groupBy(cl.frequency_level("rank").alias("level")).agg(F.count("*").alias("words"), F.min("rank").alias("best_rank"))


SQL_FREQUENCY_LEVELS = "WITH " + fd.SQL_RANKED + """
SELECT CASE WHEN rank <= 5000 THEN 'A' WHEN rank <= 30000 THEN 'B' ELSE 'C' END AS level, count(*) AS words, min(rank) AS best_rank
FROM ranked WHERE rank <= 50000 GROUP BY 1"""


def q_classified_entries(spark, sf):
    c = classified(spark, sf)
    return c.select(
        "entry_id", "headword", "reading", F.array_join("writings", SEP).alias("writings"), F.array_join("readings", SEP).alias("readings"),
        F.array_join("tags", SEP).alias("tags"), F.array_join("pos", SEP).alias("pos"), F.array_join("glosses", SEP).alias("glosses"),
        "level", "major", "transitivity", "conjugation", F.when(F.col("major").isNotNull(), F.col("cluster")).alias("cluster"),
        F.array_join("kanji", "").alias("kanji"), "freq_rank", "freq_count", "freq_pos", "reject_reason",
    )


SQL_CLASSIFIED = WITH + f"""
SELECT entry_id, headword, reading, array_to_string(writings, '{SEP}') AS writings, array_to_string(readings, '{SEP}') AS readings,
  array_to_string(tags, '{SEP}') AS tags, array_to_string(pos, '{SEP}') AS pos, array_to_string(glosses, '{SEP}') AS glosses,
  level, major, transitivity, conjugation, cluster,
  coalesce((SELECT string_agg(c, '' ORDER BY o) FROM (SELECT c, min(o) AS o FROM
     (SELECT unnest({CHARS}) AS c, generate_subscripts({CHARS}, 1) AS o) GROUP BY c)), '') AS kanji,
  freq_rank, freq_count, freq_pos, reject_reason FROM lexicon"""


def q_build_counters(spark, sf):
    return lx.build_counters(stored_classified(spark, sf))


SQL_COUNTERS = WITH + """
SELECT item, count(*) AS amount FROM (
  SELECT 'jmdict_entries_seen' AS item FROM lexicon
  UNION ALL SELECT 'rejected_' || reject_reason FROM lexicon WHERE reject_reason IS NOT NULL
  UNION ALL SELECT unnest(['accepted_total', 'accepted_' || major, 'accepted_level_' || level]) FROM lexicon WHERE reject_reason IS NULL
  UNION ALL SELECT 'accepted_with_bccwj_match' FROM lexicon WHERE reject_reason IS NULL AND freq_rank IS NOT NULL
  UNION ALL SELECT 'accepted_by_bccwj_rank_only' FROM lexicon WHERE reject_reason IS NULL AND evidence_level IS NULL AND freq_level IS NOT NULL)
GROUP BY item"""


def q_rejected_samples(spark, sf):
    s = lx.rejected_samples(stored_classified(spark, sf))
    return s.select("entry_id", F.get_json_object("note", "$.headword").alias("headword"), F.get_json_object("note", "$.reason").alias("reason"))


SQL_REJECTED = WITH + """
SELECT entry_id, headword, 'no_A_B_C_priority_or_bccwj_evidence' AS reason FROM lexicon
WHERE reject_reason = 'no_abc_evidence' ORDER BY doc_pos, entry_id LIMIT 100"""


PAIR_ENDINGS = ((0, "a", "まる", fixed.BOTH_TRANSITIVITIES), (0, "b", "める", fixed.TRANSITIVE), (1, "a", "る", fixed.BOTH_TRANSITIVITIES),
                (1, "b", "す", fixed.TRANSITIVE), (2, "a", "つ", fixed.TRANSITIVE), (2, "b", "てる", fixed.BOTH_TRANSITIVITIES))


def pair_verbs(spark, sf) -> DataFrame:
    """Two verbs of different transitivity from every word; readings rewrite into each other."""
    row = lambda m, side, end, t: F.when(F.col("n") % 3 == m, F.struct(
        F.concat("w", F.lit("-" + side)).alias("entry_id"), F.concat(fd.kanji_form("w"), F.lit(end)).alias("headword"),
        F.concat(fd.hira("w"), F.lit(end)).alias("reading"), F.lit(t).alias("transitivity")))
    both = F.filter(F.array(*[row(*x) for x in PAIR_ENDINGS]), lambda x: x.isNotNull())
    return fd.vocabulary(spark, sf).select(F.col("first_doc").alias("doc_pos"), F.lit(fixed.VERB).alias("major"), F.explode(both).alias("v")).select("doc_pos", "major", "v.*")


def q_verb_pairs(spark, sf):
    return lx.pair_candidates(pair_verbs(spark, sf)).select("entry_id", F.array_join("related", SEP).alias("related"))


_RULES = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(fixed.PAIR_REWRITES))
PAIR_STEPS = f"""
rules(rule, src, dst) AS (VALUES {_RULES}),
asked AS (SELECT v.entry_id, v.transitivity, r.rule, left(v.reading, length(v.reading) - length(r.src)) || r.dst AS target FROM verbs v JOIN rules r ON ends_with(v.reading, r.src)),
hits AS (
  SELECT a.entry_id, a.rule, o.doc_pos, o.entry_id AS oid, o.headword || '（' || o.reading || '）' AS label
  FROM asked a JOIN verbs o ON o.reading = a.target
  WHERE o.entry_id <> a.entry_id AND o.transitivity IS NOT NULL AND o.transitivity IS DISTINCT FROM a.transitivity),
firsts AS (SELECT entry_id, label, min((rule, doc_pos, oid)) AS p FROM hits GROUP BY entry_id, label),
numbered AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY p) AS rn FROM firsts)"""
_ENDINGS = ", ".join(f"({m}, '{s}', '{e}', '{t}')" for m, s, e, t in PAIR_ENDINGS)
SQL_PAIRS = "WITH " + fd.SQL_VOCAB + f""",
verbs AS (SELECT w || '-' || s AS entry_id, first_doc AS doc_pos, {fd.SQL_KANJI_FORM} || e AS headword, translate(w, '{fd.LETTERS}', '{fd.HIRA}') || e AS reading, t AS transitivity
  FROM vocab JOIN (VALUES {_ENDINGS}) x(m, s, e, t) ON n % 3 = m),{PAIR_STEPS}
SELECT entry_id, string_agg(label, '{SEP}' ORDER BY rn) AS related FROM numbered WHERE rn <= 5 GROUP BY entry_id"""


def q_kanji_tree(spark, sf):
    return tree(spark, sf).select(
        "entry_id", "kanji", F.col("ord").cast("bigint").alias("ord"), "word", "path", "relation",
        F.coalesce("status", F.lit("")).alias("status"), "level",
    )


SQL_TREE = TREE_SQL + f"""
SELECT entry_id, kanji, ord, word, kanji || ' > ' || coalesce(nullif(on_readings, ''), nullif(kun_readings, ''), '{fixed.READING_UNKNOWN}') || ' > ' || word AS path,
  CASE WHEN ord = 0 THEN '{fixed.MAIN_NODE}' ELSE '{fixed.CONTAINED_NODE}' END AS relation, coalesce(status, '') AS status, level FROM tree"""


def q_cluster_summary(spark, sf):
    return lx.cluster_summary(lexicon(spark, sf))


SQL_CLUSTERS = ACCEPTED + " SELECT major, cluster, count(*) AS entries FROM accepted GROUP BY major, cluster"


def q_cluster_order(spark, sf):
    """Clusters as they are published, with their place; there are as many rows as clusters."""
    lex = lexicon(spark, sf)
    clusters = export_tables(lex, tree(spark, sf))["clusters"]
    return clusters.withColumn("place", F.row_number().over(W.orderBy(*cluster_order())) - 1)


SQL_CLUSTER_ORDER = ACCEPTED + """, c AS (SELECT major, cluster, count(*) AS count FROM accepted GROUP BY major, cluster)
SELECT CAST(row_number() OVER (ORDER BY major, count DESC, cluster) - 1 AS INTEGER) AS place, major, cluster, count FROM c"""


def q_export_totals(spark, sf):
    lex = lexicon(spark, sf)
    return sinks.export_totals(export_tables(lex, tree(spark, sf)))


SQL_TOTALS = ACCEPTED + f""" SELECT count(*) AS entries, (SELECT count(DISTINCT k) FROM (SELECT unnest({CHARS}) AS k FROM accepted)) AS kanji FROM accepted"""


def q_kanji_metadata(spark, sf):
    m = kj.kanji_metadata(tree(spark, sf))
    words = F.array_join(F.transform("sample_words", lambda w: F.concat(w["word"], F.lit("/"), w["reading"])), SEP)
    return m.select("kanji", "status", "on_readings", "kun_readings", "noun_count", words.alias("sample_words"))


SQL_METADATA = TREE_SQL + f""",
words AS (SELECT kanji, word, min((level, reading, word, doc_pos, entry_id, ord)) AS p,
   arg_min(reading, (level, reading, word, doc_pos, entry_id, ord)) AS reading FROM tree GROUP BY kanji, word),
numbered AS (SELECT *, row_number() OVER (PARTITION BY kanji ORDER BY p) AS rn FROM words),
samples AS (SELECT kanji, string_agg(word || '/' || reading, '{SEP}' ORDER BY rn) AS sample_words FROM numbered WHERE rn <= 6 GROUP BY kanji)
SELECT kanji, coalesce(max(status), '') AS status, coalesce(max(on_readings), '') AS on_readings, coalesce(max(kun_readings), '') AS kun_readings,
  count(*) FILTER (WHERE ord = 0) AS noun_count, any_value(sample_words) AS sample_words
FROM tree JOIN samples USING (kanji) GROUP BY kanji"""


def q_kanji_index(spark, sf):
    lex = lexicon(spark, sf)
    meta = kj.kanji_metadata(lx.kanji_tree(lex, fd.kanji_facts(spark, sf)))
    index = kj.kanji_index(lex, meta)
    return kj.search_kanji(index, "").select("kanji", "count", F.coalesce("noun_count", F.lit(0)).alias("noun_count"))


SQL_KANJI_INDEX = ACCEPTED + f""",
k AS (SELECT DISTINCT entry_id, major, unnest({CHARS}) AS kanji FROM accepted),
f AS (SELECT entry_id, {CHARS}[1] AS kanji FROM accepted WHERE major = '{fixed.NOUN}')
SELECT kanji, count(*) AS count, (SELECT count(*) FROM f WHERE f.kanji = k.kanji) AS noun_count FROM k GROUP BY kanji
ORDER BY count DESC, kanji"""


def q_facet_counts(spark, sf):
    return fc.facet_counts(lexicon(spark, sf), ["major", "level", "transitivity"])


SQL_FACETS = ACCEPTED + """
SELECT 'major' AS facet, major AS value, count(*) AS n FROM accepted GROUP BY major
UNION ALL SELECT 'level', level, count(*) FROM accepted GROUP BY level
UNION ALL SELECT 'transitivity', transitivity, count(*) FROM accepted WHERE transitivity IS NOT NULL GROUP BY transitivity"""


def q_part_facets(spark, sf):
    return fc.facet_counts(fd.table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


SQL_PART_FACETS = """
SELECT CASE WHEN grouping(p_brand) = 0 THEN 'p_brand' WHEN grouping(p_type) = 0 THEN 'p_type' ELSE 'p_size' END AS facet,
  coalesce(p_brand, p_type, CAST(p_size AS VARCHAR)) AS value, count(*) AS n
FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size))"""


def q_category_tree(spark, sf):
    return fc.category_tree(lexicon(spark, sf))


SQL_CATEGORY = ACCEPTED + """
SELECT major, CAST(sum(count(*)) OVER (PARTITION BY major) AS BIGINT) AS major_n, cluster, count(*) AS n FROM accepted GROUP BY major, cluster"""


def q_export_entries(spark, sf):
    e = fc.export_entries(lexicon(spark, sf))
    return e.select(
        "id", "level", "word", "reading", "major", "subpos", "transitivity", "cluster", F.array_join("kanji", "").alias("kanji"),
        F.array_join("gloss", SEP).alias("gloss"), "rank", "frequency", "pmw", "bccwjPos",
    )


SQL_EXPORT = ACCEPTED + f"""
SELECT entry_id AS id, level, headword AS word, reading, major, array_to_string(pos, '{SEP}') AS subpos, coalesce(transitivity, '') AS transitivity, cluster,
  coalesce((SELECT string_agg(c, '' ORDER BY o) FROM (SELECT c, min(o) AS o FROM
     (SELECT unnest({CHARS}) AS c, generate_subscripts({CHARS}, 1) AS o) GROUP BY c)), '') AS kanji,
  array_to_string(glosses, '{SEP}') AS gloss, CAST(freq_rank AS BIGINT) AS rank, CAST(freq_count AS BIGINT) AS frequency,
  CAST(freq_count AS DOUBLE) AS pmw, coalesce(freq_pos, '') AS "bccwjPos" FROM accepted"""


TOKEN_REWRITES = [("er", "ed"), ("ed", "er"), ("ing", "ed"), ("ed", "ing"), ("tion", "t"), ("s", ""), ("e", "es"), ("ent", "er")]


def q_token_pairs(spark, sf):
    """The pair rule with other rewrites: vocabulary words by derived form."""
    v = fd.vocabulary(spark, sf)
    words = v.select(
        F.col("w").alias("entry_id"), F.col("first_doc").alias("doc_pos"), F.upper(F.left("w", F.lit(3))).alias("headword"), F.col("w").alias("reading"),
        F.concat(F.lit("t"), (F.col("n") % 3).cast("string")).alias("transitivity"), F.lit("word").alias("major"))
    return lx.pair_candidates(words, TOKEN_REWRITES, "word").select("entry_id", F.array_join("related", SEP).alias("related"))


_TOKEN_RULES = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TOKEN_REWRITES))
SQL_TOKEN_PAIRS = "WITH " + fd.SQL_VOCAB + f""",
rules(rule, src, dst) AS (VALUES {_TOKEN_RULES}),
hits AS (
  SELECT v.w AS entry_id, r.rule, o.first_doc AS doc_pos, o.w AS oid, upper(left(o.w, 3)) || '（' || o.w || '）' AS label
  FROM vocab v JOIN rules r ON ends_with(v.w, r.src)
  JOIN vocab o ON o.w = left(v.w, length(v.w) - length(r.src)) || r.dst WHERE o.n % 3 <> v.n % 3),
firsts AS (SELECT entry_id, label, min((rule, doc_pos, oid)) AS p FROM hits GROUP BY entry_id, label),
numbered AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY p) AS rn FROM firsts)
SELECT entry_id, string_agg(label, '{SEP}' ORDER BY rn) AS related FROM numbered WHERE rn <= 5 GROUP BY entry_id"""


LATIN_RULES = [("tion", "-tion"), ("ment", "-ment"), ("eux", "-eux"), ("ing", "-ing"), ("ble", "-ble"), ("ung", "-ung"), ("ed", "-ed"), ("er", "-er"), ("e", "-e")]


def q_suffix_clusters(spark, sf):
    rules = [cl.SuffixRule("word", tail, label, "basis") for tail, label in LATIN_RULES]
    v = fd.vocabulary(spark, sf)
    label = F.coalesce(cl.first_suffix_rule(F.lit("word"), "w", "w", rules), F.lit("other"))
    return v.groupBy(label.alias("cluster")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


_LATIN = " ".join(f"WHEN ends_with(w, '{t}') THEN '{label}'" for t, label in LATIN_RULES)
SQL_SUFFIX = "WITH " + fd.SQL_VOCAB + f"""
SELECT CASE {_LATIN} ELSE 'other' END AS cluster, count(*) AS words, CAST(sum(n) AS BIGINT) AS tokens FROM vocab GROUP BY 1"""


def q_quality_checks(spark, sf):
    overrides = fd.tokens(spark, sf, "benchmark", ("item_id",)).select(F.col("w").alias("entry_id")).distinct()
    return lx.quality_checks(lexicon(spark, sf), overrides)


SQL_QUALITY = ACCEPTED + f""",
o AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{fd.WORD}')) AS entry_id FROM benchmark)
SELECT 'unclassified_rows' AS "check", count(*) FILTER (WHERE major IS NULL) AS bad FROM accepted
UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT entry_id FROM accepted GROUP BY entry_id HAVING count(*) > 1)
UNION ALL SELECT 'orphan_overrides', count(*) FROM o WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.entry_id = o.entry_id)"""


def q_kanji_metadata_search(spark, sf):
    """Kanji whose readings contain a romanised reading."""
    lex = lexicon(spark, sf)
    index = kj.kanji_counts(lex).join(fd.kanji_facts(spark, sf), "kanji", "left")
    return kj.search_kanji(index, "ka", limit=None).select("kanji", "count")


SQL_KANJI_SEARCH = WITH + fd.SQL_KANJI_FACTS + f""",
k AS (SELECT DISTINCT entry_id, unnest({CHARS}) AS kanji FROM lexicon WHERE reject_reason IS NULL)
SELECT kanji, count(*) AS count FROM k JOIN facts USING (kanji)
WHERE on_readings = 'カ' OR kun_readings = 'か.か' GROUP BY kanji"""


def q_enriched_lexicon(spark, sf):
    """Related verbs, override translations and reference levels joined on."""
    lex = lexicon(spark, sf)
    words = fd.tokens(spark, sf, "benchmark", ("item_id",))
    over = words.groupBy(F.col("w").alias("entry_id")).agg(F.min("item_id").alias("i")).select(
        "entry_id", F.concat(F.lit("译"), F.col("i").cast("string")).alias("translation"), F.lit("s").alias("translation_source"))
    levels = words.groupBy(F.col("w").alias("entry_id")).agg(F.max("item_id").alias("i")).where(F.col("i") % 2 == 0).select(
        "entry_id", F.concat(F.lit("N"), (F.col("i") % 5 + 1).cast("string")).alias("ref_level"), F.lit("t").alias("ref_source"),
        F.lit("high").alias("ref_confidence"), F.lit("").alias("ref_note"))
    out = lx.enrich(lex, lx.pair_candidates(lex), over, levels)
    return out.select("entry_id", "translation", "ref_level", F.size(F.coalesce("related", F.array().cast("array<string>"))).alias("related_n"))


SQL_ENRICHED = ACCEPTED + f""",
verbs AS (SELECT entry_id, doc_pos, headword, reading, transitivity FROM accepted WHERE major = '{fixed.VERB}'),{PAIR_STEPS},
rel AS (SELECT entry_id, CAST(count(*) AS INTEGER) AS related_n FROM numbered WHERE rn <= 5 GROUP BY entry_id),
b AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{fd.WORD}')) AS w FROM benchmark),
g AS (SELECT w, min(item_id) AS lo, max(item_id) AS hi FROM b GROUP BY w)
SELECT a.entry_id, '译' || CAST(lo AS VARCHAR) AS translation, CASE WHEN hi % 2 = 0 THEN 'N' || CAST(hi % 5 + 1 AS VARCHAR) END AS ref_level,
  coalesce(related_n, 0) AS related_n
FROM accepted a LEFT JOIN g ON g.w = a.entry_id LEFT JOIN rel ON rel.entry_id = a.entry_id"""


QUERIES = {
    "frequency_keys": (q_frequency_keys, SQL_FREQUENCY_KEYS),
    "frequency_levels": (q_frequency_levels, SQL_FREQUENCY_LEVELS),
    "classified_entries": (q_classified_entries, SQL_CLASSIFIED),
    "build_counters": (q_build_counters, SQL_COUNTERS),
    "rejected_samples": (q_rejected_samples, SQL_REJECTED),
    "verb_pairs": (q_verb_pairs, SQL_PAIRS),
    "token_pairs": (q_token_pairs, SQL_TOKEN_PAIRS),
    "kanji_tree": (q_kanji_tree, SQL_TREE),
    "cluster_summary": (q_cluster_summary, SQL_CLUSTERS),
    "kanji_metadata": (q_kanji_metadata, SQL_METADATA),
    "cluster_order": (q_cluster_order, SQL_CLUSTER_ORDER),
    "export_totals": (q_export_totals, SQL_TOTALS),
    "kanji_index": (q_kanji_index, SQL_KANJI_INDEX),
    "kanji_search": (q_kanji_metadata_search, SQL_KANJI_SEARCH),
    "facet_counts": (q_facet_counts, SQL_FACETS),
    "part_facets": (q_part_facets, SQL_PART_FACETS),
    "category_tree": (q_category_tree, SQL_CATEGORY),
    "export_entries": (q_export_entries, SQL_EXPORT),
    "suffix_clusters": (q_suffix_clusters, SQL_SUFFIX),
    "quality_checks": (q_quality_checks, SQL_QUALITY),
    "enriched_lexicon": (q_enriched_lexicon, SQL_ENRICHED),
}
