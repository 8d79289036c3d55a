"""Given tables written in a source's file form and read back through the readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from checks import feeds as fd
from checks import lexicon_queries as lq
from checks import match_queries as mq
from checks import search_queries as sq
from checks import translate_queries as tq
from lexmill import fixed
from lexmill.functions import text as tx
from lexmill.operators import examples as ex
from lexmill.operators import gloss as gl
from lexmill.operators import lexicon as lx
from lexmill.operators import search as se, search_index as si
from lexmill.operators.common import checkpoint_dir, places_within
from lexmill.plans.build import policy_rows
from lexmill.plans.match import match_levels
from lexmill.sources import readers, sinks

SEP = fixed.LIST_SEPARATOR
_M = lambda c, to: f"translate({c}, '{fd.LETTERS}', '{to}')"


def folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/lexmill/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


def lines(df: DataFrame, line: Column, path: str, compression: str = "none", mode: str = "overwrite") -> str:
    df.select(line.alias("value")).write.mode(mode).option("compression", compression).text(path)
    return path


# -- dictionary and character XML ---------------------------------------------------

def q_dictionary_xml(spark, sf):
    """Entries as gzip XML with document entities, read and classified columns compared."""
    v = fd.vocabulary(spark, sf)
    path = f"{folder(spark)}/dict"
    head = spark.range(1).select(F.lit('<!DOCTYPE d [\n<!ENTITY n "noun (common) (futsuumeishi)">\n<!ENTITY v1 "Ichidan verb">\n]>').alias("value"))
    entry = F.concat(
        F.lit("<entry>\n<ent_seq>"), "w", F.lit("</ent_seq>\n<k_ele><keb>"), fd.kanji_form("w"), F.lit("</keb>"),
        F.when(F.col("n") % 2 == 0, "<ke_pri>ichi1</ke_pri>").otherwise(""), F.lit("</k_ele>\n<r_ele><reb>"), fd.hira("w"), F.lit("</reb></r_ele>\n<sense><pos>&"),
        F.when(F.length("w") % 2 == 0, "n").otherwise("v1"), F.lit(";</pos><gloss>"), "w", F.lit(" &amp; co</gloss></sense>\n</entry>"))
    lines(head, F.col("value"), path, "gzip")
    lines(v, entry, path, "gzip", "append")
    out = readers.read_dictionary(spark, path)
    sense = F.get("senses", 0)
    return out.select("ent_seq", F.get("written", 0)["text"].alias("written"), F.array_join(F.get("written", 0)["tags"], SEP).alias("tags"),
                      F.get("spoken", 0)["text"].alias("spoken"), F.array_join(sense["pos"], SEP).alias("pos"), F.get(sense["gloss"], 0)["text"].alias("gloss"))


SQL_DICTIONARY = "WITH " + fd.SQL_VOCAB + f"""
SELECT w AS ent_seq, {fd.SQL_KANJI_FORM} AS written, CASE WHEN n % 2 = 0 THEN 'ichi1' ELSE '' END AS tags, {_M('w', fd.HIRA)} AS spoken,
  CASE WHEN length(w) % 2 = 0 THEN 'noun (common) (futsuumeishi)' ELSE 'Ichidan verb' END AS pos, w || ' & co' AS gloss FROM vocab"""


def q_kanji_xml(spark, sf):
    facts = fd.kanji_facts(spark, sf)
    reading = lambda kind, c: F.when(F.col(c) != "", F.concat(F.lit(f'<reading r_type="{kind}">'), c, F.lit("</reading>"))).otherwise("")
    item = F.concat(F.lit("<character><literal>"), "kanji", F.lit("</literal><misc>"), F.when(F.col("status") != "", "<grade>8</grade>").otherwise(""),
                    F.lit("</misc><reading_meaning><rmgroup>"), reading("ja_on", "on_readings"), reading("ja_kun", "kun_readings"),
                    F.lit('<reading r_type="pinyin">x</reading></rmgroup></reading_meaning></character>'))
    out = readers.read_kanji(spark, lines(facts, item, f"{folder(spark)}/kanji", "gzip"))
    return out.select("kanji", "status", "on_readings", "kun_readings")


SQL_KANJI = "WITH " + fd.SQL_VOCAB + fd.SQL_KANJI_FACTS + " SELECT kanji, status, on_readings, kun_readings FROM facts"


# -- lists ---------------------------------------------------------------------------

def q_frequency_file(spark, sf):
    """Tab-separated frequency list; ranks that are no number fall out."""
    v = fd.ranked_vocabulary(spark, sf)
    path = f"{folder(spark)}/freq"
    v.select(F.when(F.length("w") == 1, "x").otherwise(F.col("rank").cast("string")).alias("rank"), F.col("w").alias("lemma"), fd.kata("w").alias("lForm"), F.lit("名詞").alias("pos"),
             F.col("n").alias("frequency"), F.lit("1.5").alias("pmw")).write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return readers.read_frequency(spark, path).drop("line_ord")


SQL_FREQUENCY_FILE = "WITH " + fd.SQL_RANKED + f"""
SELECT rank, w AS lemma, {_M('w', fd.KATA)} AS form, '名詞' AS freq_pos, CAST(n AS VARCHAR) AS freq_count, '1.5' AS freq_pmw FROM ranked WHERE length(w) > 1"""


def q_bilingual_file(spark, sf):
    v = fd.vocabulary(spark, sf)
    line = F.when(F.col("n") % 5 == 0, F.concat(F.lit("# "), "w")).when(F.col("n") % 5 == 1, F.concat("w", F.lit(" without brackets"))).otherwise(
        F.concat(F.lit(" "), "w", F.lit(" "), fd.kanji_form("w"), F.lit(" [x y] /to "), "w", F.lit("/two, three/ ")))
    return readers.read_bilingual(spark, lines(v, line, f"{folder(spark)}/bilingual")).drop("line_ord")


SQL_BILINGUAL = "WITH " + fd.SQL_VOCAB + f" SELECT w AS traditional, {fd.SQL_KANJI_FORM} AS simplified, 'to ' || w || '/two, three' AS definitions FROM vocab WHERE n % 5 > 1"


def q_sentence_file(spark, sf):
    """Sentences with quotes and tabs as bzip2 lines, their links, and the join of both."""
    p = mq.pieces(spark, sf)
    top = folder(spark)
    quoted = F.concat(F.lit('"say ""'), F.regexp_replace("text", '[\\n\\r"\\t]', " "), F.lit('"""'))
    lines(p, F.concat_ws("\t", "sentence_id", F.lit("eng"), quoted), f"{top}/s", "bzip2")
    lines(p, F.concat_ws("\t", "sentence_id", F.concat("sentence_id", F.lit("x"))), f"{top}/l", "bzip2")
    s, links = readers.read_sentences(spark, f"{top}/s"), readers.read_links(spark, f"{top}/l")
    return s.join(links, F.col("sentence_id") == F.col("src")).select("sentence_id", "lang", "text", "dst")


SQL_SENTENCES = mq.SQL_LINKED + """
SELECT sentence_id, 'eng' AS lang, 'say "' || regexp_replace(trim(t, ' '), '[\\n\\r"\\t]', ' ', 'g') || '"' AS text, sentence_id || 'x' AS dst FROM s"""


def q_level_list_file(spark, sf):
    rows = mq.level_lists(spark, sf).select("level", "q", "a", "source_file", "source_url")
    path = f"{folder(spark)}/lists"
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_level_lists(spark, path).select("level", "q", "a", "source_file", "source_url").distinct()


SQL_LEVEL_LISTS = f"""
WITH b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{fd.WORD}')) AS w FROM benchmark)
SELECT DISTINCT 'N' || CAST(item_id % 5 + 1 AS VARCHAR) AS level, CASE WHEN item_id % 3 = 0 THEN {_M('w', fd.HIRA)} ELSE {fd.SQL_KANJI_FORM} END AS q, {_M('w', fd.KATA)} AS a,
  'list-N' || CAST(item_id % 5 + 1 AS VARCHAR) AS source_file, 'u-N' || CAST(item_id % 5 + 1 AS VARCHAR) AS source_url FROM b"""


def q_variant_file(spark, sf):
    """Groups of characters: the letters of each part name, as kanji; the last group of a character stays."""
    p = fd.table(spark, sf, "part")
    group = F.translate(F.regexp_replace("p_name", " ", "|"), fd.LETTERS, fd.KANJI)
    path = lines(p.orderBy("p_partkey").coalesce(1), group, f"{folder(spark)}/variants")
    return readers.read_variants(spark, path).select("kanji").distinct()


SQL_VARIANTS = f"""
WITH g AS (SELECT unnest(string_split({_M('p_name', fd.KANJI)}, ' ')) AS members FROM part),
c AS (SELECT list_distinct(string_split(members, '')) AS cs FROM g)
SELECT DISTINCT unnest(cs) AS kanji FROM c WHERE len(cs) >= 2"""


# -- exchange files ------------------------------------------------------------------

def q_master_file(spark, sf):
    """The six lexicon outputs are written; the master file is read back, with its order."""
    lex = lq.lexicon(spark, sf)
    out = folder(spark)
    enriched = lx.enrich(lex, lx.pair_candidates(lex), None, None)
    audit = lx.audit(lq.stored_classified(spark, sf), policy_rows(spark))
    sinks.write_lexicon(enriched, lq.tree(spark, sf), lx.cluster_summary(lex), audit, out)
    back = readers.read_master(spark, f"{out}/master_lexicon")
    return back.select("entry_id", "headword", "reading", "level", "major", "freq_rank", *[F.array_join(c, SEP).alias(c) for c in ("pos", "writings", "readings", "tags", "glosses")])


SQL_MASTER = lq.ACCEPTED + f"""
SELECT entry_id, headword, reading, level, major, freq_rank, array_to_string(pos, '{SEP}') AS pos, array_to_string(writings, '{SEP}') AS writings,
  array_to_string(readings, '{SEP}') AS readings, array_to_string(tags, '{SEP}') AS tags, array_to_string(glosses, '{SEP}') AS glosses FROM accepted"""


def q_audit_rows(spark, sf):
    out = folder(spark)
    sinks.write_csv(lx.audit(lq.stored_classified(spark, sf), policy_rows(spark)), f"{out}/audit", fixed.AUDIT_COLUMNS)
    back = readers._table(spark, f"{out}/audit").toDF("item", "amount", "note")
    return back.where(F.col("item").startswith("accepted") | F.col("item").startswith("rejected_") & (F.col("item") != "rejected_sample")).select("item", F.col("amount").cast("bigint").alias("amount"))


SQL_AUDIT = "SELECT item, amount FROM (" + lq.SQL_COUNTERS + ") WHERE starts_with(item, 'accepted') OR starts_with(item, 'rejected_')"


def q_master_order(spark, sf):
    """The published order as ranks inside each class and level."""
    ranked = places_within(lq.lexicon(spark, sf), ["major", "level"], sinks.master_order()[2:], "place")
    return ranked.select("entry_id", "major", "level", "place")


SQL_MASTER_ORDER = lq.ACCEPTED + """
SELECT entry_id, major, level, CAST(row_number() OVER (PARTITION BY major, level ORDER BY CASE WHEN coalesce(reading, '') = '' THEN headword ELSE reading END, headword, doc_pos, entry_id) AS INTEGER) AS place
FROM accepted"""


def q_override_file(spark, sf):
    out = folder(spark)
    over = tq.overrides(spark, sf).select("entry_id", "translation", "translation_source")
    sinks.write_overrides(over, out)
    return readers.read_overrides(spark, f"{out}/overrides")


SQL_OVERRIDES = tq.SQL_RESULTS + " SELECT entry_id, translation, translation_source FROM sourced"


def q_queue_file(spark, sf):
    out = folder(spark)
    sinks.write_repair_queue(gl.repair_queue(tq.entries(spark, sf), tq.overrides(spark, sf)), out)
    q = readers.read_repair_queue(spark, f"{out}/repair_queue")
    return q.select("id", "level", "word", F.array_join("glosses", ",").alias("glosses"), "draft_translation", "min_confidence")


def q_level_file(spark, sf):
    """Reference levels as CSV; the last row of an entry stays."""
    words = fd.tokens(spark, sf, "benchmark", ("item_id",)).distinct()
    rows = words.select(F.col("w").alias("entry_id"), F.concat(F.lit("N"), (F.col("item_id") % 5 + 1).cast("string")).alias("ref_level"), F.lit("s").alias("ref_source"), F.lit("high").alias("ref_confidence"),
                        F.concat(F.lit('a "note", '), F.col("item_id").cast("string")).alias("ref_note"), "item_id")
    path = f"{folder(spark)}/levels"
    sinks.write_csv(rows.orderBy("item_id").coalesce(1), path, fixed.LEVEL_COLUMNS)
    return readers.read_levels(spark, path)


SQL_LEVEL_FILE = f"""
WITH b AS (SELECT max(item_id) AS i, w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{fd.WORD}')) AS w FROM benchmark) GROUP BY w)
SELECT w AS entry_id, 'N' || CAST(i % 5 + 1 AS VARCHAR) AS ref_level, 's' AS ref_source, 'high' AS ref_confidence, 'a "note", ' || CAST(i AS VARCHAR) AS ref_note FROM b"""


def q_cache_file(spark, sf):
    """Translation records appended as JSON lines, a broken line among them."""
    e = fd.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("translation"), F.lit("m").alias("source"), "ts", "event_id")
    out = f"{folder(spark)}/cache"
    sinks.append_cache(e.groupBy("id").agg(F.min("translation").alias("translation")), out)
    broken = spark.range(1).select(F.lit("{not json").alias("value"))
    lines(broken, F.col("value"), out, mode="append")
    return readers.read_translation_cache(spark, out).select("entry_id", F.get("translation", 0).alias("first"))


SQL_CACHE_FILE = """SELECT CAST(user_id AS VARCHAR) AS entry_id, min(event_type) AS "first" FROM events GROUP BY user_id"""


def q_study_file(spark, sf):
    rows = fd.table(spark, sf, "labels").select((F.col("doc_id") % 7).cast("string").alias("user_id"), F.col("doc_id").cast("string").alias("entry_id"), F.when(F.col("quality") == 1, "starred").otherwise("learned").alias("status"))
    out = f"{folder(spark)}/study"
    sinks.write_study_data(rows, out)
    return readers.read_study_data(spark, out).select("entry_id", "status").distinct()


SQL_STUDY = "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS entry_id, CASE WHEN quality = 1 THEN 'starred' ELSE 'learned' END AS status FROM labels"


def q_example_file(spark, sf):
    out = folder(spark)
    found = mq.examples(spark, sf)
    sinks.write_examples(found, out)
    sinks.write_json(ex.example_totals(found), f"{out}/summary")
    total = spark.read.json(f"{out}/summary").select("examples")
    back = readers._table(spark, f"{out}/examples").select(F.col("`词条ID`").alias("entry_id"), F.col("`日文句子ID`").alias("sentence_id"), F.col("`匹配词形`").alias("term"))
    return back.withColumn("total", total.scalar())


SQL_EXAMPLE_FILE = mq.SQL_EXAMPLE_CTE + """
SELECT entry_id, sentence_id, s.t AS term, (SELECT count(*) FROM chosen WHERE rank_in_entry <= 2) AS total FROM chosen WHERE rank_in_entry <= 2"""


def q_match_files(spark, sf):
    """The three level reports hold every candidate once."""
    out = folder(spark)
    result = match_levels(mq.small_lexicon(spark, sf), mq.level_lists(spark, sf))
    sinks.write_matches(result, out)
    rows = lambda name: readers._table(spark, f"{out}/{name}")
    key = [F.col("`表记`").alias("writing"), F.col("`读音`").alias("reading")]
    parts = rows("matches").select(*key, F.lit("matched").alias("report")).unionByName(rows("ambiguous").select(*key, F.lit("ambiguous").alias("report"))).unionByName(rows("unmatched").select(*key, F.lit("unmatched").alias("report")))
    return parts.distinct().groupBy("report").agg(F.count("*").alias("candidates"))


SQL_MATCH_FILES = mq.SQL_MATCH + """
SELECT CASE WHEN confidence = 'none' THEN 'unmatched' WHEN confidence = 'ambiguous' THEN 'ambiguous' ELSE 'matched' END AS report, count(*) AS candidates FROM named GROUP BY 1"""


# -- predicates of a request -----------------------------------------------------------

def q_part_filter(spark, sf):
    found = se.matching(sq.docs(spark, sf), se.SearchRequest(part_group="verb"))
    return found.groupBy("major").agg(F.count("*").alias("entries"))


SQL_PART_FILTER = sq.SQL_DOCS + " SELECT major, count(*) AS entries FROM docs WHERE is_verb GROUP BY major"


def q_term_only_search(spark, sf):
    """Latin text is looked for in readings and writings only."""
    return si.indexed_matching(sq.index(spark, sf), se.SearchRequest(text="ka", term_only=True)).select("entry_id")


SQL_TERM_ONLY = sq.SQL_DOCS + """
SELECT entry_id FROM docs WHERE contains(ra || ' ' || rb || ' ' || rc || ' ' || lower(array_to_string(readings, ' ') || ' ' || headword || ' ' || array_to_string(writings, ' ')), 'ka')"""


def q_first_definitions(spark, sf):
    lex = lq.lexicon(spark, sf)
    return lex.select("entry_id", tx.first_definition(F.array().cast("array<string>"), "glosses").alias("definition"))


SQL_DEFINITIONS = lq.ACCEPTED + " SELECT entry_id, coalesce(glosses[1], '') AS definition FROM accepted"

QUERIES = {
    "dictionary_xml": (q_dictionary_xml, SQL_DICTIONARY), "kanji_xml": (q_kanji_xml, SQL_KANJI), "frequency_file": (q_frequency_file, SQL_FREQUENCY_FILE),
    "bilingual_file": (q_bilingual_file, SQL_BILINGUAL), "sentence_file": (q_sentence_file, SQL_SENTENCES), "level_list_file": (q_level_list_file, SQL_LEVEL_LISTS),
    "variant_file": (q_variant_file, SQL_VARIANTS), "master_file": (q_master_file, SQL_MASTER), "audit_rows": (q_audit_rows, SQL_AUDIT),
    "master_order": (q_master_order, SQL_MASTER_ORDER), "override_file": (q_override_file, SQL_OVERRIDES), "queue_file": (q_queue_file, tq.SQL_QUEUE),
    "level_file": (q_level_file, SQL_LEVEL_FILE), "cache_file": (q_cache_file, SQL_CACHE_FILE), "study_file": (q_study_file, SQL_STUDY),
    "example_file": (q_example_file, SQL_EXAMPLE_FILE), "match_files": (q_match_files, SQL_MATCH_FILES), "part_filter": (q_part_filter, SQL_PART_FILTER),
    "term_only_search": (q_term_only_search, SQL_TERM_ONLY), "first_definitions": (q_first_definitions, SQL_DEFINITIONS),
}
