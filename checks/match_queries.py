"""Level matching and example sentences over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import feeds as fd
from checks import lexicon_queries as lq
from lexmill import fixed
from lexmill.functions import classify as cl
from lexmill.operators import examples as ex
from lexmill.operators import levels as lv
from lexmill.plans.match import match_levels

SEP = fixed.LIST_SEPARATOR


# -- level matching ------------------------------------------------------------
# Level lists: benchmark words; the level comes from the item, the listed reading
# is the word's kana, and every third item lists the word in kana only.

def level_lists(spark, sf) -> DataFrame:
    t = fd.tokens(spark, sf, "benchmark", ("item_id",)).distinct()
    level = F.concat(F.lit("N"), (F.col("item_id") % 5 + 1).cast("string"))
    written = F.when(F.col("item_id") % 3 == 0, fd.hira("w")).otherwise(fd.kanji_form("w"))
    return t.select(
        level.alias("level"), written.alias("q"), fd.kata("w").alias("a"), F.concat(F.lit("list-"), level).alias("source_file"),
        F.concat(F.lit("u-"), level).alias("source_url"), F.struct("w", "item_id").alias("line_ord"),
    )


def small_lexicon(spark, sf) -> DataFrame:
    """Entries of the vocabulary; words that differ in some vowels only share writings and readings."""
    v = fd.vocabulary(spark, sf)
    short = F.translate("w", "eiou", "aaaa")
    v = v.withColumn("short", short)
    return v.select(
        F.col("w").alias("entry_id"), fd.kanji_form("short").alias("headword"), fd.hira("short").alias("reading"),
        F.array(fd.kanji_form("short")).alias("writings"), F.when(F.col("n") % 4 == 0, F.array(fd.hira("short"), fd.kata("w"))).otherwise(F.array(fd.hira("short"))).alias("readings"),
        F.when(F.col("n") > 9, "A").otherwise("B").alias("level"), F.lit(fixed.NOUN).alias("major"), F.array("w").alias("glosses"),
    )


_T = lambda c, to: f"translate({c}, '{fd.LETTERS}', '{to}')"
_KF = lambda c: f"{_T(f'left({c}, 2)', fd.KANJI)} || {_T(f'substr({c}, 3)', fd.HIRA)}"
SQL_MATCH = "WITH " + fd.SQL_VOCAB + f""",
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{fd.WORD}')) AS w FROM benchmark),
lists AS (
  SELECT item_id % 5 + 1 AS lv, CASE WHEN item_id % 3 = 0 THEN {_T('w', fd.HIRA)} ELSE {_KF('w')} END AS q,
    {_T('w', fd.HIRA)} AS rk, w, item_id FROM b
  WHERE regexp_matches({_T('w', fd.KATA)}, '{fixed.KANA_ONLY}')),
cand AS (
  SELECT q AS writing_key, rk AS reading_key, any_value(CASE WHEN regexp_matches(q, '{fixed.KANA_ONLY}') THEN rk END) AS kana_key, 'N' || CAST(arg_min(lv, (-lv, w, item_id)) AS VARCHAR) AS level,
    count(DISTINCT lv) AS levels, string_agg(DISTINCT 'list-N' || CAST(lv AS VARCHAR), ';' ORDER BY 'list-N' || CAST(lv AS VARCHAR) DESC) AS source_file
  FROM lists GROUP BY q, rk),
short AS (SELECT *, translate(w, 'eiou', 'aaaa') AS sw FROM vocab),
ent AS (SELECT w AS entry_id, {_KF('sw')} AS wk, {_T('sw', fd.HIRA)} AS rk, {_T('w', fd.HIRA)} AS rk2, n FROM short),
ekeys AS (
  SELECT DISTINCT * FROM (
    SELECT 'pair' AS kind, wk AS k1, rk AS k2, entry_id FROM ent UNION ALL SELECT 'pair', wk, rk2, entry_id FROM ent WHERE n % 4 = 0
    UNION ALL SELECT 'writing', wk, '', entry_id FROM ent UNION ALL SELECT 'reading', rk, '', entry_id FROM ent
    UNION ALL SELECT 'reading', rk2, '', entry_id FROM ent WHERE n % 4 = 0)),
cnt AS (SELECT kind, k1, k2, count(*) AS hits FROM ekeys GROUP BY ALL),
decided AS (
  SELECT c.*, CASE WHEN p.hits IS NOT NULL THEN 1 WHEN r.hits IS NOT NULL THEN 2 WHEN s.hits IS NOT NULL THEN 3 END AS tier,
    coalesce(p.hits, r.hits, s.hits) AS hits
  FROM cand c LEFT JOIN cnt p ON p.kind = 'pair' AND p.k1 = writing_key AND p.k2 = reading_key
  LEFT JOIN cnt r ON r.kind = 'reading' AND r.k1 = kana_key
  LEFT JOIN cnt s ON s.kind = 'writing' AND s.k1 = writing_key),
named AS (
  SELECT *, CASE WHEN tier = 1 THEN 'exact_writing_reading' WHEN tier = 2 AND hits = 1 THEN 'reading_only_unique' WHEN tier = 2 THEN 'reading_only_multiple'
      WHEN tier = 3 AND hits = 1 THEN 'writing_only_unique' WHEN tier = 3 THEN 'writing_only_multiple' ELSE 'unmatched' END AS rule,
    CASE WHEN tier IS NULL THEN 'none' WHEN hits > 1 THEN 'ambiguous' WHEN tier = 1 THEN 'high' WHEN tier = 2 THEN 'medium' ELSE 'low' END AS confidence
  FROM decided),
matched AS (
  SELECT n.*, k.entry_id FROM named n JOIN ekeys k ON k.k1 = writing_key AND k.k2 = reading_key WHERE tier = 1 AND kind = 'pair'
  UNION ALL SELECT n.*, k.entry_id FROM named n JOIN ekeys k ON k.k1 = reading_key WHERE tier = 2 AND kind = 'reading'
  UNION ALL SELECT n.*, k.entry_id FROM named n JOIN ekeys k ON k.k1 = writing_key WHERE tier = 3 AND kind = 'writing')"""


def _decided(spark, sf):
    candidates = lv.dedupe_candidates(lv.with_keys(lv.expand_candidates(level_lists(spark, sf))))
    keys = lv.entry_keys(small_lexicon(spark, sf))
    return lv.decide_matches(candidates, keys), keys


def q_level_candidates(spark, sf):
    c = lv.dedupe_candidates(lv.with_keys(lv.expand_candidates(level_lists(spark, sf))))
    return c.select("writing_key", "reading_key", "level", "source_file")


def q_candidate_meanings(spark, sf):
    """Candidates with the first meaning of their level and writing, however it is spaced."""
    p = fd.table(spark, sf, "part").withColumn("level", F.concat(F.lit("N"), (F.col("p_size") % 5 + 1).cast("string")))
    lists = p.select("level", F.col("p_name").alias("q"), fd.hira(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("a"), F.lit("f").alias("source_file"), F.lit("u").alias("source_url"), F.col("p_partkey").alias("line_ord"))
    spaced = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("　")))
    meanings = p.where("p_partkey % 3 > 0").select("level", spaced.alias("q"), F.col("p_type").alias("a"), F.col("p_partkey").alias("line_ord"))
    return lv.expand_candidates(lists, meanings).select("level", "writing", "reading", "meaning", F.col("ord.line_ord").alias("line"))


SQL_MEANINGS = f"""
WITH p AS (SELECT *, 'N' || CAST(p_size % 5 + 1 AS VARCHAR) AS level FROM part),
m AS (SELECT level, replace(p_name, ' ', '') AS k, arg_min(p_type, p_partkey) AS meaning FROM p WHERE p_partkey % 3 > 0 GROUP BY ALL)
SELECT p.level, p_name AS writing, translate(split_part(p_name, ' ', 1), '{fd.LETTERS}', '{fd.HIRA}') AS reading, coalesce(meaning, '') AS meaning, p_partkey AS line
FROM p LEFT JOIN m ON m.level = p.level AND m.k = replace(p_name, ' ', '')"""


def q_level_matches(spark, sf):
    d, _ = _decided(spark, sf)
    return d.select("writing_key", "reading_key", "level", "rule", "confidence", "hits")


def q_matched_entries(spark, sf):
    d, keys = _decided(spark, sf)
    return lv.matched_entries(d, keys).select("writing_key", "reading_key", "confidence", "entry_id")


def q_level_counts(spark, sf):
    return lv.level_counts(_decided(spark, sf)[0])


def q_outcome_counts(spark, sf):
    return lv.outcome_counts(_decided(spark, sf)[0])


def q_best_levels(spark, sf):
    return match_levels(small_lexicon(spark, sf), level_lists(spark, sf))["preview"].select("entry_id", "headword", "ref_level", "ref_confidence")


# -- examples ------------------------------------------------------------------------
# Sentences: the pieces of conversation turns; each is linked to the next piece and
# to the one after it as its translations. Terms: the words of the documents, one
# entry for the document in which each stands first.

def pieces(spark, sf) -> DataFrame:
    p = fd.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("pos", "text"))
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("conv_id", "turn", "pos")])
    return p.select("conv_id", "turn", "pos", key.alias("sentence_id"), F.trim("text").alias("text"))


def linked(spark, sf) -> DataFrame:
    p = pieces(spark, sf)
    key = lambda by: F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), (F.col("pos") + by).cast("string"))
    links = p.select(F.col("sentence_id").alias("src"), F.posexplode(F.array(key(1), key(2))).alias("line_ord", "dst"))
    any_text = lambda c: cl.eligible_sentence(c, script="[a-z]")
    any_translation = lambda c: cl.eligible_translation(c, script="[a-z]")
    s = p.select("sentence_id", "text")
    return ex.linked_sentences(s, s, links, any_text, any_translation)


SQL_LINKED = f"""
WITH p0 AS (SELECT conv_id, turn, string_split(text, '. ') AS parts FROM conversations),
p AS (SELECT conv_id, turn, unnest(parts) AS t, generate_subscripts(parts, 1) - 1 AS pos FROM p0),
s AS (SELECT *, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS sentence_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS txt FROM p),
good AS (SELECT * FROM s WHERE length(txt) BETWEEN 6 AND 62 AND regexp_matches(txt, '[a-z]')),
tr AS (SELECT * FROM s WHERE length(txt) BETWEEN 4 AND 90 AND regexp_matches(txt, '[a-z]')),
j AS (SELECT g.sentence_id, g.txt AS sentence, tr.sentence_id AS translation_id, tr.txt AS translation,
  row_number() OVER (PARTITION BY g.sentence_id ORDER BY length(tr.txt), tr.pos) AS rn
  FROM good g JOIN tr ON tr.conv_id = g.conv_id AND tr.turn = g.turn AND tr.pos IN (g.pos + 1, g.pos + 2)),
linked AS (SELECT sentence_id, sentence, translation_id, translation FROM j WHERE rn = 1)"""


def q_linked_sentences(spark, sf):
    return linked(spark, sf)


def word_terms(spark, sf) -> DataFrame:
    v = fd.ranked_vocabulary(spark, sf)
    return v.select(F.col("w").alias("term"), F.concat(F.lit("e"), F.col("first_doc").cast("string")).alias("entry_id"),
                    F.col("rank").alias("freq_rank")).distinct()


SQL_TERMS = """,
terms AS (SELECT w AS term, 'e' || CAST(first_doc AS VARCHAR) AS entry_id, rank AS freq_rank FROM ranked)"""


def examples(spark, sf) -> DataFrame:
    return ex.match_examples(linked(spark, sf), word_terms(spark, sf))


def q_examples(spark, sf):
    return examples(spark, sf).select("entry_id", F.col("rank_in_entry").cast("bigint").alias("rank_in_entry"), "sentence_id", "term", "translation")


SQL_EXAMPLE_CTE = SQL_LINKED + "," + fd.SQL_RANKED + SQL_TERMS + """,
hits AS (SELECT t.entry_id, l.sentence_id, l.translation,
    min({'a': abs(length(sentence) - 24), 'b': abs(length(translation) - 24), 'c': freq_rank, 't': term}) AS s
  FROM linked l JOIN terms t ON contains(l.sentence, t.term) GROUP BY ALL),
chosen AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY s.a, s.b, s.c, sentence_id) AS rank_in_entry FROM hits)"""
SQL_EXAMPLES = SQL_EXAMPLE_CTE + " SELECT entry_id, rank_in_entry, sentence_id, s.t AS term, translation FROM chosen WHERE rank_in_entry <= 2"


def q_example_totals(spark, sf):
    return ex.example_totals(examples(spark, sf))


SQL_TOTALS = SQL_EXAMPLE_CTE + " SELECT count(DISTINCT entry_id) AS covered_entries, count(*) AS examples FROM chosen WHERE rank_in_entry <= 2"


def q_entries_with_examples(spark, sf):
    entries = word_terms(spark, sf).select("entry_id").distinct()
    return ex.attach_examples(entries, examples(spark, sf)).select("entry_id", F.size(F.coalesce("examples", F.array())).cast("bigint").alias("n"))


SQL_WITH_EXAMPLES = SQL_EXAMPLE_CTE + """
SELECT e.entry_id, count(c.sentence_id) AS n FROM (SELECT DISTINCT entry_id FROM terms) e
LEFT JOIN chosen c ON c.entry_id = e.entry_id AND rank_in_entry <= 2 GROUP BY 1"""


def q_terms_in_documents(spark, sf):
    """Documents per benchmark word: substring join over whole documents."""
    from lexmill.operators.common import find_terms

    terms = fd.tokens(spark, sf, "benchmark", ("item_id",)).select(F.col("w").alias("term")).distinct()
    docs = fd.documents(spark, sf).select("doc_id", F.lower("text").alias("text"))
    return find_terms(docs, ["doc_id"], "text", terms).groupBy("term").agg(F.count("*").alias("docs"))


SQL_TERMS_IN_DOCS = f"""
WITH t AS (SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '{fd.WORD}')) AS w FROM benchmark)),
d AS (SELECT doc_id, lower(text) AS txt FROM documents)
SELECT term, count(*) AS docs FROM t JOIN d ON contains(txt, term) GROUP BY term"""


def q_surface_forms(spark, sf):
    lex = lq.lexicon(spark, sf)
    return ex.entry_terms(lex, ["A", "B"]).select("entry_id", "term")


def _forms_sql():
    f = fixed
    cases = []
    stem, last = "left(headword, length(headword) - 1)", "right(headword, 1)"
    lst = lambda base, sfx: "[" + ", ".join(f"{base} || '{s}'" for s in sfx) + "]"
    m = lambda t: f"translate({last}, '{''.join(t)}', '{''.join(t.values())}')"
    cases.append(f"WHEN major = '{f.VERB}' AND length(headword) >= 3 AND ends_with(headword, 'る') AND lower(array_to_string(pos, '；')) LIKE '%ichidan%' THEN {lst(stem, f.ICHIDAN_SUFFIXES)}")
    cases.append(f"WHEN major = '{f.VERB}' AND length(headword) >= 3 AND {last} IN ({', '.join(repr(k) for k in f.GODAN_CONTINUATIVE)}) THEN "
                 f"list_concat({lst(f'({stem} || {m(f.GODAN_CONTINUATIVE)})', f.GODAN_CONTINUATIVE_SUFFIXES)}, {lst(f'({stem} || {m(f.GODAN_PAST_STEM)})', f.GODAN_PAST_SUFFIXES)})")
    cases.append(f"WHEN major = '{f.I_ADJ}' AND length(headword) >= 3 AND ends_with(headword, 'い') THEN {lst(stem, f.I_ADJ_SUFFIXES)}")
    return "CASE " + " ".join(cases) + " ELSE CAST([] AS VARCHAR[]) END"


SQL_SURFACE = lq.ACCEPTED + f""",
f AS (SELECT DISTINCT entry_id, unnest(list_concat(list_concat([headword], writings), {_forms_sql()})) AS term FROM accepted WHERE level IN ('A', 'B'))
SELECT entry_id, term FROM f WHERE term NOT IN ({', '.join(f"'{t}'" for t in fixed.DENIED_TERMS)})
  AND regexp_matches(term, '[{fixed.KANA}{fixed.CJK}]') AND NOT regexp_matches(term, '[A-Za-z]')
  AND CASE WHEN regexp_matches(term, '{fixed.KANA_ONLY}') THEN length(replace(term, 'ー', '')) >= 3 ELSE length(term) >= 2 END"""


QUERIES = {
    "level_candidates": (q_level_candidates, SQL_MATCH + " SELECT writing_key, reading_key, level, source_file FROM cand"),
    "candidate_meanings": (q_candidate_meanings, SQL_MEANINGS),
    "level_matches": (q_level_matches, SQL_MATCH + " SELECT writing_key, reading_key, level, rule, confidence, coalesce(hits, 0) AS hits FROM named"),
    "matched_entries": (q_matched_entries, SQL_MATCH + " SELECT writing_key, reading_key, confidence, entry_id FROM matched"),
    "level_counts": (q_level_counts, SQL_MATCH + """ SELECT level, count(*) AS candidates, count(*) FILTER (WHERE confidence IN ('high', 'medium', 'low')) AS matched,
        count(*) FILTER (WHERE confidence IN ('high', 'medium')) AS matched_high_medium FROM named GROUP BY level"""),
    "outcome_counts": (q_outcome_counts, SQL_MATCH + """ SELECT 'confidence' AS measure, confidence AS value, count(*) AS n FROM named GROUP BY confidence
        UNION ALL SELECT 'rule', rule, count(*) FROM named GROUP BY rule"""),
    "best_levels": (q_best_levels, SQL_MATCH + """ SELECT entry_id, any_value(wk) AS headword, arg_min(level, (-CAST(right(level, 1) AS INTEGER), confidence)) AS ref_level,
        arg_min(confidence, (-CAST(right(level, 1) AS INTEGER), confidence)) AS ref_confidence
        FROM matched JOIN ent USING (entry_id) WHERE confidence IN ('high', 'medium') GROUP BY entry_id"""),
    "linked_sentences": (q_linked_sentences, SQL_LINKED + " SELECT * FROM linked"),
    "examples": (q_examples, SQL_EXAMPLES),
    "example_totals": (q_example_totals, SQL_TOTALS),
    "entries_with_examples": (q_entries_with_examples, SQL_WITH_EXAMPLES),
    "terms_in_documents": (q_terms_in_documents, SQL_TERMS_IN_DOCS),
    "surface_forms": (q_surface_forms, SQL_SURFACE),
}
