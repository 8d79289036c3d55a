"""Gloss translation, requests, replies and overrides over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from checks import feeds as fd
from lexmill import fixed
from lexmill.operators import gloss as gl
from lexmill.operators import translate as tr
from lexmill.operators.batches import request_batches
from lexmill.operators.common import checkpoint_dir
from lexmill.operators.versions import Versions
from lexmill.plans.translation_run import translation_run

SEP = fixed.LIST_SEPARATOR
PLAIN = "^[a-z]{5,}$"
NOT_KEYS = ["thing", "without"]


def plain_word(w: Column) -> Column:
    """A word of plain letters for every word: itself, or letters made of its digest."""
    digest = F.concat(F.lit("q"), F.translate(F.md5(w), "0123456789", "ghijklmnop"))
    return F.when(w.rlike(PLAIN) & ~w.isin(NOT_KEYS), w).otherwise(digest)


SQL_PLAIN = f"CASE WHEN regexp_matches(w, '{PLAIN}') AND w NOT IN ('thing', 'without') THEN w ELSE 'q' || translate(md5(w), '0123456789', 'ghijklmnop') END"


def words(spark, sf) -> DataFrame:
    """Every word as a dictionary key, with the class its entry gets."""
    v = fd.vocabulary(spark, sf).withColumn("w", plain_word(F.col("w")))
    return v.withColumn("major", F.when(F.col("first_doc") % 3 == 0, fixed.I_ADJ).otherwise(fixed.NOUN)).withColumn(
        "k", F.translate("w", fd.LETTERS, fd.KANJI))


def gloss_form(w, d):
    forms = [w, F.concat(F.lit("to "), w), F.concat(F.lit("act of "), w), F.concat(F.lit("not act of "), w), F.concat(w, F.lit(" (thing)")),
             F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))), F.concat(F.lit("the "), w, F.lit(" zz")), F.concat(F.lit("without big "), w)]
    out = F.when(d % 8 == 0, forms[0])
    for i in range(1, 8):
        out = out.when(d % 8 == i, forms[i])
    return out


def entries(spark, sf) -> DataFrame:
    v = words(spark, sf)
    return v.select(
        F.col("w").alias("entry_id"), "major", F.array(gloss_form(F.col("w"), F.col("first_doc")), F.col("w"), F.concat(F.lit("to "), "w")).alias("glosses"),
        F.when(F.col("n") % 2 == 0, "A").otherwise("B").alias("level"), F.col("k").alias("headword"), F.col("w").alias("reading"), F.array(F.lit("n")).alias("pos"),
        F.when(F.col("n") % 11 == 0, "LLM draft").alias("translation_source"))


def dictionary_tables(spark, sf) -> DataFrame:
    v = words(spark, sf)
    row = lambda kind, major, key, value: F.struct(F.lit(kind).alias("kind"), F.lit(major).alias("major"), key.alias("key"), value.alias("value"))
    w, k, n = F.col("w"), F.col("k"), F.col("n")
    rows = F.array(
        F.when(n % 3 == 0, row("exact", "", w, k)), F.when(n % 4 == 0, row("context", fixed.I_ADJ, w, F.concat(k, F.lit("好")))),
        F.when(n % 3 == 1, row("word", "", w, k)), F.when(n % 5 == 0, row("phrase", "", F.concat(F.lit("the "), w), F.concat(k, F.lit("之")))))
    return v.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def bilingual(spark, sf) -> DataFrame:
    v = words(spark, sf).where(F.col("n") % 7 == 0)
    return v.select(F.col("k").alias("traditional"), F.col("k").alias("simplified"), F.concat(F.lit("to "), "w", F.lit("/"), "w", F.lit(", the x/surname Y")).alias("definitions"),
                    F.col("w").alias("line_ord"))


def translated(spark, sf) -> DataFrame:
    """Solved once per session; entries, queue and outcomes read the stored table."""
    return fd.stored(spark, sf, "translated", solve)


def solve(spark, sf) -> DataFrame:
    asked = entries(spark, sf).select(F.explode("glosses").alias("gloss"), "major")
    return gl.translate_glosses(asked, dictionary_tables(spark, sf), gl.reverse_index(bilingual(spark, sf)))


def _adj(text):
    return f"CASE WHEN adj AND length({text}) <= 8 THEN {text} || '的' ELSE {text} END"


U = fixed.UNTRANSLATED
# One row per word with what each dictionary says, then the result of every form.
SQL_RESULTS = "WITH " + fd.SQL_VOCAB + f""",
plain AS (SELECT {SQL_PLAIN} AS w, n, first_doc FROM vocab),
w AS (SELECT w, n, first_doc AS d, first_doc % 3 = 0 AS adj, translate(w, '{fd.LETTERS}', '{fd.KANJI}') AS k,
  n % 3 = 0 AS ex, n % 4 = 0 AND first_doc % 3 = 0 AS cx, n % 7 = 0 AND length(w) <= 8 AS rv, n % 3 = 1 AS wd, n % 5 = 0 AS ph
  FROM plain),
i AS (SELECT *, ex OR rv OR wd AS known, CASE WHEN ex THEN 0.98 WHEN rv THEN 0.68 WHEN wd THEN 0.72 ELSE 0.10 END AS ic FROM w),
forms AS (
  SELECT *, [
    {{'g': w, 't': CASE WHEN cx THEN {_adj("k || '好'")} WHEN known THEN {_adj('k')} ELSE '{U}' END,
      'c': CASE WHEN cx THEN 0.98 ELSE ic END, 'm': CASE WHEN cx THEN 'context-exact' WHEN ex THEN 'exact' WHEN rv THEN 'cc-cedict' WHEN wd THEN 'phrase-word' ELSE 'untranslated' END}},
    {{'g': 'to ' || w, 't': CASE WHEN known THEN {_adj('k')} ELSE '{U}' END,
      'c': CASE WHEN ex THEN 0.90 WHEN rv THEN 0.68 WHEN wd THEN 0.72 ELSE 0.10 END,
      'm': CASE WHEN ex THEN 'exact-verb-core' WHEN rv THEN 'cc-cedict' WHEN wd THEN 'template-to' ELSE 'untranslated' END}},
    {{'g': 'act of ' || w, 't': CASE WHEN known THEN {_adj("k || '的行为'")} ELSE '{U}' END, 'c': CASE WHEN known THEN least(0.72, ic) ELSE 0.10 END,
      'm': CASE WHEN known THEN 'template-act' ELSE 'untranslated' END}},
    {{'g': 'not act of ' || w, 't': CASE WHEN known THEN {_adj("'不' || k || '的行为'")} ELSE '{U}' END, 'c': CASE WHEN known THEN 0.62 ELSE 0.10 END,
      'm': CASE WHEN known THEN 'template-not' ELSE 'untranslated' END}},
    {{'g': w || ' (thing)', 't': CASE WHEN cx THEN {_adj("k || '好'")} WHEN ex OR rv THEN {_adj('k')} ELSE '{U}' END,
      'c': CASE WHEN cx OR ex THEN 0.94 WHEN rv THEN 0.68 WHEN wd THEN 0.30 ELSE 0.10 END,
      'm': CASE WHEN cx THEN 'context-exact-no-parenthetical' WHEN ex THEN 'exact-no-parenthetical' WHEN rv THEN 'cc-cedict' WHEN wd THEN 'phrase-word-partial' ELSE 'untranslated' END}},
    {{'g': upper(left(w, 1)) || substr(w, 2), 't': CASE WHEN cx THEN {_adj("k || '好'")} WHEN known THEN {_adj('k')} ELSE '{fixed.PROPER_PREFIX}' || upper(left(w, 1)) || substr(w, 2) END,
      'c': CASE WHEN cx THEN 0.98 WHEN known THEN ic ELSE 0.40 END,
      'm': CASE WHEN cx THEN 'context-exact' WHEN ex THEN 'exact' WHEN rv THEN 'cc-cedict' WHEN wd THEN 'phrase-word' ELSE 'proper-original' END}},
    {{'g': 'the ' || w || ' zz', 't': '{U}', 'c': CASE WHEN ph THEN 0.30 WHEN wd THEN 0.20 ELSE 0.10 END,
      'm': CASE WHEN ph THEN 'phrase-word-partial' WHEN wd THEN 'phrase-word-low' ELSE 'untranslated' END}},
    {{'g': 'without big ' || w, 't': '{U}', 'c': CASE WHEN wd THEN 0.20 ELSE 0.10 END, 'm': CASE WHEN wd THEN 'phrase-word-low' ELSE 'untranslated' END}}] AS f
  FROM i),
results AS (SELECT w AS entry_id, n, adj, k, [f[d % 8 + 1], f[1], f[2]] AS r FROM forms),
flat AS (SELECT entry_id, n, adj, k, unnest(r) AS x, generate_subscripts(r, 1) AS ord FROM results),
once AS (SELECT entry_id, n, adj, k, x.t AS t, min(ord) AS ord FROM flat GROUP BY ALL),
firsts AS (SELECT o.*, f.x.c AS c, f.x.m AS m FROM once o JOIN flat f ON f.entry_id = o.entry_id AND f.ord = o.ord),
per_entry AS (
  SELECT entry_id, n, adj, k, string_agg(t, '；' ORDER BY ord) AS translation, string_agg(m, ',' ORDER BY ord) AS methods, CAST(min(c) AS DOUBLE) AS confidence,
    bool_or(m IN ('untranslated', 'phrase-word-partial', 'phrase-word-low', 'proper-original')) AS needs FROM firsts GROUP BY ALL),
sourced AS (SELECT *, CASE WHEN needs OR confidence < 0.60 THEN '{fixed.REPAIR_SOURCE}' ELSE '{fixed.DICTIONARY_SOURCE}' END AS translation_source FROM per_entry)"""


def q_gloss_translations(spark, sf):
    return translated(spark, sf).select("gloss", "major", "text", "confidence", "method")


SQL_GLOSSES = SQL_RESULTS + f"""
SELECT DISTINCT x.g AS gloss, CASE WHEN adj THEN '{fixed.I_ADJ}' ELSE '{fixed.NOUN}' END AS major, x.t AS text, CAST(x.c AS DOUBLE) AS confidence, x.m AS method FROM flat"""


def overrides(spark, sf):
    return gl.entry_translations(entries(spark, sf), translated(spark, sf))


def q_entry_translations(spark, sf):
    return overrides(spark, sf).select("entry_id", "translation", "translation_source", "confidence", F.array_join("methods", ",").alias("methods"))


SQL_ENTRY = SQL_RESULTS + " SELECT entry_id, translation, translation_source, confidence, methods FROM sourced"


def q_repair_queue(spark, sf):
    q = gl.repair_queue(entries(spark, sf), overrides(spark, sf))
    return q.select("id", "level", "word", F.array_join("glosses", ",").alias("glosses"), "draft_translation", "min_confidence")


SQL_QUEUE = SQL_RESULTS + f"""
SELECT s.entry_id AS id, CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END AS level, k AS word,
  (SELECT string_agg(x.g, ',' ORDER BY ord) FROM flat f WHERE f.entry_id = s.entry_id) AS glosses, translation AS draft_translation, round(confidence, 2) AS min_confidence
FROM sourced s WHERE translation_source = '{fixed.REPAIR_SOURCE}'"""


def q_translation_outcomes(spark, sf):
    out = gl.translation_outcomes(entries(spark, sf), overrides(spark, sf), ["A"], ("LLM",))
    return out.groupBy("outcome").agg(F.count("*").alias("rows"))


SQL_OUTCOMES = SQL_RESULTS + f"""
SELECT CASE WHEN n % 2 <> 0 THEN 'skipped' WHEN n % 11 = 0 THEN 'preserved' WHEN translation_source = '{fixed.REPAIR_SOURCE}' THEN 'queued' ELSE 'translated' END AS outcome,
  count(*) AS rows FROM sourced GROUP BY 1"""


def q_override_counters(spark, sf):
    """The counters a run prints: what is queued is translated too."""
    return gl.outcome_counters(gl.translation_outcomes(entries(spark, sf), overrides(spark, sf), ["A"], ("LLM",)))


SQL_COUNTERS = SQL_RESULTS + f"""
SELECT count(*) FILTER (WHERE n % 2 = 0 AND n % 11 <> 0) AS translated_overrides, count(*) FILTER (WHERE n % 2 = 0 AND n % 11 = 0) AS preserved_existing,
  count(*) FILTER (WHERE n % 2 = 0 AND n % 11 <> 0 AND translation_source = '{fixed.REPAIR_SOURCE}') AS queued_for_llm,
  count(*) FILTER (WHERE n % 2 <> 0) AS skipped FROM sourced"""


def q_reverse_index(spark, sf):
    """Short keys shared by very many words: only the first five stay."""
    v = fd.vocabulary(spark, sf).withColumn("w", F.when(F.col("w").rlike("^[a-z]{2,10}$"), F.col("w")).otherwise(F.left(plain_word(F.col("w")), F.lit(8))))
    b = v.select(
        F.translate("w", fd.LETTERS, fd.KANJI).alias("simplified"), F.struct("first_doc", "w").alias("line_ord"),
        F.concat(F.lit("to "), F.left("w", F.lit(3)), F.lit("; "), F.left("w", F.lit(2)), F.lit(" (x)/surname "), F.left("w", F.lit(1))).alias("definitions"))
    return gl.reverse_index(b).select("key", F.array_join("candidates", SEP).alias("candidates"))


SQL_REVERSE = "WITH " + fd.SQL_VOCAB + f""",
v AS (SELECT CASE WHEN regexp_matches(w, '^[a-z]{{2,10}}$') THEN w ELSE left({SQL_PLAIN}, 8) END AS w, first_doc FROM vocab),
b AS (SELECT w, first_doc, translate(w, '{fd.LETTERS}', '{fd.KANJI}') AS s FROM v WHERE length(w) <= 8),
k AS (SELECT replace(replace('to ' || left(w, 3), 'sb', 'somebody'), 'sth', 'something') AS key, s, first_doc, w, 0 AS c FROM b
  UNION ALL SELECT replace(replace(left(w, 3), 'sb', 'somebody'), 'sth', 'something'), s, first_doc, w, 0 FROM b
  UNION ALL SELECT replace(left(w, 2), 'sb', 'somebody'), s, first_doc, w, 1 FROM b),
o AS (SELECT key, s, min((first_doc, w, c)) AS p FROM k GROUP BY key, s),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p) AS rn FROM o)
SELECT key, string_agg(s, '{SEP}' ORDER BY rn) AS candidates FROM n WHERE rn <= 5 GROUP BY key"""


def q_pending_rows(spark, sf):
    docs = fd.table(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), "lang")
    return tr.pending(docs, fd.table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id")))


SQL_PENDING = "SELECT doc_id AS entry_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"
BUDGET = 480_000


def q_character_budget(spark, sf):
    docs = fd.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return tr.within_budget(docs, "lang", "n_chars", ["doc_id"], BUDGET)


SQL_BUDGET = f"""
WITH o AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY lang, n_chars, doc_id) AS rn FROM documents WHERE n_chars > 0),
s AS (SELECT min(rn) AS first FROM o WHERE n_chars <= {BUDGET}),
c AS (SELECT *, sum(n_chars) OVER (ORDER BY rn) AS used FROM o, s WHERE rn >= first)
SELECT doc_id, lang, n_chars FROM c WHERE used <= {BUDGET}"""


def q_request_batches(spark, sf):
    docs = fd.table(spark, sf, "documents").select("doc_id", "n_chars")
    out = tr.greedy_batches(docs, F.floor(F.col("doc_id") / 256), ["doc_id"], "n_chars")
    return out.select("doc_id", "shard", "batch")


SQL_BATCHES = f"""
WITH RECURSIVE o AS (SELECT doc_id, n_chars, doc_id // 256 AS shard, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY doc_id) AS rn FROM documents),
r AS (SELECT doc_id, shard, rn, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS held, CAST(n_chars AS BIGINT) AS used FROM o WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.shard, o.rn, CASE WHEN held >= 12 OR used + o.n_chars > 6500 THEN batch + 1 ELSE batch END,
    CASE WHEN held >= 12 OR used + o.n_chars > 6500 THEN 1 ELSE held + 1 END, CASE WHEN held >= 12 OR used + o.n_chars > 6500 THEN o.n_chars ELSE used + o.n_chars END
  FROM r JOIN o ON o.shard = r.shard AND o.rn = r.rn + 1)
SELECT doc_id, shard, batch FROM r"""


def q_request_sequence(spark, sf):
    """All documents packed in one sequence of batches, in parts of 300 rows."""
    docs = fd.table(spark, sf, "documents").select("doc_id", "n_chars", F.length("lang").alias("texts"))
    return request_batches(docs, ["doc_id"], "n_chars", max_rows=12, max_chars=20_000, count="texts", part_rows=300).select("doc_id", "batch")


SQL_SEQUENCE = """
WITH RECURSIVE o AS (SELECT doc_id, n_chars, length(lang) AS texts, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
r AS (SELECT doc_id, rn, CAST(0 AS BIGINT) AS batch, CAST(texts AS BIGINT) AS held, CAST(n_chars AS BIGINT) AS used FROM o WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.rn, CASE WHEN held + o.texts > 12 OR used + o.n_chars > 20000 THEN batch + 1 ELSE batch END,
    CASE WHEN held + o.texts > 12 OR used + o.n_chars > 20000 THEN o.texts ELSE held + o.texts END, CASE WHEN held + o.texts > 12 OR used + o.n_chars > 20000 THEN o.n_chars ELSE used + o.n_chars END
  FROM r JOIN o ON o.rn = r.rn + 1)
SELECT doc_id, batch FROM r"""


def q_text_batches(spark, sf):
    """Parts as a repair queue: levels first, then short names, packed by words and characters."""
    p = fd.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 30, "B").when(F.col("p_size") > 10, "A").otherwise("D").alias("level"),
        F.col("p_brand").alias("word"), F.split(F.regexp_replace("p_name", "red", ""), " ").alias("glosses"))
    return tr.text_batches(p, 45, 300).select("id", "batch")


SQL_TEXT_BATCHES = """
WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_size > 30 THEN 1 WHEN p_size > 10 THEN 0 ELSE 9 END AS lr, p_brand AS word, string_split(replace(p_name, 'red', ''), ' ') AS g FROM part),
q AS (SELECT *, len(list_filter(g, lambda x: x <> '')) AS texts, length(array_to_string(g, '')) AS chars FROM p),
o AS (SELECT id, texts, chars, row_number() OVER (ORDER BY lr, chars, word, id) AS rn FROM q WHERE texts > 0),
r AS (SELECT id, rn, CAST(0 AS BIGINT) AS batch, CAST(texts AS BIGINT) AS held, CAST(chars AS BIGINT) AS used FROM o WHERE rn = 1
  UNION ALL SELECT o.id, o.rn, CASE WHEN held + o.texts > 45 OR used + o.chars > 300 THEN batch + 1 ELSE batch END,
    CASE WHEN held + o.texts > 45 OR used + o.chars > 300 THEN o.texts ELSE held + o.texts END, CASE WHEN held + o.texts > 45 OR used + o.chars > 300 THEN o.chars ELSE used + o.chars END
  FROM r JOIN o ON o.rn = r.rn + 1)
SELECT id, batch FROM r"""


def _part_lexicon(spark, sf) -> DataFrame:
    none = F.lit(None).cast("string")
    return fd.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_partkey").alias("doc_pos"), F.col("p_name").alias("headword"), F.col("p_brand").alias("reading"),
        F.when(F.col("p_size") > 10, "A").otherwise("B").alias("level"), F.col("p_type").alias("major"), F.array("p_type").alias("pos"),
        F.split("p_name", " ").alias("glosses"), none.alias("translation"), none.alias("translation_source"))


def _answers(requests: DataFrame, skip: int) -> DataFrame:
    """A stand-in for the service: each item's reading, but for ids that ``skip`` divides."""
    item = requests.select("batch", F.explode("items").alias("item"))
    read = item.select("batch", F.get_json_object("item", "$.id").alias("id"), F.get_json_object("item", "$.reading").alias("reading"))
    kept = read.where(F.col("id").cast("long") % skip != 0)
    return kept.groupBy("batch").agg(F.to_json(F.struct(F.collect_list(F.struct("id", F.array("reading").alias("translation"))).alias("items"))).alias("content"))


def q_translation_run(spark, sf):
    """Two runs over one cache: the second asks only for what the first got no answer to."""
    import uuid

    folder = f"{checkpoint_dir(spark)}/lexmill/run-{uuid.uuid4().hex}"
    lexicon, audit = _part_lexicon(spark, sf), spark.createDataFrame([("entries", "0", "")], "item string, amount string, note string")
    cache = Versions(spark, f"{folder}/cache")
    for n, skip in enumerate((7, 21)):
        run = translation_run(lexicon, audit, lambda r, s=skip: _answers(r, s), cache, Versions(spark, f"{folder}/run{n}"), "service", f"2024-01-0{n + 1} 00:00:00")
    asked = run.requests.select(F.explode("items").alias("item")).select(F.get_json_object("item", "$.id").alias("entry_id"), F.lit(True).alias("asked_again"))
    return run.lexicon.join(asked, "entry_id", "left").select("entry_id", "translation", "translation_source", "updated", F.coalesce("asked_again", F.lit(False)).alias("asked_again"))


SQL_RUN = """
SELECT CAST(p_partkey AS VARCHAR) AS entry_id, CASE WHEN p_partkey % 21 <> 0 THEN p_brand END AS translation,
  CASE WHEN p_partkey % 21 <> 0 THEN 'service' END AS translation_source, p_partkey % 21 <> 0 AS updated, p_partkey % 7 = 0 AS asked_again FROM part"""


def _replies(spark, sf):
    e = fd.table(spark, sf, "events")
    i, t = F.col("event_id").cast("string"), F.col("event_type")
    one = F.concat(F.lit('{"id":"'), i, F.lit('","translation":["'), t, F.lit('；'), t, F.lit('x"]}'))
    body = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('ok {"items":['), one, F.lit("]} end")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"translations":[{"id":'), i, F.lit(',"translations":"1. '), t, F.lit('; n/a"}]}')))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit('{"'), i, F.lit('":"'), t, F.lit('"}')))
        .otherwise(F.concat(F.lit("no reply "), t)))
    return e.select("event_id", body.alias("content"))


def q_parsed_replies(spark, sf):
    return tr.parse_replies(_replies(spark, sf)).select("event_id", "entry_id", F.array_join("translation", SEP).alias("translation"))


SQL_REPLIES = f"""SELECT event_id, CAST(event_id AS VARCHAR) AS entry_id,
  CASE WHEN event_id % 5 IN (0, 1) THEN event_type || '{SEP}' || event_type || 'x' ELSE event_type END AS translation FROM events WHERE event_id % 5 <> 4"""


def q_missing_replies(spark, sf):
    asked = fd.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("entry_id"), "event_type")
    return tr.missing_replies(asked, tr.parse_replies(_replies(spark, sf)))


SQL_MISSING = "SELECT CAST(event_id AS VARCHAR) AS entry_id, event_type FROM events WHERE event_id % 5 = 4"


def q_aligned_replies(spark, sf):
    c = fd.table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("batch"), F.col("turn").alias("row_ord"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("entry_id"),
                    F.split(F.replace("text", F.lit(", "), F.lit(". . ")), r"\. ").alias("glosses"))
    replies = rows.groupBy("batch").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "glosses"))), lambda x: F.transform(
        F.filter(x["glosses"], lambda g: g != ""), lambda g: F.concat(F.lit("re "), g)))).alias("texts"))
    return tr.align_replies(rows, replies).select("entry_id", F.md5("translation").alias("digest"))


SQL_ALIGNED = r"""
WITH g AS (SELECT conv_id, turn, string_split(replace(text, ', ', '. . '), '. ') AS a FROM conversations),
u AS (SELECT conv_id, turn, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM g),
t AS (SELECT conv_id, turn, i, replace(regexp_replace(regexp_replace(regexp_replace('re ' || x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '^[。.;； ]+|[。.;； ]+$', '', 'g'), '；', '、') AS y FROM u WHERE x <> ''),
d AS (SELECT conv_id, turn, CASE WHEN y = '' THEN '待译' ELSE y END AS y, min(i) AS i FROM t GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS entry_id, md5(string_agg(y, '；' ORDER BY i)) AS digest FROM d GROUP BY conv_id, turn"""


def q_applied_overrides(spark, sf):
    docs = fd.table(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), F.col("lang").alias("translation"), F.col("source").alias("translation_source"))
    over = fd.table(spark, sf, "labels").where(F.col("quality") == 1).select(
        F.col("doc_id").alias("entry_id"), F.concat(F.lit("q"), F.col("toxic").cast("string")).alias("translation"), F.lit("label").alias("translation_source"))
    return tr.apply_overrides(docs, over)


SQL_APPLIED = """SELECT d.doc_id AS entry_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'q' || CAST(toxic AS VARCHAR) END AS translation,
  CASE WHEN l.doc_id IS NULL THEN source ELSE 'label' END AS translation_source, l.doc_id IS NOT NULL AS updated
FROM documents d LEFT JOIN (SELECT * FROM labels WHERE quality = 1) l USING (doc_id)"""


def q_audit_upsert(spark, sf):
    docs = fd.table(spark, sf, "documents")
    audit = docs.groupBy(F.col("source").alias("item")).agg(F.count("*").cast("string").alias("amount")).withColumn("note", F.lit("docs"))
    labelled = docs.join(fd.table(spark, sf, "labels"), "doc_id").where(F.col("lang") == "en")
    updates = labelled.groupBy(F.col("source").alias("item")).agg(F.sum("quality").cast("string").alias("amount")).withColumn("note", F.lit(None).cast("string"))
    new = docs.groupBy(F.col("lang").alias("item")).agg(F.lit(None).cast("string").alias("amount"), F.count("*").cast("string").alias("note"))
    return tr.upsert_audit(audit, updates.unionByName(new))


SQL_UPSERT = """
WITH a AS (SELECT source AS item, CAST(count(*) AS VARCHAR) AS amount, 'docs' AS note FROM documents GROUP BY source),
u AS (SELECT source AS item, CAST(sum(quality) AS VARCHAR) AS amount, NULL AS note FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' GROUP BY source
  UNION ALL SELECT lang, NULL, CAST(count(*) AS VARCHAR) FROM documents GROUP BY lang)
SELECT item, coalesce(u.amount, a.amount, '') AS amount, coalesce(u.note, a.note, '') AS note FROM a FULL JOIN u USING (item)"""


def q_request_sizes(spark, sf):
    return tr.request_sizes(tr.request_rows(entries(spark, sf), 2))


SQL_SIZES = SQL_RESULTS.split("results AS (")[0].rstrip().rstrip(",") + f""",
e AS (SELECT w, k, CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END AS lv, CASE WHEN adj THEN '{fixed.I_ADJ}' ELSE '{fixed.NOUN}' END AS mj, f[d % 8 + 1].g AS g1 FROM forms)
SELECT count(*) AS rows, CAST(sum(length(g1) + length(w) + length(w) + 3) AS BIGINT) AS source_chars,
  CAST(sum(length('{{"id":"' || w || '","word":"' || k || '","reading":"' || w || '","level":"' || lv || '","major_pos":"' || mj || '","subpos":"n","glosses":["' || g1 || '","' || w || '"]}}')) AS BIGINT) AS request_chars FROM e"""

QUERIES = {
    "gloss_translations": (q_gloss_translations, SQL_GLOSSES),
    "entry_translations": (q_entry_translations, SQL_ENTRY),
    "repair_queue": (q_repair_queue, SQL_QUEUE),
    "translation_outcomes": (q_translation_outcomes, SQL_OUTCOMES),
    "override_counters": (q_override_counters, SQL_COUNTERS),
    "reverse_index": (q_reverse_index, SQL_REVERSE),
    "pending_rows": (q_pending_rows, SQL_PENDING),
    "character_budget": (q_character_budget, SQL_BUDGET),
    "request_batches": (q_request_batches, SQL_BATCHES),
    "text_batches": (q_text_batches, SQL_TEXT_BATCHES),
    "request_sequence": (q_request_sequence, SQL_SEQUENCE),
    "translation_run": (q_translation_run, SQL_RUN),
    "request_sizes": (q_request_sizes, SQL_SIZES),
    "parsed_replies": (q_parsed_replies, SQL_REPLIES),
    "missing_replies": (q_missing_replies, SQL_MISSING),
    "aligned_replies": (q_aligned_replies, SQL_ALIGNED),
    "applied_overrides": (q_applied_overrides, SQL_APPLIED),
    "audit_upsert": (q_audit_upsert, SQL_UPSERT),
}
