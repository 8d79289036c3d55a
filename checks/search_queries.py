"""Search over the lexicon built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import feeds as fd
from checks import lexicon_queries as lq
from lexmill import fixed
from lexmill.functions import text as tx
from lexmill.functions.collation import LARGE, MARK_BASE, MARKS, SMALL, marked
from lexmill.operators import facets as fc
from lexmill.operators import kanji as kj
from lexmill.operators import paging, search as se, search_index as si
from lexmill.operators.common import checkpoint_dir
from lexmill.operators.variants import variant_forms, with_indexed_text
from lexmill.plans.build import ordered_lexicon

SEP = fixed.LIST_SEPARATOR
BINARY = "UTF8_BINARY"


def _searchable(spark, sf) -> DataFrame:
    return ordered_lexicon(lq.lexicon(spark, sf))


def docs(spark, sf) -> DataFrame:
    return fd.stored(spark, sf, "search_docs", lambda s, f: se.search_docs(_searchable(s, f)))


def terms(spark, sf) -> DataFrame:
    return fd.stored(spark, sf, "search_terms", lambda s, f: se.search_terms(_searchable(s, f)))


_INDEXES: set = set()


def index(spark, sf) -> si.SearchIndex:
    """The stored index, in the order that SQL can state."""
    folder = f"{checkpoint_dir(spark)}/lexmill/{spark.sparkContext.applicationId}/{abs(hash(sf))}/search_index"
    if folder not in _INDEXES:
        si.write_index(docs(spark, sf), terms(spark, sf), folder, BINARY)
        _INDEXES.add(folder)
    return si.read_index(spark, folder, BINARY)


def _romaji(kana: str) -> str:
    for k, latin in fixed.ROMAJI_SINGLES.items():
        if k in fd.HIRA:
            kana = f"replace({kana}, '{k}', '{latin}')"
    return kana


SQL_DOCS = lq.ACCEPTED + f""",
r0 AS (SELECT *, regexp_replace({_romaji('reading')}, '[^a-z0-9]', '', 'g') AS ra FROM accepted),
r1 AS (SELECT *, replace(replace(replace(replace(ra, 'shi', 'si'), 'chi', 'ti'), 'tsu', 'tu'), 'fu', 'hu') AS rb,
   replace(replace(replace(replace(ra, 'ou', 'o'), 'oo', 'o'), 'uu', 'u'), 'ei', 'e') AS rc,
   lower(array_to_string(pos, '；')) AS labels FROM r0),
docs AS (SELECT *, lower(array_to_string(pos, ' ') || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(glosses, ' ')) || ' ' || ra || ' ' || rb || ' ' || rc AS latin,
  major = '{fixed.VERB}' OR {' OR '.join(f"labels LIKE '%{v.lower()}%'" for v in fixed.VERB_SEARCH_LABELS)} AS is_verb FROM r1)"""
ORDER = f"coalesce(freq_rank, {fixed.UNRANKED}), CASE WHEN freq_rank IS NOT NULL THEN reading END NULLS FIRST, major, level, reading, headword, doc_pos, entry_id"


def q_search_page(spark, sf):
    request = se.SearchRequest(text="tion", page=2, page_size=24, levels=("A", "B"))
    page = si.indexed_search(index(spark, sf), request)
    return page.select("entry_id", "headword", "level", "freq_rank", F.col("score").cast("int").alias("score"))


_PAGE = """ FROM docs WHERE contains(latin, 'tion') AND level IN ('A', 'B')"""
SQL_PAGE = SQL_DOCS + f"""
SELECT entry_id, headword, level, freq_rank, CAST(0 AS INTEGER) AS score {_PAGE} ORDER BY {ORDER}
LIMIT 24 OFFSET (SELECT greatest(0, least(1, CAST(ceil(count(*) / 24.0) AS INTEGER) - 1)) * 24 {_PAGE})"""


DEEP = 25


def q_deep_page(spark, sf):
    """The last page of all entries, opened by the rank directory."""
    page = si.indexed_search(index(spark, sf), se.SearchRequest(page=10**9, page_size=DEEP))
    return page.select("entry_id", "headword", "freq_rank")


SQL_DEEP = SQL_DOCS + f""",
n AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS place, count(*) OVER () AS total FROM docs)
SELECT entry_id, headword, freq_rank FROM n WHERE place > (greatest(total, 1) - 1) // {DEEP} * {DEEP}"""


def q_next_page(spark, sf):
    """The entries after the one at place 1,000 (or the last of page 1,000), by its key."""
    held = index(spark, sf)
    last = paging.directory_page(held.docs, ["part"], se.result_order(se.SearchRequest(), BINARY), 1000, 1, held.directory.collect())
    return si.following(held, last, 48).select("entry_id", "headword", "freq_rank")


SQL_NEXT = SQL_DOCS + f""",
n AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS place FROM docs)
SELECT entry_id, headword, freq_rank FROM n WHERE place BETWEEN 1001 AND 1048"""


def q_search_matches(spark, sf):
    """Entries that hold two typed words, one of them a single letter: by postings and the exact test."""
    request = se.SearchRequest(text="ent a", levels=("A", "C"))
    return si.indexed_matching(index(spark, sf), request).select("entry_id", "headword", "level")


SQL_MATCHES = SQL_DOCS + " SELECT entry_id, headword, level FROM docs WHERE contains(latin, 'ent') AND contains(latin, 'a') AND level IN ('A', 'C')"


def _exact_queries(spark, sf) -> DataFrame:
    b = fd.tokens(spark, sf, "benchmark", ("item_id",)).select("w").distinct()
    two = F.concat(fd.hira("w"), F.lit(" "), fd.kanji_form("w"))
    return b.select(F.explode(F.array(F.struct(F.concat("w", F.lit("-1")).alias("query_id"), fd.kata("w").alias("text")),
                                      F.struct(F.concat("w", F.lit("-2")).alias("query_id"), two.alias("text")))).alias("q")).select("q.*")


def q_exact_scores(spark, sf):
    s = se.batch_exact_scores(terms(spark, sf), se.query_table(_exact_queries(spark, sf)))
    return s.select("query_id", "entry_id", F.col("score").cast("int").alias("score"))


_H = f"translate(w, '{fd.LETTERS}', '{fd.HIRA}')"
# (entry_id, term, s): exact terms and the weight of their best kind
TERM_KINDS = f"""t AS (SELECT entry_id, 40 AS s, unnest(list_concat([headword], writings)) AS term FROM accepted
  UNION ALL SELECT entry_id, 20, unnest(regexp_extract_all(headword, '[{fixed.CJK}]')) FROM accepted
  UNION ALL SELECT entry_id, 32, unnest(readings) FROM accepted),
nt AS (SELECT entry_id, translate(term, '{fd.KATA}', '{fd.HIRA}') AS term, max(s) AS s FROM t GROUP BY ALL),
x0 AS (SELECT entry_id, regexp_replace({_romaji('reading')}, '[^a-z0-9]', '', 'g') AS ra FROM accepted),
rom AS (SELECT entry_id, unnest([ra, replace(replace(replace(replace(ra, 'shi', 'si'), 'chi', 'ti'), 'tsu', 'tu'), 'fu', 'hu'),
   replace(replace(replace(replace(ra, 'ou', 'o'), 'oo', 'o'), 'uu', 'u'), 'ei', 'e')]) AS term FROM x0),
al AS (SELECT entry_id, term, max(s) AS s FROM (SELECT * FROM nt UNION ALL SELECT entry_id, term, 30 FROM rom WHERE term <> '') GROUP BY ALL)"""
SQL_EXACT = lq.ACCEPTED + f""",
b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{fd.WORD}')) AS w FROM benchmark),
q AS (SELECT w || '-1' AS query_id, {_H} AS token FROM b UNION SELECT w || '-2', {_H} FROM b UNION SELECT w || '-2', {fd.SQL_KANJI_FORM} FROM b),
need AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1),
{TERM_KINDS}
SELECT q.query_id, al.entry_id, CAST(min(al.s) AS INTEGER) AS score FROM q JOIN al ON al.term = q.token JOIN need n ON n.query_id = q.query_id
GROUP BY q.query_id, al.entry_id, n.need HAVING count(*) = n.need"""


def _word_queries(spark, sf) -> DataFrame:
    b = fd.tokens(spark, sf, "benchmark", ("item_id",)).select("w").distinct()
    return b.select(F.col("w").alias("query_id"), F.concat("w", F.lit(" "), F.left("w", F.lit(5))).alias("text"))


def q_batch_search(spark, sf):
    out = se.batch_search(docs(spark, sf), terms(spark, sf), _word_queries(spark, sf), page_size=24, collation=BINARY)
    return out.select("query_id", F.col("position").cast("bigint").alias("position"), "entry_id", F.col("score").cast("int").alias("score"))


SQL_BATCH = SQL_DOCS + f""",
b AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '{fd.WORD}')) AS w FROM benchmark)),
{TERM_KINDS},
h AS (SELECT w AS query_id, docs.*, CAST(coalesce(CASE WHEN x.s IS NOT NULL AND y.s IS NOT NULL THEN least(x.s, y.s) END, 0) AS INTEGER) AS score FROM b JOIN docs ON contains(latin, w)
  LEFT JOIN al x ON x.entry_id = docs.entry_id AND x.term = w LEFT JOIN al y ON y.entry_id = docs.entry_id AND y.term = left(w, 5)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ORDER}) AS position FROM h)
SELECT query_id, position, entry_id, score FROM n WHERE position <= 24"""


def q_part_groups(spark, sf):
    d = docs(spark, sf).select(F.explode("part_groups").alias("part_group"), "is_verb")
    return d.groupBy("part_group").agg(F.count("*").alias("entries"), F.count_if("is_verb").alias("verbs"))


def _group_sql():
    tests: dict[str, list[str]] = {}
    for group, how, values in fixed.PART_GROUPS:
        quoted = [v.replace("'", "''") for v in values]
        if how == "major":
            t = [f"major = '{v}'" for v in quoted]
        elif how == "transitivity":
            t = [f"coalesce(transitivity, '') = '{v}'" for v in quoted]
        elif how == "freq_pos":
            t = [f"coalesce(freq_pos, '') LIKE '%{v}%'" for v in quoted]
        elif how == "contains":
            t = [f"labels LIKE '%{v.lower()}%'" for v in quoted]
        elif how == "equals":
            t = [f"list_contains(string_split(labels, '；'), '{v.lower()}')" for v in quoted]
        else:
            t = [f"len(list_filter(string_split(labels, '；'), lambda z: starts_with(z, '{v.lower()}'))) > 0" for v in quoted]
        tests.setdefault(group, []).extend(t)
    return " UNION ALL ".join(
        f"SELECT '{g}' AS part_group, count(*) AS entries, count(*) FILTER (WHERE is_verb) AS verbs FROM docs WHERE {' OR '.join(t)} HAVING count(*) > 0"
        for g, t in tests.items())


SQL_GROUPS = SQL_DOCS + " " + _group_sql()


def q_transitive_search(spark, sf):
    """Transitivity applies to the result as soon as it holds a verb."""
    found = se.matching(docs(spark, sf), se.SearchRequest(text="ing", transitivity=fixed.TRANSITIVE))
    return found.select("entry_id", "major", "transitivity")


SQL_TRANSITIVE = SQL_DOCS + f""",
f AS (SELECT * FROM docs WHERE contains(latin, 'ing'))
SELECT entry_id, major, transitivity FROM f WHERE NOT (SELECT bool_or(is_verb) FROM f) OR list_contains(string_split(labels, '；'), 'transitive verb') OR transitivity = '{fixed.TRANSITIVE}'"""


def q_nouns_ignore_transitivity(spark, sf):
    request = se.SearchRequest(major=fixed.NOUN, transitivity=fixed.INTRANSITIVE, text="er")
    found = se.matching(docs(spark, sf).where(~F.col("is_verb")), request)
    return found.groupBy("level").agg(F.count("*").alias("n"))


SQL_NOUNS = SQL_DOCS + f" SELECT level, count(*) AS n FROM docs WHERE major = '{fixed.NOUN}' AND NOT is_verb AND contains(latin, 'er') GROUP BY level"


def q_kanji_reading(spark, sf):
    """Entries with a kanji read in one way at the kanji's place."""
    request = se.SearchRequest(kanji="学", kanji_reading="あ")
    return se.matching(docs(spark, sf), request).select("entry_id", "headword", "reading")


SQL_KANJI_READING = lq.ACCEPTED + f""",
c AS (SELECT *, len(regexp_extract_all(wr, '.')) AS size FROM (SELECT *, unnest(list_distinct(list_concat([headword], writings))) AS wr FROM accepted WHERE contains(headword, '学'))),
p AS (SELECT *, unnest(generate_series(1, size)) AS i FROM c WHERE contains(wr, '学'))
SELECT DISTINCT entry_id, headword, reading FROM p WHERE substr(wr, i, 1) = '学' AND contains(reading, 'あ')
  AND ((i = 1 AND starts_with(reading, 'あ')) OR (i = size AND ends_with(reading, 'あ')) OR (i > 1 AND i < size))"""


def q_result_summary(spark, sf):
    found = se.matching(docs(spark, sf), se.SearchRequest(text="an", levels=("A", "B")))
    return fc.result_summary(found)


SQL_SUMMARY = SQL_DOCS + f""",
f AS (SELECT * FROM docs WHERE contains(latin, 'an') AND level IN ('A', 'B'))
SELECT count(*) AS results, count(DISTINCT major) AS majors,
  (SELECT count(DISTINCT c) FROM (SELECT unnest(regexp_extract_all(headword, '[{fixed.CJK}]')) AS c FROM f)) AS kanji FROM f"""


def q_status_filters(spark, sf):
    """Documents one has learned, or not, per status."""
    d = fd.table(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), "lang")
    progress = fd.table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id"), F.when(F.col("quality") == 1, "learned").otherwise("starred").alias("status"))
    parts = [se.with_status(d, progress, s).withColumn("shown", F.lit(s)) for s in ("starred", "learned", "unlearned")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SQL_STATUS = """
SELECT doc_id AS entry_id, lang, 'starred' AS shown FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT doc_id, lang, 'learned' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT doc_id, lang, 'unlearned' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""


def q_part_search(spark, sf):
    """Faceted page over the part table, the flagship filter chain without text tables."""
    p = fd.table(spark, sf, "part").select(
        F.col("p_partkey").alias("entry_id"), F.col("p_partkey").alias("source_ord"), F.col("p_name").alias("headword"), F.col("p_name").alias("reading"),
        F.col("p_type").alias("major"), F.col("p_brand").alias("cluster"), F.lit("A").alias("level"), F.lit("").alias("ref_level"), F.lit("").alias("transitivity"),
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("freq_rank"), F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("search_text"))
    request = se.SearchRequest(text="red  economy", page_size=96)
    return se.search(p, None, request, collation=BINARY).select(F.col("entry_id").alias("p_partkey"), F.col("headword").alias("p_name"), F.col("freq_rank").alias("rank"))


SQL_PART_SEARCH = f"""
SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN p_size END AS rank FROM part
WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'economy')
ORDER BY CASE WHEN p_size > 10 THEN p_size ELSE {fixed.UNRANKED} END, CASE WHEN p_size > 10 THEN p_name END NULLS FIRST, p_partkey LIMIT 96"""


def q_sorted_by_reading(spark, sf):
    """First page in Japanese order of the reading."""
    request = se.SearchRequest(sort="reading", page_size=200)
    return se.search(docs(spark, sf), terms(spark, sf), request).select("entry_id", "reading")


# readings hold plain and voiced hiragana, both sizes of tsu and letters with and without marks; no long mark and no kanji
_OWN, _BARE = zip(*((c, plain) for c, (plain, _) in marked().items()))
_MARKED = "".join(_OWN)
_CLASSES = "".join(chr(MARK_BASE + MARKS.index(m)) for _, m in marked().values())
_SPAN = f"{chr(MARK_BASE)}-{chr(MARK_BASE + len(MARKS) - 1)}"
_SMALL = f"translate(reading, '{SMALL}', '{LARGE}')"
SQL_SORTED = SQL_DOCS + f""",
k AS (SELECT entry_id, reading, doc_pos, major, level, headword, freq_rank,
  translate({_SMALL}, '{_MARKED}', '{"".join(_BARE)}') AS k1,
  regexp_replace(regexp_replace(translate(reading, '{_MARKED}', '{_CLASSES}'), '[^{_SPAN}]', 'a', 'g'), '([{_SPAN}])', 'a\\1', 'g') AS k2,
  regexp_replace(regexp_replace(regexp_replace(reading, '[{SMALL}]', '1', 'g'), '[ぁ-ゖ]', '2', 'g'), '[^012]', '1', 'g') AS k3 FROM docs)
SELECT entry_id, reading FROM k ORDER BY k1, k2, k3, headword, major, level, reading, doc_pos, entry_id LIMIT 200"""


def q_random_page(spark, sf):
    return se.search(docs(spark, sf), terms(spark, sf), se.SearchRequest(sort="random", seed=7, page_size=48)).select("entry_id", "headword")


SQL_RANDOM = SQL_DOCS + " SELECT entry_id, headword FROM docs ORDER BY md5(entry_id || ':7'), entry_id LIMIT 48"


SWAPPED = "badcfehgjilknmporqtsvuxwzy"


def variants(spark, sf) -> DataFrame:
    """Each character and the one of the neighbouring letter, for letters that start a word."""
    v = fd.vocabulary(spark, sf).where(F.col("w").rlike("^[a-z]")).select(F.left("w", F.lit(1)).alias("c")).distinct()
    return v.select(F.translate("c", fd.LETTERS, fd.KANJI).alias("kanji"), F.lit(0).alias("ord"), F.translate("c", SWAPPED, fd.KANJI).alias("variant"))


def q_variant_forms(spark, sf):
    runs = lq.lexicon(spark, sf).select(F.explode(tx.kanji_runs("headword")).alias("run"))
    return variant_forms(runs, "run", variants(spark, sf)).select("run", F.array_join("forms", SEP).alias("forms"))


_SW = f"translate({{}}, '{fd.KANJI}', translate('{SWAPPED}', '{fd.LETTERS}', '{fd.KANJI}'))"
_A, _B = "substr(run, 1, 1)", "substr(run, 2, 1)"
SQL_VARIANTS = lq.ACCEPTED + f""",
r AS (SELECT DISTINCT unnest(regexp_extract_all(headword, '[{fixed.CJK}]+')) AS run FROM accepted),
ok AS (SELECT DISTINCT translate(left(w, 1), '{fd.LETTERS}', '{fd.KANJI}') AS k FROM vocab WHERE regexp_matches(w, '^[a-z]')),
c AS (SELECT run, CASE WHEN {_A} IN (SELECT k FROM ok) THEN [{_A}, {_SW.format(_A)}] ELSE [{_A}] END AS a,
  CASE WHEN length(run) < 2 THEN [''] WHEN {_B} IN (SELECT k FROM ok) THEN [{_B}, {_SW.format(_B)}] ELSE [{_B}] END AS b FROM r)
SELECT run, array_to_string(flatten(list_transform(a, lambda x: list_transform(b, lambda y: x || y))), '{SEP}') AS forms FROM c"""


def q_variant_texts(spark, sf):
    """Headwords with the variant forms of their kanji behind them, as they are indexed."""
    texts = lq.lexicon(spark, sf).select("entry_id", F.col("headword").alias("text"))
    return with_indexed_text(texts, "entry_id", "text", variants(spark, sf)).select("entry_id", "text")


# a headword has one run at most: its first two letters
SQL_VARIANT_TEXTS = SQL_VARIANTS.rsplit("SELECT run,", 1)[0] + f""",
v AS (SELECT run, list_filter(flatten(list_transform(a, lambda x: list_transform(b, lambda y: x || y))), lambda z: z <> run) AS forms FROM c)
SELECT entry_id, headword || CASE WHEN len(forms) > 0 THEN ' ' || array_to_string(forms, ' ') ELSE '' END AS text
FROM accepted LEFT JOIN v ON v.run = regexp_extract(headword, '[{fixed.CJK}]+')"""


def q_kanji_detail(spark, sf):
    """Facts, readings and entries of one kanji."""
    lex = _searchable(spark, sf).withColumn("translation", F.lit(None).cast("string"))
    found = kj.kanji_detail(kj.kanji_index(lex, kj.kanji_metadata(lq.tree(spark, sf))), terms(spark, sf), lex, "入")
    return found.select("kanji", "count", F.array_join("on_readings", SEP).alias("on_readings"), F.array_join("kun_readings", SEP).alias("kun_readings"),
                        F.array_join("own_entries.entry_id", SEP).alias("entries"), F.array_join(F.sort_array("entry_readings"), SEP).alias("entry_readings"))


SQL_KANJI_DETAIL = lq.ACCEPTED + fd.SQL_KANJI_FACTS + f""",
o AS (SELECT * FROM accepted WHERE headword = '入' OR list_contains(writings, '入') ORDER BY freq_rank NULLS LAST, major, level, reading, headword, doc_pos LIMIT 8)
SELECT '入' AS kanji, (SELECT count(*) FROM accepted WHERE contains(headword, '入')) AS count,
  coalesce((SELECT on_readings FROM facts WHERE kanji = '入'), '') AS on_readings, coalesce((SELECT kun_readings FROM facts WHERE kanji = '入'), '') AS kun_readings,
  (SELECT string_agg(entry_id, '{SEP}' ORDER BY coalesce(freq_rank, {fixed.UNRANKED}), major, level, reading, headword, doc_pos) FROM o) AS entries,
  (SELECT array_to_string(list_sort(list_distinct(flatten(list(list_concat([reading], readings))))), '{SEP}') FROM o) AS entry_readings"""


def q_own_entries(spark, sf):
    lex = _searchable(spark, sf).withColumn("translation", F.lit(None).cast("string"))
    return kj.own_entries(terms(spark, sf), lex, "学").select("entry_id", "headword", "level")


SQL_OWN = lq.ACCEPTED + """ SELECT entry_id, headword, level FROM accepted WHERE headword = '学' OR list_contains(writings, '学')
ORDER BY freq_rank NULLS FIRST, entry_id LIMIT 8"""


QUERIES = {
    "search_page": (q_search_page, SQL_PAGE),
    "deep_page": (q_deep_page, SQL_DEEP),
    "next_page": (q_next_page, SQL_NEXT),
    "search_matches": (q_search_matches, SQL_MATCHES),
    "exact_scores": (q_exact_scores, SQL_EXACT),
    "batch_search": (q_batch_search, SQL_BATCH),
    "part_groups": (q_part_groups, SQL_GROUPS),
    "transitive_search": (q_transitive_search, SQL_TRANSITIVE),
    "transitivity_ignored": (q_nouns_ignore_transitivity, SQL_NOUNS),
    "kanji_reading": (q_kanji_reading, SQL_KANJI_READING),
    "result_summary": (q_result_summary, SQL_SUMMARY),
    "status_filters": (q_status_filters, SQL_STATUS),
    "part_search": (q_part_search, SQL_PART_SEARCH),
    "sorted_by_reading": (q_sorted_by_reading, SQL_SORTED),
    "random_page": (q_random_page, SQL_RANDOM),
    "variant_forms": (q_variant_forms, SQL_VARIANTS),
    "variant_texts": (q_variant_texts, SQL_VARIANT_TEXTS),
    "kanji_detail": (q_kanji_detail, SQL_KANJI_DETAIL),
    "own_entries": (q_own_entries, SQL_OWN),
}
