"""Operator inputs derived from the given tables, in Spark and in SQL.

The tables hold no Japanese, so script-bearing columns are made by mapping the
letters of their words to kana and kanji. Every feed reads whole tables and
grows with them. ``SQL_*`` strings are the matching common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill import fixed
from lexmill.operators.common import checkpoint_dir, spread_scan

WORD = "[a-zà-ÿ]+"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HIRA = "あぶくむるふげはいじからめんおぱきれすつうゔわやしぞ"
KATA = "アブクムルフゲハイジカラメンオパキレスツウヴワヤシゾ"
KANJI = "学校食楽会国車電山川水火木金土日月人大小中上下出入生"

FREQ_NOUN, FREQ_VERB, FREQ_ADJ = "名詞-普通名詞-一般", "動詞-一般", "形容詞-一般"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with enough tasks for work on whole texts."""
    return spread_scan(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")


def hira(c) -> Column:
    return F.translate(c, LETTERS, HIRA)


def kata(c) -> Column:
    return F.translate(c, LETTERS, KATA)


def kanji_form(c: str) -> Column:
    return F.concat(F.translate(F.left(F.col(c), F.lit(2)), LETTERS, KANJI), F.translate(F.substr(F.col(c), F.lit(3)), LETTERS, HIRA))


_STORED: dict = {}


def stored(spark, sf, name: str, make) -> DataFrame:
    """A table built once per session and kept as Parquet in the shared folder.

    This is what the build job does with its outputs: later queries read the
    stored columns they need instead of building the lexicon again.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = f"{checkpoint_dir(spark)}/lexmill/{key[0]}/{abs(hash(sf))}/{name}"
        make(spark, sf).write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def tokens(spark, sf, name="documents", keys=("doc_id", "lang"), text="text") -> DataFrame:
    source = documents(spark, sf) if name == "documents" else table(spark, sf, name)
    return source.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("w"))


def vocabulary(spark, sf) -> DataFrame:
    """Distinct words with their counts; most feeds start here, so it is stored."""
    return stored(spark, sf, "vocabulary", count_words)


def count_words(spark, sf) -> DataFrame:
    return tokens(spark, sf).groupBy("w").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


SQL_VOCAB = f"""
tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM documents),
vocab AS (SELECT w, count(*) AS n, min(doc_id) AS first_doc FROM tok GROUP BY w)"""


def ranked_vocabulary(spark, sf) -> DataFrame:
    """Vocabulary with its competition rank by count.

    The rank of a count is one more than the words counted more often, so it
    comes from the short table of distinct counts, not from a global window
    over the words.
    """
    from pyspark.sql import Window as W

    vocab = vocabulary(spark, sf)
    per_count = vocab.groupBy("n").agg(F.count("*").alias("words"))
    above = F.sum("words").over(W.orderBy(F.desc("n"))) - F.col("words") + 1
    return vocab.join(per_count.select("n", above.cast("int").alias("rank")), "n")


SQL_RANKED = SQL_VOCAB + """,
ranked AS (SELECT w, n, first_doc, CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS rank FROM vocab)"""


def frequency_list(spark, sf) -> DataFrame:
    """Frequency records of the vocabulary; a quarter have a form no entry reads."""
    v = ranked_vocabulary(spark, sf).where(F.col("rank") <= fixed.FREQ_MAX_RANK)
    length = F.length("w")
    return v.select(
        "rank",
        kanji_form("w").alias("lemma"),
        F.concat(kata("w"), F.when(length % 4 == 1, "ー").otherwise("")).alias("form"),
        F.when(length % 3 == 0, FREQ_NOUN).when(length % 3 == 1, FREQ_VERB).otherwise(FREQ_ADJ).alias("freq_pos"),
        F.col("n").cast("string").alias("freq_count"),
        F.col("n").cast("string").alias("freq_pmw"),
        F.col("w").alias("line_ord"),
    )


_M = lambda c, to: f"translate({c}, '{LETTERS}', '{to}')"
SQL_KANJI_FORM = f"{_M('left(w, 2)', KANJI)} || {_M('substr(w, 3)', HIRA)}"
SQL_FREQ = f""",
freq AS (
  SELECT w, rank, {SQL_KANJI_FORM} AS lemma,
    {_M('w', KATA)} || CASE WHEN length(w) % 4 = 1 THEN 'ー' ELSE '' END AS form,
    {_M('w', HIRA)} || CASE WHEN length(w) % 4 = 1 THEN 'ー' ELSE '' END AS hform,
    CASE WHEN length(w) % 3 = 0 THEN '{FREQ_NOUN}' WHEN length(w) % 3 = 1 THEN '{FREQ_VERB}' ELSE '{FREQ_ADJ}' END AS freq_pos,
    CAST(n AS VARCHAR) AS freq_count
  FROM ranked WHERE rank <= {fixed.FREQ_MAX_RANK}),
freq_key AS (
  SELECT key, min(rank) AS rank, arg_min(freq_pos, (rank, w)) AS freq_pos, arg_min(hform, (rank, w)) AS hform,
         arg_min(freq_count, (rank, w)) AS freq_count, arg_min(w, (rank, w)) AS fw
  FROM (SELECT lemma AS key, * FROM freq UNION ALL SELECT form, * FROM freq WHERE form <> lemma
        UNION ALL SELECT hform, * FROM freq WHERE hform <> form AND hform <> lemma) GROUP BY key)"""


def _start(letter: str) -> Column:
    return F.col("w").startswith(letter)


def dictionary(spark, sf) -> DataFrame:
    """Dictionary entries made of the vocabulary, in the shape the XML reader gives."""
    v = vocabulary(spark, sf)
    n, length = F.col("n"), F.length("w")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    el = lambda text, tags: F.struct(text.alias("text"), tags.alias("tags"))
    none_el = F.array().cast("array<struct<text:string,tags:array<string>>>")
    first = el(
        kanji_form("w"),
        F.when(n >= 400, arr("ichi1", "nf01")).when(n >= 100, arr("news2", "nf24")).when(n >= 40, arr("nf33")).otherwise(arr()),
    )
    second = el(kata("w"), F.when(n >= 200, arr("spec2")).otherwise(arr()))
    written = F.when(length % 5 == 0, none_el).when(n >= 20, F.array(first, second)).otherwise(F.array(first))
    spoken_1 = el(hira("w"), F.when(n >= 1000, arr("gai1")).otherwise(arr()))
    spoken = F.when(n % 3 == 0, F.array(spoken_1, el(kata("w"), arr()))).otherwise(F.array(spoken_1))
    pos = (
        F.when(_start("z"), arr("ctr", "n"))
        .when(_start("k"), arr("exp"))
        .when(length % 6 == 0, arr("noun (common) (futsuumeishi)"))
        .when(length % 6 == 1, arr("v1", "vt"))
        .when(length % 6 == 2, arr("Godan verb with 'ru' ending", "vi"))
        .when(length % 6 == 3, arr("adj-i"))
        .when(length % 6 == 4, arr("adj-na"))
        .otherwise(arr("noun (common) (futsuumeishi)", "noun or participle which takes the aux. verb suru"))
    )
    gloss = lambda c: F.struct(c.alias("text"), F.lit(None).cast("string").alias("lang"))
    w = F.col("w")
    sense_1 = F.struct(
        pos.alias("pos"), F.when(_start("q"), arr("archaism")).otherwise(arr()).alias("misc"),
        F.when(_start("x"), arr("Kansai dialect")).otherwise(arr()).alias("dial"),
        F.when(_start("j"), arr("Buddhist term")).otherwise(arr()).alias("field"),
        F.array(gloss(w), gloss(F.concat(F.lit("to "), w)), gloss(F.concat(w, F.lit(" (thing)"))), gloss(F.concat(F.lit("not "), w))).alias("gloss"),
    )
    sense_2 = F.struct(
        arr("n").alias("pos"), F.when(n % 2 == 0, arr("rare term")).otherwise(arr()).alias("misc"), arr().alias("dial"), arr().alias("field"),
        F.array(gloss(F.concat(w, F.lit(" two"))), gloss(w)).alias("gloss"),
    )
    return v.select(
        F.col("first_doc").alias("doc_pos"), w.alias("ent_seq"), written.alias("written"), spoken.alias("spoken"),
        F.when(length % 7 == 0, F.array(sense_1, sense_2)).otherwise(F.array(sense_1)).alias("senses"),
    )


def _case_tails(tails, on, label):
    """SQL conditions for suffix rules; generated from the fixed suffix lists."""
    def cond(t):
        return " OR ".join(f"ends_with({c}, '{t}')" for c in on)
    return " ".join(f"WHEN {cond(t)} THEN '{label(t)}'" for t in tails)


def sql_cluster(surface: str, basis: str, major: str, conj: str) -> str:
    f = fixed
    pair = " ".join(f"WHEN ends_with({basis}, '{t}') THEN '{label}'" for t, label in f.PAIR_TAILS)
    return f"""CASE
  WHEN {major} = '{f.VERB}' THEN CASE {_case_tails(['する'], [surface, basis], lambda t: f.SURU_CLUSTER)}
     {_case_tails(f.COMPOUND_TAILS, [surface, basis], lambda t: f.COMPOUND_LABEL + t)} {pair} ELSE '{f.CONJUGATION_LABEL}' || {conj} END
  WHEN {major} = '{f.I_ADJ}' THEN CASE {_case_tails(f.I_ADJ_TAILS, [basis], lambda t: f.I_ADJ_TAIL_LABEL + t)} ELSE '{f.I_ADJ_DEFAULT}' END
  WHEN {major} = '{f.NA_ADJ}' THEN CASE {_case_tails(['的'], [surface], lambda t: f.NA_ADJ_TEKI_LABEL)}
     {_case_tails(f.NA_ADJ_TAILS, [surface, basis], lambda t: f.NA_ADJ_TAIL_LABEL + t)} ELSE '{f.NA_ADJ_DEFAULT}' END
  WHEN {major} = '{f.NOUN}' THEN CASE WHEN regexp_matches({surface}, '{f.KANA_ONLY}') THEN '{f.KANA_NOUN}'
     WHEN regexp_matches({surface}, '[{f.CJK}]') THEN '{f.KANJI_NOUN}' ELSE '{f.OTHER_NOUN}' END END"""


_L = fixed.POS_LABELS
_NOUN_FULL = "noun (common) (futsuumeishi)"
SQL_ENTRIES = SQL_RANKED + SQL_FREQ + f""",
shaped AS (
  SELECT w AS entry_id, n, first_doc AS doc_pos, length(w) AS len, length(w) % 5 <> 0 AS written,
    {SQL_KANJI_FORM} AS keb, {_M('w', HIRA)} AS hira, {_M('w', KATA)} AS kata, left(w, 1) AS c1
  FROM vocab),
raw AS (
  SELECT *, CASE WHEN written THEN keb ELSE hira END AS headword0,
    CASE WHEN NOT written THEN CAST([] AS VARCHAR[]) WHEN n >= 20 AND kata <> keb THEN [keb, kata] WHEN n >= 20 THEN [keb, kata] ELSE [keb] END AS writings,
    CASE WHEN n % 3 = 0 THEN [hira, kata] ELSE [hira] END AS readings,
    list_concat(list_concat(
      CASE WHEN NOT written THEN CAST([] AS VARCHAR[]) WHEN n >= 400 THEN ['ichi1', 'nf01'] WHEN n >= 100 THEN ['news2', 'nf24']
           WHEN n >= 40 THEN ['nf33'] ELSE CAST([] AS VARCHAR[]) END,
      CASE WHEN written AND n >= 200 THEN ['spec2'] ELSE CAST([] AS VARCHAR[]) END),
      CASE WHEN n >= 1000 THEN ['gai1'] ELSE CAST([] AS VARCHAR[]) END) AS tags,
    c1 NOT IN ('q', 'x') AS sense_1, len % 7 = 0 AND n % 2 = 1 AS sense_2,
    CASE WHEN c1 = 'z' THEN ['{_L['ctr']}', '{_L['n']}'] WHEN c1 = 'k' THEN ['{_L['exp']}']
      WHEN len % 6 = 0 THEN ['{_NOUN_FULL}'] WHEN len % 6 = 1 THEN ['{_L['v1']}', '{_L['vt']}']
      WHEN len % 6 = 2 THEN ['Godan verb with ''ru'' ending', '{_L['vi']}'] WHEN len % 6 = 3 THEN ['{_L['adj-i']}']
      WHEN len % 6 = 4 THEN ['{_L['adj-na']}'] ELSE ['{_NOUN_FULL}', 'noun or participle which takes the aux. verb suru'] END AS pos_1
  FROM shaped),
described AS (
  SELECT *,
    CASE WHEN written AND n >= 20 AND n < 40 THEN
           CASE WHEN length(keb) < length(kata) OR (length(keb) = length(kata) AND keb <= kata) THEN keb ELSE kata END
         ELSE headword0 END AS headword,
    list_concat(CASE WHEN sense_1 THEN pos_1 ELSE CAST([] AS VARCHAR[]) END,
      CASE WHEN sense_2 AND NOT (sense_1 AND list_contains(pos_1, '{_L['n']}')) THEN ['{_L['n']}'] ELSE CAST([] AS VARCHAR[]) END) AS pos,
    CASE WHEN c1 = 'j' THEN ['Buddhist term'] ELSE CAST([] AS VARCHAR[]) END AS fields,
    CASE WHEN sense_1 AND sense_2 THEN [entry_id, 'to ' || entry_id, entry_id || ' (thing)', entry_id || ' two']
         WHEN sense_1 THEN [entry_id, 'to ' || entry_id, entry_id || ' (thing)']
         WHEN sense_2 THEN [entry_id || ' two', entry_id] ELSE CAST([] AS VARCHAR[]) END AS glosses
  FROM raw),
probe AS (
  SELECT entry_id, readings, wk, k.key AS key, k.ord AS ord FROM (
    SELECT entry_id, readings, regexp_matches(array_to_string(list_concat([headword], writings), ''), '[{fixed.CJK}]') AS wk,
      unnest(list_transform(
        CASE WHEN regexp_matches(array_to_string(list_concat([headword], writings), ''), '[{fixed.CJK}]')
          THEN list_concat([headword], writings) ELSE list_concat(list_concat([headword], writings), readings) END,
        lambda x, i: {{'key': x, 'ord': i}})) AS k
    FROM described)),
hit AS (
  SELECT entry_id, min(f.rank) AS freq_rank, arg_min(f.freq_pos, (f.rank, p.ord)) AS freq_pos,
         arg_min(f.freq_count, (f.rank, p.ord)) AS freq_count
  FROM probe p JOIN freq_key f ON p.key = f.key
  WHERE NOT wk OR list_contains(readings, f.hform) GROUP BY entry_id),
graded AS (
  SELECT d.*, array_to_string(pos, ' | ') AS joined, h.freq_rank, h.freq_pos, h.freq_count,
    CASE WHEN len(tags) = 0 THEN NULL
      WHEN list_has_any(tags, ['ichi1','news1','spec1','gai1']) OR list_contains(tags, 'nf01') THEN 'A'
      WHEN list_has_any(tags, ['ichi2','news2','spec2','gai2']) OR list_contains(tags, 'nf24') THEN 'B' ELSE 'C' END AS evidence_level,
    CASE WHEN h.freq_rank <= 5000 THEN 'A' WHEN h.freq_rank <= 30000 THEN 'B' WHEN h.freq_rank IS NOT NULL THEN 'C' END AS freq_level
  FROM described d LEFT JOIN hit h USING (entry_id)),
classed AS (
  SELECT *, coalesce(evidence_level, freq_level) AS level,
    CASE WHEN joined LIKE '%adjective (keiyoushi)%' OR joined LIKE '%yoi/ii class%' THEN '{fixed.I_ADJ}'
      WHEN joined LIKE '%adjectival nouns%' OR joined LIKE '%''taru'' adjective%' THEN '{fixed.NA_ADJ}'
      WHEN regexp_matches(joined, '\\bverb\\b') THEN '{fixed.VERB}'
      WHEN joined LIKE '%noun%' OR joined LIKE '%numeric%' THEN '{fixed.NOUN}' END AS major
  FROM graded),
entries AS (
  SELECT *, hira AS reading,
    CASE WHEN major = '{fixed.VERB}' THEN CASE WHEN joined LIKE '%intransitive verb%' THEN '{fixed.BOTH_TRANSITIVITIES}'
       WHEN joined LIKE '%transitive verb%' THEN '{fixed.TRANSITIVE}' END END AS transitivity,
    CASE WHEN major = '{fixed.VERB}' THEN CASE WHEN joined LIKE '%Ichidan%' THEN '一段' WHEN joined LIKE '%Godan%' THEN '五段'
       WHEN joined LIKE '%suru verb%' THEN 'サ変' ELSE '{fixed.VERB}' END END AS conjugation,
    CASE WHEN level IS NULL THEN 'no_abc_evidence' WHEN len(pos) = 0 THEN 'all_senses_excluded'
      WHEN sense_1 AND c1 = 'j' THEN 'specialized_field' WHEN major IS NULL THEN 'out_of_requested_pos'
      WHEN evidence_level IS NULL AND freq_level IS NOT NULL AND NOT (
        (major = '{fixed.VERB}' AND freq_pos LIKE '%動詞%') OR (major = '{fixed.I_ADJ}' AND freq_pos LIKE '%形容詞%')
        OR (major IN ('{fixed.NA_ADJ}', '{fixed.NOUN}') AND freq_pos LIKE '%名詞%')) THEN 'bccwj_pos_mismatch'
      WHEN joined LIKE '%counter%' AND major = '{fixed.NOUN}' THEN 'counter' END AS reject_reason
  FROM classed),
lexicon AS (
  SELECT *, {sql_cluster('headword', 'reading', 'major', 'conjugation')} AS cluster FROM entries)"""


def kanji_facts(spark, sf) -> DataFrame:
    """Character facts from the first letters of the vocabulary."""
    v = vocabulary(spark, sf).where(F.col("w").rlike("^[a-z]")).select(F.left("w", F.lit(1)).alias("c"), "n")
    g = v.groupBy("c").agg(F.sum("n").alias("total"), F.count("*").alias("words"))
    return g.select(
        F.translate("c", LETTERS, KANJI).alias("kanji"),
        F.when(F.col("total") % 2 == 0, fixed.JOYO_LABEL).otherwise("").alias("status"),
        F.when(F.col("words") % 3 != 0, kata("c")).otherwise("").alias("on_readings"),
        F.when(F.col("words") % 2 == 0, F.concat(hira("c"), F.lit("."), hira("c"))).otherwise("").alias("kun_readings"),
    ).where(F.col("kanji") != "学")


SQL_KANJI_FACTS = f""",
facts AS (
  SELECT {_M('c', KANJI)} AS kanji, CASE WHEN total % 2 = 0 THEN '{fixed.JOYO_LABEL}' ELSE '' END AS status,
    CASE WHEN words % 3 <> 0 THEN {_M('c', KATA)} ELSE '' END AS on_readings,
    CASE WHEN words % 2 = 0 THEN {_M('c', HIRA)} || '.' || {_M('c', HIRA)} ELSE '' END AS kun_readings
  FROM (SELECT left(w, 1) AS c, sum(n) AS total, count(*) AS words FROM vocab WHERE regexp_matches(w, '^[a-z]') GROUP BY 1)
  WHERE {_M('c', KANJI)} <> '学')"""
