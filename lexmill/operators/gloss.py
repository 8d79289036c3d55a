"""Gloss translation as joins over the distinct gloss table.

Dictionaries are tables ``(kind, major, key, value)`` with kind one of
``context``, ``exact``, ``phrase``, ``word``, plus the reverse index built from a
bilingual dictionary. Every distinct (gloss, class) is translated once and
joined back to the entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill import fixed
from lexmill.functions import text as tx
from lexmill.functions.classify import translation_source
from lexmill.operators.common import cut_lineage, find_terms, first_n, ordered_list

RESULT = "struct<text:string,confidence:double,method:string,needs_repair:boolean>"


# -- reverse index -----------------------------------------------------------------

def definition_keys(bilingual: DataFrame) -> DataFrame:
    """(key, simplified, ord): lookup keys cut from the definitions."""
    words = bilingual.where(
        (F.length("simplified") <= fixed.REVERSE_MAX_WORD_CHARS) & tx.useful_candidate("simplified")
    )
    definitions = words.select(
        "simplified", "line_ord", F.posexplode(F.split("definitions", "/")).alias("def_ord", "definition")
    ).withColumn("definition", tx.strip("definition"))
    kept = definitions.where(
        (F.col("definition") != "") & ~F.col("definition").rlike("(?i)" + fixed.REVERSE_SKIPPED_DEFINITIONS)
    )
    chunks = kept.select(
        "simplified", "line_ord", "def_ord",
        F.posexplode(F.split("definition", fixed.REVERSE_CHUNK_SPLIT)).alias("chunk_ord", "chunk"),
    ).withColumn("key", tx.definition_key("chunk"))
    usable = chunks.where(
        (F.col("key") != "") & ~tx.has_kanji("key") & (F.size(F.split("key", " ")) <= fixed.REVERSE_MAX_KEY_WORDS)
    )
    bare = F.when(F.col("key").startswith("to "), F.substr("key", F.lit(4)))
    both = F.filter(F.array("key", bare), lambda k: k.isNotNull())
    return usable.select(
        F.posexplode(both).alias("form_ord", "key"), "simplified", "line_ord", "def_ord", "chunk_ord"
    ).select("key", "simplified", F.struct("line_ord", "def_ord", "chunk_ord", "form_ord").alias("ord"))


def reverse_index(bilingual: DataFrame, per_key: int = fixed.REVERSE_MAX_CANDIDATES) -> DataFrame:
    """(key, candidates): first five distinct words per key in file order.

    Repeats fold first and each task keeps five per key, so a key with very
    many words is never gathered.
    """
    distinct = definition_keys(bilingual).groupBy("key", "simplified").agg(F.min("ord").alias("ord"))
    top = first_n(distinct, ["key"], ["ord"], per_key)
    return top.groupBy("key").agg(ordered_list(F.col("ord"), F.col("simplified")).alias("candidates"))


# -- template chains ------------------------------------------------------------------

def _inner(key: Column) -> Column:
    """struct(template, inner) for the first template a key fits, else NULL.

    Every template is a beginning followed by at least one character.
    """
    specs = [*fixed.TEMPLATES, fixed.TO_TEMPLATE]
    chain = None
    for i, (pattern, *_rest) in enumerate(specs):
        start = pattern[1 : pattern.index("(")]
        value = F.struct(F.lit(i).alias("template"), F.substr(key, F.lit(len(start) + 1)).alias("inner"))
        fits = key.startswith(start) & (F.length(key) > len(start))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain


def template_chain(key: Column) -> Column:
    """All inner texts a key can lead to, outermost first.

    Every template takes at least one word away, so the number of words bounds
    the chain and no round limit is needed.
    """
    words = F.size(F.split(key, " "))
    step_type = "array<struct<template:int,inner:string>>"
    start = F.array().cast(step_type)

    def extend(done, _):
        last = F.when(F.size(done) == 0, key).otherwise(F.element_at(done, F.lit(-1))["inner"])
        return F.concat(done, F.filter(F.array(_inner(last)), lambda step: step.isNotNull())).cast(step_type)

    # a key can only lead on if it starts like one of the templates
    return F.when(_inner(key).isNull(), start).otherwise(
        F.aggregate(F.sequence(F.lit(1), words), start, extend)
    )


# -- lookups ---------------------------------------------------------------------------



def direct_translations(glosses: DataFrame, tables: DataFrame, reverse: DataFrame | None = None) -> DataFrame:
    """(gloss, major) -> best dictionary hit: text, confidence, method.

    One exploded probe per lookup key and priority, one join per table, the
    lowest priority wins. Class-specific and general entries are the same
    join, as the general ones carry an empty class.
    """
    key = tx.gloss_key("gloss")
    bare = tx.gloss_key(tx.strip_parentheses("gloss"))
    none = F.lit("")
    probe = lambda p, conf, method, major, k: F.struct(
        F.lit(p).alias("priority"), F.lit(conf).alias("confidence"), F.lit(method).alias("method"),
        major.alias("m"), k.alias("key"),
    )
    probes = F.array(
        F.when(F.col("major") != "", probe(1, 0.98, "context-exact", F.col("major"), key)),
        probe(2, 0.98, "exact", none, key),
        F.when(F.col("major") != "", probe(3, 0.94, "context-exact-no-parenthetical", F.col("major"), bare)),
        probe(4, 0.94, "exact-no-parenthetical", none, bare),
        F.when(key.startswith("to "), probe(5, 0.90, "exact-verb-core", none, F.substr(key, F.lit(4)))),
    )
    exploded = glosses.select(
        "gloss", "major", F.explode(F.filter(probes, lambda x: x.isNotNull())).alias("p")
    ).select("gloss", "major", "p.*")
    known = tables.where(F.col("kind").isin("context", "exact")).groupBy(F.col("major").alias("m"), "key").agg(
        F.min("value").alias("value")
    )
    hits = exploded.join(known, ["m", "key"]).select(
        "gloss", "major", "priority", F.col("value").alias("text"), "confidence", "method"
    )
    if reverse is not None:
        hits = hits.unionByName(reverse_lookups(glosses, reverse))
    best = hits.groupBy("gloss", "major").agg(
        F.min_by(F.struct("text", "confidence", "method"), "priority").alias("d")
    )
    return best.select("gloss", "major", "d.*")


def reverse_lookups(glosses: DataFrame, reverse: DataFrame) -> DataFrame:
    """Reverse-index hits: at most six keys per gloss, first three useful words."""
    keys = tx.non_empty(
        F.array(tx.gloss_key("gloss"), tx.gloss_key(tx.strip_parentheses("gloss")), tx.definition_key("gloss"))
    )
    both = F.flatten(
        F.transform(keys, lambda k: F.when(k.startswith("to "), F.array(k, F.substr(k, F.lit(4)))).otherwise(F.array(k)))
    )
    probes = glosses.select("gloss", F.posexplode(F.array_distinct(both)).alias("ord", "key")).distinct()
    found = probes.join(reverse, "key").groupBy("gloss").agg(
        F.flatten(ordered_list(F.col("ord"), F.col("candidates"))).alias("c")
    )
    useful = F.slice(F.filter(F.array_distinct("c"), tx.useful_candidate), 1, 3)
    rows = found.select("gloss", useful.alias("c")).where(F.size("c") > 0)
    return rows.join(glosses.select("gloss", "major"), "gloss").select(
        "gloss", "major", F.lit(6).alias("priority"),
        F.array_join(F.slice("c", 1, 2), "；").alias("text"),
        F.when(F.size("c") <= 2, 0.68).otherwise(0.62).alias("confidence"),
        F.lit("cc-cedict").alias("method"),
    )


def rough_translations(glosses: DataFrame, tables: DataFrame) -> DataFrame:
    """gloss -> text after phrase and word replacement.

    Phrases that occur are found by the substring join and applied longest
    first; words then meet the word table by token. Both lists are bounded by
    the length of the gloss.
    """
    distinct = glosses.select("gloss").distinct()
    phrases = tables.where(F.col("kind") == "phrase").groupBy(F.lower("key").alias("term")).agg(F.min("value").alias("value"))
    lowered = distinct.select("gloss", F.lower("gloss").alias("lowered"))
    found = find_terms(lowered, ["gloss"], "lowered", phrases).groupBy("gloss").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.length("term")).alias("n"), "term", "value"))
        ).alias("phrases")
    )
    words = tables.where(F.col("kind") == "word").groupBy(F.lower("key").alias("token")).agg(F.min("value").alias("value"))
    token = "[A-Za-z]+(?:'[A-Za-z]+)?"
    tokens = distinct.select(
        "gloss", F.explode(F.array_distinct(F.transform(
            F.regexp_extract_all("gloss", F.lit(token), F.lit(0)), F.lower))).alias("token")
    )
    meanings = tokens.join(words, "token").groupBy("gloss").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("words")
    )
    joined = distinct.join(found, "gloss", "left").join(meanings, "gloss", "left")
    empty_phrases = F.array().cast("array<struct<n:int,term:string,value:string>>")
    replaced = F.aggregate(
        F.coalesce("phrases", empty_phrases),
        F.col("gloss"),
        lambda text, p: F.regexp_replace(
            text,
            F.concat(F.lit("(?i)(?<![A-Za-z])"), tx.quoted(p["term"]), F.lit("(?![A-Za-z])")),
            tx.quoted_replacement(p["value"]),
        ),
    )
    pieces = F.regexp_extract_all(replaced, F.lit(f"(?s){token}|."), F.lit(0))
    swapped = F.array_join(
        F.transform(pieces, lambda t: F.coalesce(F.try_element_at(F.col("words"), F.lower(t)), t)), ""
    )
    return joined.select("gloss", tx.cleanup_machine_text(swapped).alias("rough"))


# -- results -----------------------------------------------------------------------------

def _result(text, confidence, method, needs_repair) -> Column:
    return F.struct(
        text.alias("text"),
        confidence.cast("double").alias("confidence"),
        method.alias("method"),
        needs_repair.alias("needs_repair"),
    )


def _finish(text: Column, major: Column) -> Column:
    clean = F.replace(tx.cleanup_machine_text(text), F.lit("；；"), F.lit("；"))
    return tx.adjust_for_pos(tx.strip_chars(clean, "；、 "), major)


def _fallback(gloss: Column, rough: Column, major: Column) -> Column:
    """Result without dictionary hit or template."""
    remaining = F.size(tx.latin_tokens(rough))
    placeholder, yes, no = F.lit(fixed.UNTRANSLATED), F.lit(True), F.lit(False)
    proper = gloss.rlike(r"^\p{Lu}") & (F.size(F.split(tx.collapse(gloss), " ")) <= 4)
    return (
        F.when(tx.has_kanji(rough) & (remaining == 0), _result(_finish(rough, major), F.lit(0.72), F.lit("phrase-word"), no))
        .when(tx.has_kanji(rough) & (remaining <= 1), _result(placeholder, F.lit(0.30), F.lit("phrase-word-partial"), yes))
        .when(tx.has_kanji(rough), _result(placeholder, F.lit(0.20), F.lit("phrase-word-low"), yes))
        .when(proper, _result(F.concat(F.lit(fixed.PROPER_PREFIX), gloss), F.lit(0.40), F.lit("proper-original"), yes))
        .otherwise(_result(placeholder, F.lit(0.10), F.lit("untranslated"), yes))
    )


def translate_glosses(glosses: DataFrame, tables: DataFrame, reverse: DataFrame | None = None) -> DataFrame:
    """(gloss, major) -> text, confidence, method, needs_repair.

    Dictionaries come first; only a text they do not answer follows its
    templates. The inner texts of all chains are looked up together and each
    chain is folded from the inside out in place. Phrase and word replacement,
    the dear step, runs on the texts that no dictionary answers.
    """
    asked = glosses.select(tx.strip("gloss").alias("gloss"), F.coalesce("major", F.lit("")).alias("major"))
    asked = asked.where(F.col("gloss") != "").distinct()
    asked = cut_lineage(asked)
    found = _answered(asked, direct_translations(asked, tables, reverse)).withColumn("key", tx.gloss_key("gloss"))
    no_chain = F.array().cast("array<struct<template:int,inner:string>>")
    # the key and the chain are dear and read several times; stored, they are made once
    chained = cut_lineage(found.withColumn("chain", F.when(F.col("direct").isNull(), template_chain(F.col("key"))).otherwise(no_chain)).drop("key"))
    found = chained.drop("chain")
    inner = chained.where("direct is null").select(F.explode(F.transform("chain", lambda c: c["inner"])).alias("gloss"), F.lit("").alias("major")).distinct()
    inner = cut_lineage(inner)
    known = _answered(inner, direct_translations(inner, tables, reverse))
    texts = cut_lineage(found.withColumn("outer", F.lit(True)).unionByName(known.withColumn("outer", F.lit(False))))
    rough = rough_translations(texts.where("direct is null"), tables)
    solved = texts.join(rough, "gloss", "left").select(
        F.col("gloss").alias("text"), F.col("major").alias("class"), "outer", "direct",
        F.when(F.col("direct").isNull(), _fallback(F.col("gloss"), F.coalesce("rough", "gloss"), F.col("major"))).alias("fallback"),
    )
    # every chain meets these rows again; stored, they are solved only once
    solved = cut_lineage(solved)
    own = chained.drop("direct").join(solved.where("outer").drop("outer").withColumnsRenamed({"text": "gloss", "class": "major"}), ["gloss", "major"])
    settled = (F.size("chain") == 0) | F.col("direct").isNotNull()
    done = own.where(settled).select("gloss", "major", F.coalesce("direct", "fallback").alias("r"))
    # only a text that fits a template and is in no dictionary follows its chain
    open_steps = own.where(~settled).select(
        "gloss", "major", "fallback", "chain",
        F.posexplode(F.transform("chain", lambda c: c["inner"])).alias("depth", "text"),
    )
    inner_results = solved.where("not outer").select(
        "text", F.col("direct").alias("inner_direct"), F.col("fallback").alias("inner_fallback")
    )
    folded = open_steps.join(inner_results, "text").groupBy("gloss", "major").agg(
        F.first("chain").alias("chain"), F.first("fallback").alias("fallback"),
        F.reverse(
            F.array_sort(F.collect_list(F.struct("depth", F.col("inner_direct").alias("direct"), F.col("inner_fallback").alias("fallback"))))
        ).alias("inside"),
    )
    # innermost text first; the template that led to step d takes the text of d to d - 1
    steps = F.transform(
        "inside",
        lambda x: F.struct(
            F.get(F.col("chain"), x["depth"] + 1)["template"].alias("template"), F.lit("").alias("class"),
            x["direct"].alias("direct"), x["fallback"].alias("fallback"),
        ),
    )
    outermost = F.array(
        F.struct(
            F.get("chain", F.lit(0))["template"].alias("template"), F.col("major").alias("class"),
            F.lit(None).cast(RESULT).alias("direct"), F.col("fallback").alias("fallback"),
        )
    )
    followed = folded.select(
        "gloss", "major",
        F.aggregate(F.concat(steps, outermost), F.lit(None).cast(RESULT), _fold_step).alias("r"),
    )
    return done.unionByName(followed).select("gloss", "major", "r.*")


def _answered(texts: DataFrame, direct: DataFrame) -> DataFrame:
    """(gloss, major, direct): each text with its dictionary result or NULL."""
    result = _result(_finish(F.col("text"), F.col("major")), F.col("confidence"), F.col("method"), F.lit(False))
    return texts.join(direct, ["gloss", "major"], "left").select("gloss", "major", F.when(F.col("method").isNotNull(), result).alias("direct"))


def _fold_step(inner: Column, step: Column) -> Column:
    specs = [*fixed.TEMPLATES, fixed.TO_TEMPLATE]
    last = len(specs) - 1
    number = step["template"]
    table = lambda field: F.element_at(F.array(*[F.lit(s[field]) for s in specs]), F.coalesce(number, F.lit(0)) + 1)
    needed = F.when(number == last, fixed.TO_MIN_INNER).otherwise(fixed.TEMPLATE_MIN_INNER)
    fits = number.isNotNull() & inner.isNotNull() & (inner["confidence"] >= needed) & tx.has_kanji(inner["text"])
    templated = _result(
        _finish(F.concat(table(1), inner["text"], table(2)), step["class"]),
        F.least(table(3), inner["confidence"]),
        table(4),
        inner["needs_repair"],
    )
    return (
        F.when(step["direct"].isNotNull(), step["direct"]).when(fits, templated).otherwise(step["fallback"]).cast(RESULT)
    )


def entry_translations(entries: DataFrame, translated: DataFrame, limit: int = fixed.MAX_TRANSLATIONS,
                       threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Per entry: first distinct texts, lowest confidence, methods, source label."""
    rows = entries.select(
        "entry_id", F.coalesce("major", F.lit("")).alias("major"), F.posexplode("glosses").alias("ord", "gloss")
    ).withColumn("gloss", tx.strip("gloss"))
    found = rows.join(translated, ["gloss", "major"]).withColumn("text", F.replace("text", F.lit("；"), F.lit("、")))
    found = found.where(F.col("text") != "")
    once = found.groupBy("entry_id", "text").agg(
        F.min(F.struct("ord", "confidence", "method", "needs_repair")).alias("m")
    ).select("entry_id", "text", "m.*")
    kept = first_n(once, ["entry_id"], ["ord"], limit)
    out = kept.groupBy("entry_id").agg(
        ordered_list(F.col("ord"), F.col("text")).alias("texts"),
        ordered_list(F.col("ord"), F.col("method")).alias("methods"),
        F.min("confidence").alias("confidence"),
        F.bool_or("needs_repair").alias("needs_repair"),
    )
    return out.select(
        "entry_id", F.array_join("texts", "；").alias("translation"),
        translation_source("confidence", "needs_repair", threshold).alias("translation_source"),
        "confidence", "needs_repair", "methods",
    )


def translation_outcomes(entries: DataFrame, translations: DataFrame, levels: list[str] | None = None,
                         preserve_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """entry_id -> preserved / queued / translated / skipped."""
    from lexmill.functions.classify import has_source_prefix

    chosen = F.col("level").isin(levels) if levels else F.lit(True)
    source = F.col("old_source")
    joined = entries.select(
        "entry_id", "level",
        (F.col("translation_source") if "translation_source" in entries.columns else F.lit(None).cast("string")).alias("old_source"),
    ).join(translations.select("entry_id", "translation_source"), "entry_id", "left")
    return joined.select(
        "entry_id",
        F.when(~chosen, "skipped")
        .when(has_source_prefix(source, preserve_prefixes), "preserved")
        .when(F.col("translation_source").isNull(), "skipped")
        .when(F.col("translation_source") == fixed.REPAIR_SOURCE, "queued")
        .otherwise("translated").alias("outcome"),
    )


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """One row of the published counters: queued rows are translated ones too."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(
        n("translated", "queued").alias("translated_overrides"), n("preserved").alias("preserved_existing"),
        n("queued").alias("queued_for_llm"), n("skipped").alias("skipped"),
    )


def repair_queue(entries: DataFrame, translations: DataFrame, instruction: str = "") -> DataFrame:
    """Rows below the confidence threshold, in the queue's published shape; the caller words the instruction."""
    low = translations.where(F.col("translation_source") == fixed.REPAIR_SOURCE)
    return entries.drop("translation", "translation_source").join(low, "entry_id").select(
        F.col("entry_id").alias("id"), "level", F.col("headword").alias("word"), "reading", "major",
        F.array_join("pos", fixed.LIST_SEPARATOR).alias("subpos"), "glosses",
        F.col("translation").alias("draft_translation"),
        F.round("confidence", 2).alias("min_confidence"), "methods",
        F.lit(instruction).alias("instruction"),
    )
