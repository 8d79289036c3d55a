"""Grading and classification rules as Column expressions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, functions as F

from lexmill import fixed
from lexmill.functions.text import any_of, as_col, has_kanji, kana_only, literal_map, non_empty, strip



def _joined(labels) -> Column:
    return F.array_join(as_col(labels), " | ")


def _contains_any(text: Column, words) -> Column:
    return text.rlike(any_of(words))


# -- grading -------------------------------------------------------------------

def nf_ranks(tags) -> Column:
    return F.transform(
        F.filter(as_col(tags), lambda t: t.rlike("^nf[0-9]+$")), lambda t: F.substr(t, F.lit(3)).cast("int")
    )


def priority_level(tags) -> Column:
    """A, B or C from priority tags; NULL when an entry has none."""
    tags = as_col(tags)
    best = F.array_min(nf_ranks(tags))
    has = lambda names: F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(F.size(tags) <= 0, F.lit(None).cast("string"))
        .when(has(fixed.PRIORITY_A_TAGS) | (F.coalesce(best, F.lit(10**6)) <= fixed.PRIORITY_A_MAX_NF), "A")
        .when(has(fixed.PRIORITY_B_TAGS) | (F.coalesce(best, F.lit(10**6)) <= fixed.PRIORITY_B_MAX_NF), "B")
        .when(F.size(tags) > 0, "C")
    )


def frequency_level(rank) -> Column:
    rank = as_col(rank)
    return (
        F.when(rank <= fixed.FREQ_A_MAX_RANK, "A")
        .when(rank <= fixed.FREQ_B_MAX_RANK, "B")
        .when(rank.isNotNull(), "C")
    )


# -- labels and senses -----------------------------------------------------------

def expand_labels(labels, table: dict[str, str] | None = None) -> Column:
    """Replace short codes by their labels; other labels stay."""
    table = fixed.POS_LABELS if table is None else table
    mapping = literal_map(table)
    stripped = F.filter(F.transform(as_col(labels), strip), lambda x: x != "")
    return F.transform(stripped, lambda x: F.coalesce(F.try_element_at(mapping, x), x))


def has_excluded_label(labels, fragments) -> Column:
    return _contains_any(F.lower(_joined(labels)), [f.lower() for f in fragments])


def usable_senses(senses, excluded=fixed.EXCLUDED_MISC) -> Column:
    """Senses without an excluded usage label and without any dialect label."""
    def labels(x):
        return F.coalesce(expand_labels(x), F.array().cast("array<string>"))

    return F.filter(
        as_col(senses),
        lambda s: ~has_excluded_label(labels(s["misc"]), excluded) & (F.size(labels(s["dial"])) == 0),
    )


def sense_labels(senses, field: str) -> Column:
    empty = F.array().cast("array<string>")
    return non_empty(F.flatten(F.transform(senses, lambda s: F.coalesce(expand_labels(s[field]), empty))))


def sense_glosses(senses, per_sense: int = 3, per_entry: int = 5) -> Column:
    """First English glosses of each sense, then the first distinct ones."""
    empty = F.array().cast("array<string>")

    def english(s):
        kept = F.filter(
            s["gloss"], lambda g: (g["text"] != "") & (g["lang"].isNull() | (g["lang"] == "eng"))
        )
        return F.coalesce(F.slice(F.transform(kept, lambda g: strip(g["text"])), 1, per_sense), empty)

    return F.slice(non_empty(F.flatten(F.transform(senses, english))), 1, per_entry)


# -- headword -----------------------------------------------------------------------

def headword_score(tags) -> Column:
    return F.aggregate(
        F.coalesce(as_col(tags), F.array().cast("array<string>")),
        F.lit(0),
        lambda total, t: total
        + F.when(t.endswith("1"), 10).when(t.endswith("2"), 5).otherwise(0)
        + F.when(t.startswith("nf"), 1).otherwise(0),
    )


def choose_headword(written, readings) -> Column:
    """Best scored writing, then the shortest, then code-point order.

    ``written`` is array<struct<text, tags>>. An entry without writings is
    headed by its first reading.
    """
    written = as_col(written)
    scored = F.transform(
        written,
        lambda w: F.struct(
            (-F.aggregate(
                F.filter(written, lambda o: o["text"] == w["text"]),
                F.lit(0),
                lambda total, o: total + headword_score(o["tags"]),
            )).alias("neg"),
            F.length(w["text"]).alias("len"),
            w["text"].alias("text"),
        ),
    )
    return F.coalesce(F.array_min(scored)["text"], F.get(as_col(readings), 0), F.lit(""))


# -- classes ------------------------------------------------------------------------

def major_class(pos) -> Column:
    joined = _joined(pos)
    return (
        F.when(_contains_any(joined, fixed.I_ADJ_LABELS), fixed.I_ADJ)
        .when(_contains_any(joined, fixed.NA_ADJ_LABELS), fixed.NA_ADJ)
        .when(joined.rlike(r"(?U)\bverb\b"), fixed.VERB)
        .when(_contains_any(joined, fixed.NOUN_LABELS), fixed.NOUN)
        .when(has_excluded_label(pos, fixed.EXCLUDED_NAME_POS), fixed.NOUN)
    )


def transitivity(pos, compat: bool = True) -> Column:
    """Transitivity of a verb from its labels.

    With ``compat`` an intransitive label also counts as transitive, because
    one label text contains the other; otherwise labels are compared whole.
    """
    joined = _joined(pos)
    if compat:
        return F.when(joined.contains("intransitive verb"), fixed.BOTH_TRANSITIVITIES).when(
            joined.contains("transitive verb"), fixed.TRANSITIVE
        )
    intransitive = F.array_contains(as_col(pos), "intransitive verb")
    transitive_ = F.array_contains(as_col(pos), "transitive verb")
    return (
        F.when(intransitive & transitive_, fixed.BOTH_TRANSITIVITIES)
        .when(intransitive, fixed.INTRANSITIVE)
        .when(transitive_, fixed.TRANSITIVE)
    )


def conjugation(pos) -> Column:
    joined = _joined(pos)
    rules = [F.when(joined.contains(label), value) for label, value in fixed.CONJUGATIONS]
    return F.coalesce(*rules, F.lit(fixed.VERB))


def frequency_pos_compatible(major, freq_pos) -> Column:
    freq_pos = F.coalesce(as_col(freq_pos), F.lit(""))
    tests = [
        (as_col(major) == name) & _contains_any(freq_pos, words)
        for name, words in fixed.FREQ_POS_BY_MAJOR.items()
    ]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


class SuffixRule(NamedTuple):
    """One ordered suffix rule: a tail looked for in the surface, the basis or either."""

    major: str
    tail: str
    label: str
    on: str


def japanese_suffix_rules() -> list[SuffixRule]:
    f = fixed
    rules = [SuffixRule(f.VERB, "する", f.SURU_CLUSTER, "either")]
    rules += [SuffixRule(f.VERB, t, f.COMPOUND_LABEL + t, "either") for t in f.COMPOUND_TAILS]
    rules += [SuffixRule(f.VERB, t, label, "basis") for t, label in f.PAIR_TAILS]
    rules += [SuffixRule(f.I_ADJ, t, f.I_ADJ_TAIL_LABEL + t, "basis") for t in f.I_ADJ_TAILS]
    rules += [SuffixRule(f.NA_ADJ, "的", f.NA_ADJ_TEKI_LABEL, "surface")]
    rules += [SuffixRule(f.NA_ADJ, t, f.NA_ADJ_TAIL_LABEL + t, "either") for t in f.NA_ADJ_TAILS]
    return rules


def first_suffix_rule(major, surface, basis, rules: list[SuffixRule]) -> Column:
    """Label of the first rule that applies, in rule order; NULL if none.

    The rules become one constant map from (class, place, tail) to rule order,
    so a row does one lookup per tail length and place instead of testing
    every rule.
    """
    places = {"basis": ["b"], "surface": ["s"], "either": ["s", "b"]}
    order: dict[str, int] = {}
    for i, rule in enumerate(rules):
        for place in places[rule.on]:
            order.setdefault(f"{rule.major}|{place}|{rule.tail}", i)
    found = literal_map(order)
    labels = literal_map(dict(enumerate(rule.label for rule in rules)))
    probes = [
        F.try_element_at(found, F.concat(as_col(major), F.lit(f"|{place}|"), F.right(text, F.lit(n))))
        for n in sorted({len(rule.tail) for rule in rules})
        for place, text in (("s", as_col(surface)), ("b", as_col(basis)))
    ]
    return F.try_element_at(labels, F.least(*probes))


def cluster(headword, reading, major, conj) -> Column:
    headword, reading, major = as_col(headword), as_col(reading), as_col(major)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    basis = F.when(blank(reading), headword).otherwise(reading)
    surface = F.when(blank(headword), reading).otherwise(headword)
    default = (
        F.when(
            major == fixed.VERB,
            F.concat(F.lit(fixed.CONJUGATION_LABEL), F.coalesce(as_col(conj), F.lit(fixed.VERB))),
        )
        .when(major == fixed.I_ADJ, fixed.I_ADJ_DEFAULT)
        .when(major == fixed.NA_ADJ, fixed.NA_ADJ_DEFAULT)
        .when((major == fixed.NOUN) & kana_only(surface), fixed.KANA_NOUN)
        .when((major == fixed.NOUN) & has_kanji(surface), fixed.KANJI_NOUN)
        .when(major == fixed.NOUN, fixed.OTHER_NOUN)
    )
    return F.coalesce(first_suffix_rule(major, surface, basis, japanese_suffix_rules()), default)


def reject_reason(pos, fields, major, evidence_level, freq_level, level, freq_pos) -> Column:
    """First reason an entry is turned down; NULL for an accepted entry."""
    rank_only = as_col(evidence_level).isNull() & as_col(freq_level).isNotNull()
    return (
        F.when(as_col(level).isNull(), "no_abc_evidence")
        .when(F.size(as_col(pos)) == 0, "all_senses_excluded")
        .when(has_excluded_label(fields, fixed.EXCLUDED_FIELDS), "specialized_field")
        .when(as_col(major).isNull(), "out_of_requested_pos")
        .when(rank_only & ~frequency_pos_compatible(major, freq_pos), "bccwj_pos_mismatch")
        .when(F.lower(_joined(pos)).contains("counter") & (as_col(major) == fixed.NOUN), "counter")
    )


def joyo_label(grade) -> Column:
    return F.when(as_col(grade).isin(fixed.JOYO_GRADES), fixed.JOYO_LABEL).otherwise("")


# -- example terms --------------------------------------------------------------------

def is_candidate_term(c) -> Column:
    term = strip(c)
    kana_length = F.length(F.replace(term, F.lit("ー"), F.lit("")))
    return (
        ~term.isin(fixed.DENIED_TERMS)
        & term.rlike(f"[{fixed.KANA}{fixed.CJK}]")
        & ~term.rlike("[A-Za-z]")
        & F.when(kana_only(term), kana_length >= 3).otherwise(F.length(term) >= 2)
    )


def _with_suffixes(stem: Column, suffixes) -> Column:
    return F.array(*[F.concat(stem, F.lit(s)) for s in suffixes])


def surface_forms(word, major, pos) -> Column:
    """Inflected forms of a headword that may stand in a sentence.

    A verb in ``る`` that is not labelled ichidan inflects as godan, and the
    past stem always takes unvoiced endings.
    """
    word, major = as_col(word), as_col(major)
    labels = F.lower(F.array_join(as_col(pos), fixed.LIST_SEPARATOR))
    stem = F.substring(word, F.lit(1), F.length(word) - 1)
    last = F.right(word, F.lit(1))
    ichidan = word.endswith("る") & (labels.contains("ichidan") | labels.contains("一段"))
    continuative = F.concat(
        stem, F.translate(last, "".join(fixed.GODAN_CONTINUATIVE), "".join(fixed.GODAN_CONTINUATIVE.values()))
    )
    past = F.concat(stem, F.translate(last, "".join(fixed.GODAN_PAST_STEM), "".join(fixed.GODAN_PAST_STEM.values())))
    godan = F.concat(
        _with_suffixes(continuative, fixed.GODAN_CONTINUATIVE_SUFFIXES),
        _with_suffixes(past, fixed.GODAN_PAST_SUFFIXES),
    )
    long_enough = F.length(word) >= 3
    return (
        F.when((major == fixed.VERB) & long_enough & ichidan, _with_suffixes(stem, fixed.ICHIDAN_SUFFIXES))
        .when((major == fixed.VERB) & long_enough & last.isin(list(fixed.GODAN_CONTINUATIVE)), godan)
        .when(
            (major == fixed.I_ADJ) & long_enough & word.endswith("い"), _with_suffixes(stem, fixed.I_ADJ_SUFFIXES)
        )
        .otherwise(F.array().cast("array<string>"))
    )


def example_terms(word, writings, major, pos) -> Column:
    terms = F.concat(F.array(as_col(word)), as_col(writings), surface_forms(word, major, pos))
    return F.filter(F.array_distinct(F.transform(terms, strip)), is_candidate_term)


def eligible_sentence(c, script=f"[{fixed.KANA}{fixed.CJK}]", lengths=fixed.SENTENCE_LENGTHS) -> Column:
    text = strip(c)
    return F.length(text).between(*lengths) & text.rlike(script)


def eligible_translation(c, script=f"[{fixed.CJK}]", lengths=fixed.TRANSLATION_LENGTHS) -> Column:
    text = strip(c)
    return F.length(text).between(*lengths) & text.rlike(script)


# -- search classes ---------------------------------------------------------------------

def _label_test(labels: Column, how: str, values) -> Column:
    values = [v.lower() for v in values]
    if how == "contains":
        return F.exists(labels, lambda x: x.rlike(any_of(values)))
    if how == "equals":
        return F.exists(labels, lambda x: x.isin(values))
    return F.exists(labels, lambda x: reduce(lambda a, b: a | b, [x.startswith(v) for v in values]))


def part_groups(labels, major, transitivity_, freq_pos) -> Column:
    """All part groups of an entry; ``labels`` are already in search form."""
    labels, major = as_col(labels), as_col(major)
    tests: dict[str, Column] = {}
    for group, how, values in fixed.PART_GROUPS:
        if how == "major":
            test = major.isin(values)
        elif how == "transitivity":
            test = as_col(transitivity_).isin(values)
        elif how == "freq_pos":
            test = _contains_any(F.coalesce(as_col(freq_pos), F.lit("")), values)
        else:
            test = _label_test(labels, how, values)
        test = F.coalesce(test, F.lit(False))
        tests[group] = tests[group] | test if group in tests else test
    found = F.array(*[F.when(test, F.lit(group)) for group, test in tests.items()])
    return F.filter(found, lambda g: g.isNotNull())


def matches_transitivity(labels, stored, wanted: str) -> Column:
    labels, stored = as_col(labels), as_col(stored)
    has = lambda name: F.exists(labels, lambda x: x == name)
    if wanted == fixed.INTRANSITIVE:
        test = has("intransitive verb") | (stored == wanted)
    elif wanted == fixed.TRANSITIVE:
        test = has("transitive verb") | (stored == wanted)
    elif wanted == fixed.BOTH_TRANSITIVITIES:
        test = (stored == wanted) | (has("transitive verb") & has("intransitive verb"))
    else:
        test = stored == wanted
    return F.coalesce(test, F.lit(False))


def translation_source(confidence, needs_repair, threshold: float = fixed.CONFIDENCE_THRESHOLD) -> Column:
    return F.when(as_col(needs_repair) | (as_col(confidence) < threshold), fixed.REPAIR_SOURCE).otherwise(
        fixed.DICTIONARY_SOURCE
    )


def has_source_prefix(source, prefixes) -> Column:
    if not prefixes:
        return F.lit(False)
    return F.coalesce(strip(source).rlike(f"^({any_of(prefixes)})"), F.lit(False))
