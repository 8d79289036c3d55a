"""Column functions against worked examples."""

from pyspark.sql import functions as F

from lexmill import fixed
from lexmill.functions import classify as cl
from lexmill.functions import romaji as ro
from lexmill.functions import text as tx


def one(spark, expr, schema, *values):
    return spark.createDataFrame([values], schema).select(expr.alias("r")).first()["r"]


def col(spark, fn, value, type_="string"):
    return one(spark, fn(F.col("x")), f"x {type_}", value)


def test_normalisation(spark):
    assert col(spark, tx.to_hiragana, "カタカナー") == "かたかなー"
    assert col(spark, tx.normalize_japanese, " ｱ Ｂ ") == "あB"
    assert col(spark, tx.normalize_search, "ＡガッコウZ") == "aがっこうz"
    assert col(spark, tx.collapse, "  a 　 b\n") == "a b"
    assert col(spark, tx.kanji_reading_key, "まな.ぶ - ") == "まなぶ"
    assert col(spark, tx.maybe_int, "12.7") == 12
    assert col(spark, tx.maybe_int, "x") is None
    assert col(spark, tx.maybe_float, " 1.5 ") == 1.5


def test_lists(spark):
    assert col(spark, tx.split_list, " a ； ；b") == ["a", "b"]
    assert col(spark, lambda c: tx.split_list(c, True), "a; b；c") == ["a", "b", "c"]
    assert col(spark, tx.split_readings, "ガク、まな,ガク") == ["ガク", "まな"]
    assert col(spark, tx.kanji_characters, "学校の学生") == ["学", "校", "生"]
    assert col(spark, tx.kanji_runs, "学校の学生") == ["学校", "学生"]
    assert col(spark, tx.non_empty, ["a", "", None, "b", "a"], "array<string>") == ["a", "b"]
    assert col(spark, tx.display_list, [], "array<string>") == "-"
    assert col(spark, tx.display_list, ["a", "b"], "array<string>") == "a；b"
    assert one(spark, tx.first_definition("t", "g"), "t array<string>, g array<string>", [""], ["x"]) == "x"
    assert one(spark, tx.first_definition("t", "g"), "t array<string>, g array<string>", [], []) == fixed.NO_DEFINITION


def test_romaji(spark):
    def roma(v):
        return col(spark, ro.kana_to_romaji, v)

    assert roma("がっこう") == "gakkou"
    assert roma("ちーむ") == "chiimu"
    assert roma("まっちゃ") == "maccha"
    assert roma("あっ") == "a"
    assert roma("っa") == "a"
    assert roma("らーーx") == "raaax"
    assert roma("しゃゔぁ") == "shava"
    assert col(spark, ro.romaji_variants, "gakkou") == ["gakkou", "gakko"]
    assert col(spark, ro.romaji_variants, "chiimu") == ["chiimu", "tiimu"]
    assert col(spark, ro.romaji_variants, "!!") == []


def test_level_list_forms(spark):
    assert col(spark, tx.writing_variants, "お・茶") == ["お茶", "茶"]
    assert col(spark, tx.writing_variants, "ご・飯/めし  米") == ["ご飯", "飯", "めし", "米"]
    def reading(a, w):
        return one(spark, tx.reading_variants("a", "w"), "a string, w string", a, w)
    assert reading("ちゃ（x）", "茶") == ["ちゃ"]
    assert reading("", "かな") == ["かな"]
    assert reading("abc", "茶") == []
    assert reading("あ、い/う", "茶") == ["あ", "い", "う"]


def test_gloss_keys(spark):
    assert col(spark, tx.gloss_key, "  To  Go ") == "to go"
    assert col(spark, tx.strip_parentheses, "school (building)") == "school"
    assert col(spark, tx.definition_key, "fig. to ask sb for sth; ") == "to ask somebody for something"
    assert col(spark, tx.definition_key, "horse CL:匹[pi3]") == "horse"
    assert col(spark, tx.useful_candidate, "学校") is True
    assert col(spark, tx.useful_candidate, "学") is False
    assert col(spark, tx.useful_candidate, "模拟") is False
    assert col(spark, tx.translation_items, ["1. 学校；学园", "n/a", "学校"], "array<string>") == ["学校", "学园"]
    assert col(spark, tx.compact_translation, " 学校；\n学园。") == "学校、 学园"
    assert col(spark, tx.compact_translation, " ; ") == fixed.UNTRANSLATED
    assert col(spark, tx.latin_tokens, "e.g. foo 学 bar's") == ["foo", "bar's"]
    assert one(spark, tx.adjust_for_pos("t", "m"), "t string, m string", "好；美的、红", fixed.I_ADJ) == "好的；美的、红的"
    assert one(spark, tx.adjust_for_pos("t", "m"), "t string, m string", "好", fixed.NOUN) == "好"


def test_levels(spark):
    def level(tags):
        return col(spark, cl.priority_level, tags, "array<string>")

    assert [level(t) for t in (["ichi1"], ["nf09"], ["nf24"], ["news2", "nf40"], ["nf45"], [])] == ["A", "A", "B", "B", "C", None]
    assert [col(spark, cl.frequency_level, r, "int") for r in (5000, 5001, 30000, 30001, None)] == ["A", "B", "B", "C", None]


def test_classes(spark):
    def major(pos):
        return col(spark, cl.major_class, pos, "array<string>")

    assert major(["noun or participle which takes the aux. verb suru"]) == fixed.VERB
    assert major(["adverb"]) is None
    assert major(["adjective (keiyoushi)", "noun"]) == fixed.I_ADJ
    assert major(["surname"]) == fixed.NOUN
    assert col(spark, cl.transitivity, ["intransitive verb"], "array<string>") == fixed.BOTH_TRANSITIVITIES
    assert col(spark, lambda c: cl.transitivity(c, False), ["intransitive verb"], "array<string>") == fixed.INTRANSITIVE
    assert col(spark, cl.transitivity, ["transitive verb"], "array<string>") == fixed.TRANSITIVE
    assert col(spark, cl.conjugation, ["Godan verb"], "array<string>") == "五段"
    assert col(spark, cl.conjugation, ["verb"], "array<string>") == fixed.VERB


def test_clusters(spark):
    def cluster(h, r, m, c=None):
        return one(spark, cl.cluster("h", "r", "m", "c"), "h string, r string, m string, c string", h, r, m, c)

    assert cluster("食べ始める", "たべはじめる", fixed.VERB) == "复合动词后项：-始める"
    assert cluster("増やす", "ふやす", fixed.VERB) == "自他形态：-れる/-る / -す"
    assert cluster("静か", "しずか", fixed.NA_ADJ) == "ナ形容词后缀：-か"
    assert cluster("楽しい", "たのしい", fixed.I_ADJ) == "い形容词后缀：-しい"
    assert cluster("知的", "ちてき", fixed.NA_ADJ) == fixed.NA_ADJ_TEKI_LABEL
    assert cluster("来る", "くる", fixed.VERB, "カ変") == "活用类：カ変"
    assert cluster("学校", "がっこう", fixed.NOUN) == fixed.KANJI_NOUN
    assert cluster("", "かな", fixed.NOUN) == fixed.KANA_NOUN
    assert cluster("ABC", "エー", fixed.NOUN) == fixed.OTHER_NOUN


def test_headword(spark):
    schema = "w array<struct<text:string,tags:array<string>>>, r array<string>"
    def head(w, r=("よみ",)):
        return one(spark, cl.choose_headword("w", F.col("r")), schema, w, list(r))

    assert head([("逢う", []), ("会う", ["ichi1", "nf05"])]) == "会う"
    assert head([("苹果", []), ("林檎", [])]) == "林檎"
    assert head([("長い語", ["nf01"]), ("語", ["news2"])]) == "長い語"
    assert head([]) == "よみ"


def test_senses(spark):
    schema = (
        "s array<struct<pos:array<string>,misc:array<string>,dial:array<string>,field:array<string>,"
        "gloss:array<struct<text:string,lang:string>>>>"
    )
    senses = [
        (["n"], ["archaism"], [], [], [("old", None)]),
        (["v1", "vt"], [], [], ["computing"], [("a", None), ("b", "eng"), ("Schule", "ger"), ("c", None), ("d", None)]),
        (["n"], [], ["Kansai"], [], [("x", None)]),
    ]
    kept = cl.usable_senses(F.col("s"))
    assert one(spark, cl.sense_labels(kept, "pos"), schema, senses) == ["Ichidan verb", "transitive verb"]
    assert one(spark, cl.sense_glosses(kept), schema, senses) == ["a", "b", "c"]


def test_terms(spark):
    flags = [col(spark, cl.is_candidate_term, t) for t in ("する", "アメ", "アメリカ", "学", "学校", "Tシャツ")]
    assert flags == [False, False, True, False, True, False]

    def forms(word, major, pos):
        return one(spark, cl.example_terms("w", F.array("w"), "m", "p"), "w string, m string, p array<string>", word, major, pos)

    assert forms("食べる", fixed.VERB, ["Ichidan verb"]) == [
        "食べる", "食べ", "食べた", "食べて", "食べます", "食べない", "食べよう", "食べられる", "食べさせる"]
    godan = forms("楽しむ", fixed.VERB, ["Godan verb"])
    assert "楽しみます" in godan and "楽しんた" in godan and "楽しんだ" not in godan
    assert "楽しかった" in forms("楽しい", fixed.I_ADJ, [])


def test_part_groups(spark):
    def groups(labels, major="", trans="", freq=""):
        return one(spark, cl.part_groups("l", "m", "t", "f"), "l array<string>, m string, t string, f string", labels, major, trans, freq)

    assert groups(["noun (common)"]) == ["noun", "common_noun"]
    assert groups(["intransitive verb"]) == ["verb", "intransitive_verb"]
    assert groups([], fixed.VERB, fixed.TRANSITIVE) == ["verb", "transitive_verb"]
    assert groups(["adverb taking the 'to' particle"]) == ["adverb", "adverb_to"]
    assert groups([], "", "", "名詞-固有名詞-一般") == ["proper_noun"]
    assert groups(["copula"]) == ["auxiliary"]


def test_sources(spark):
    label = lambda c, n: one(spark, cl.translation_source("c", "n"), "c double, n boolean", c, n)
    assert label(0.6, False) == fixed.DICTIONARY_SOURCE
    assert label(0.59, False) == fixed.REPAIR_SOURCE
    assert label(0.9, True) == fixed.REPAIR_SOURCE
    assert col(spark, lambda c: cl.has_source_prefix(c, ("LLM",)), "LLM x") is True
    assert col(spark, lambda c: cl.has_source_prefix(c, ()), "LLM x") is False
