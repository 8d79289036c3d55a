"""Source files to lexicon outputs, end to end on small files."""

import bz2
import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexmill import fixed
from lexmill.operators import lexicon as lx
from lexmill.operators.frequency import all_frequency_records, frequency_keys, join_frequency
from lexmill.plans.build import build_lexicon
from lexmill.sources import readers

DTD = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE JMdict [
<!ELEMENT JMdict (entry*)>
<!ENTITY n "noun (common) (futsuumeishi)">
<!ENTITY v1 "Ichidan verb">
<!ENTITY v5m "Godan verb with 'mu' ending">
<!ENTITY vt "transitive verb">
<!ENTITY vi "intransitive verb">
<!ENTITY arch "archaism">
<!ENTITY ctr "counter">
<!ENTITY exp "expressions (phrases, clauses, etc.)">
<!ENTITY adj-i "adjective (keiyoushi)">
]>
<JMdict>
"""


def entry(seq, kebs, rebs, pos, glosses=("x",), misc=(), field=(), dial=()):
    k = "".join(f"<k_ele>\n<keb>{t}</keb>{''.join(f'<ke_pri>{p}</ke_pri>' for p in pri)}</k_ele>\n" for t, pri in kebs)
    r = "".join(f"<r_ele><reb>{t}</reb>{''.join(f'<re_pri>{p}</re_pri>' for p in pri)}</r_ele>" for t, pri in rebs)
    tags = lambda name, vs: "".join(f"<{name}>{v}</{name}>" for v in vs)
    g = "".join(x if x.startswith("<") else f"<gloss>{x}</gloss>" for x in glosses)
    return f"<entry>\n<ent_seq>{seq}</ent_seq>\n{k}{r}<sense>{tags('pos', pos)}{tags('field', field)}{tags('misc', misc)}{tags('dial', dial)}{g}</sense>\n</entry>\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("src")
    xml = DTD + "".join(
        [
            entry(1, [("学校", ["ichi1", "nf01"])], [("がっこう", ["ichi1"])], ["&n;"],
                  ["school", '<gloss xml:lang="ger">Schule</gloss>', "R&amp;D"]),
            entry(2, [("集まる", ["ichi1"])], [("あつまる", [])], ["&v5m;", "&vi;"], ["to gather"]),
            entry(3, [("集める", ["news2"])], [("あつめる", [])], ["&v1;", "&vt;"], ["to collect"]),
            entry(4, [("古語", ["ichi1"])], [("こご", [])], ["&n;"], misc=["&arch;"]),
            entry(5, [("枚", ["ichi1"])], [("まい", [])], ["noun", "&ctr;"]),
            entry(6, [("無", [])], [("む", [])], ["&n;"]),
            entry(7, [("句", ["ichi1"])], [("く", [])], ["&exp;"]),
            entry(8, [("上", [])], [("かみ", [])], ["&n;"]),
            entry(9, [("楽しい", ["nf20"])], [("たのしい", [])], ["&adj-i;"]),
            entry(10, [("仏", ["ichi1"])], [("ほとけ", [])], ["&n;"], field=["Buddhist term"]),
            entry(11, [], [("カタカナ", [])], ["&n;"]),
            entry(12, [("走", [])], [("はしる", [])], ["&n;"]),
        ]
    ) + "</JMdict>\n"
    with gzip.open(d / "dict.gz", "wt", encoding="utf-8") as f:
        f.write(xml)
    kanji = '<kanjidic2>\n' + "".join(
        f'<character><literal>{c}</literal><misc><grade>{g}</grade></misc><reading_meaning><rmgroup>'
        f'<reading r_type="pinyin">x</reading><reading r_type="ja_on">{on}</reading><reading r_type="ja_kun">{kun}</reading>'
        f'</rmgroup></reading_meaning></character>\n'
        for c, g, on, kun in [("学", 1, "ガク", "まな.ぶ"), ("校", 9, "コウ", "")]
    ) + "</kanjidic2>\n"
    with gzip.open(d / "kanji.gz", "wt", encoding="utf-8") as f:
        f.write(kanji)
    (d / "freq.tsv").write_text(
        "rank\tlForm\tlemma\tpos\tfrequency\tpmw\n"
        "1\tガッコウ\t学校\t名詞-普通名詞\t100\t10.5\n"
        "x\tム\t無\t名詞\t1\t1\n"
        "50001\tム\t無\t名詞\t1\t1\n"
        "20\tカミ\t上\t名詞\t7\t0.7\n"
        "10\tウエ\t上\t名詞\t9\t0.9\n"
        "30001\tカタカナ\tカタカナ\t名詞\t5\t0.5\n"
        "7\tハシル\t走\t動詞-一般\t5\t0.5\n",
        encoding="utf-8",
    )
    (d / "over.tsv").write_text(
        "﻿词条ID\t中文翻译\t翻译来源\n1\t旧\ts\n1\t学校\ts2\n2\t\ts\n", encoding="utf-8"
    )
    (d / "levels.csv").write_text(
        "﻿词条ID,JLPT参考等级,JLPT来源,JLPT置信度,JLPT备注\n1,N5,src,high,note\n", encoding="utf-8"
    )
    return d


@pytest.fixture(scope="module")
def built(spark, files, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    tables = build_lexicon(
        spark, f"{files}/dict.gz", out, f"{files}/kanji.gz", f"{files}/freq.tsv", f"{files}/over.tsv", f"{files}/levels.csv"
    )
    return out, tables


def test_dictionary_scan(spark, files):
    rows = {r["ent_seq"]: r for r in readers.read_dictionary(spark, f"{files}/dict.gz", 2).collect()}
    assert len(rows) == 12
    assert rows["2"]["senses"][0]["pos"] == ["Godan verb with 'mu' ending", "intransitive verb"]
    assert rows["5"]["senses"][0]["pos"] == ["noun", "counter"]
    assert rows["1"]["written"][0]["tags"] == ["ichi1", "nf01"]
    assert [g["lang"] for g in rows["1"]["senses"][0]["gloss"]] == [None, "ger", None]


def test_kanji_and_frequency_scan(spark, files):
    k = {r["kanji"]: r for r in readers.read_kanji(spark, f"{files}/kanji.gz").collect()}
    assert (k["学"]["status"], k["学"]["on_readings"], k["学"]["kun_readings"]) == (fixed.JOYO_LABEL, "ガク", "まな.ぶ")
    assert k["校"]["status"] == ""
    ranks = sorted(r["rank"] for r in readers.read_frequency(spark, f"{files}/freq.tsv", fixed.FREQ_MAX_RANK).collect())
    assert ranks == [1, 7, 10, 20, 30001]


def test_frequency_join(spark, files):
    freq = readers.read_frequency(spark, f"{files}/freq.tsv")
    keys = {r["key"]: r["rank"] for r in frequency_keys(freq).collect()}
    assert keys["上"] == 10 and keys["うえ"] == 10 and keys["カミ"] == 20
    entries = spark.createDataFrame([("8", "上", ["上"], ["かみ"])], "entry_id string, headword string, writings array<string>, readings array<string>")
    assert join_frequency(entries, frequency_keys(freq)).first()["freq_rank"] is None
    assert join_frequency(entries, all_frequency_records(freq)).first()["freq_rank"] == 20


def test_rejections(built):
    _, t = built
    reasons = {r["entry_id"]: r["reject_reason"] for r in t["classified"].collect()}
    assert reasons == {
        "1": None, "2": None, "3": None, "4": "all_senses_excluded", "5": "counter", "6": "no_abc_evidence",
        "7": "out_of_requested_pos", "8": "no_abc_evidence", "9": None, "10": "specialized_field", "11": None,
        "12": "bccwj_pos_mismatch",
    }


def test_lexicon_rows(built):
    _, t = built
    rows = {r["entry_id"]: r for r in t["lexicon"].collect()}
    assert rows["1"]["translation"] == "学校" and rows["1"]["ref_level"] == "N5" and rows["1"]["freq_rank"] == 1
    assert rows["1"]["glosses"] == ["school", "R&D"]
    assert rows["2"]["related"] == ["集める（あつめる）"] and rows["3"]["related"] == ["集まる（あつまる）"]
    assert rows["11"]["level"] == "C" and rows["11"]["cluster"] == fixed.KANA_NOUN
    assert rows["9"]["major"] == fixed.I_ADJ and rows["9"]["level"] == "B"


def test_tree_and_audit(spark, built):
    out, t = built
    tree = t["tree"].where("entry_id = '1'").orderBy("ord").collect()
    assert [(r["kanji"], r["relation"]) for r in tree] == [("学", fixed.MAIN_NODE), ("校", fixed.CONTAINED_NODE)]
    assert tree[0]["path"] == "学 > ガク > 学校"
    audit = {r["item"]: r["amount"] for r in t["audit"].where("item <> 'rejected_sample'").collect()}
    assert audit["jmdict_entries_seen"] == "12" and audit["accepted_total"] == "5"
    assert audit["accepted_by_bccwj_rank_only"] == "1" and audit["translation_overrides_loaded"] == "1"
    notes = [json.loads(r["note"])["ent_seq"] for r in t["audit"].where("item = 'rejected_sample'").collect()]
    assert notes == ["6", "8"]
    master = readers.read_master(spark, f"{out}/master_lexicon", ["A"])
    assert {r["entry_id"] for r in master.collect()} == {"1", "2"}
    verbs = spark.read.option("header", True).csv(f"{out}/verbs_by_transitivity")
    assert verbs.columns == list(fixed.MASTER_COLUMNS) and verbs.count() == 2
    checks = {r["check"]: r["bad"] for r in lx.quality_checks(t["lexicon"]).collect()}
    assert set(checks.values()) == {0}


def test_pairs_hot_reading(spark):
    rows = [(str(i), i, f"語{i}", "あつめる", fixed.TRANSITIVE, fixed.VERB) for i in range(50)]
    rows.append(("x", 99, "集まる", "あつまる", fixed.BOTH_TRANSITIVITIES, fixed.VERB))
    df = spark.createDataFrame(rows, "entry_id string, doc_pos int, headword string, reading string, transitivity string, major string")
    got = {r["entry_id"]: r["related"] for r in lx.pair_candidates(df).collect()}
    assert got["x"] == [f"語{i}（あつめる）" for i in range(5)]
    assert all(got[str(i)] == ["集まる（あつまる）"] for i in range(50))


def test_other_sources(spark, tmp_path):
    with bz2.open(tmp_path / "s.tsv.bz2", "wt", encoding="utf-8") as f:
        f.write("1\tjpn\told\n2\tjpn\t b \n1\tjpn\tnew\n3\tjpn\n")
    rows = {r["sentence_id"]: r["text"] for r in readers.read_sentences(spark, str(tmp_path / "s.tsv.bz2")).collect()}
    assert rows == {"1": "new", "2": "b"}
    (tmp_path / "c.jsonl").write_text(
        '{"id":"1","translation":["a"]}\nnot json\n{"id":"1","translation":"b; c","source":"s"}\n{"id":"","translation":["x"]}\n{"id":"2","translation":"n/a"}\n',
        encoding="utf-8",
    )
    cache = readers.read_translation_cache(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r["entry_id"], r["translation"], r["source"]) for r in cache] == [("1", ["b", "c"], "s")]
    (tmp_path / "v.txt").write_text("国國|学學|単", encoding="utf-8")
    pairs = {(r["kanji"], r["variant"]) for r in readers.read_variants(spark, str(tmp_path / "v.txt")).collect()}
    assert pairs == {("国", "國"), ("國", "国"), ("学", "學"), ("學", "学")}
    (tmp_path / "study.json").write_text('{"preferences":{},"progress":{"starred":["1","1",""],"learned":[2]}}', encoding="utf-8")
    study = {(r["entry_id"], r["status"]) for r in readers.read_study_data(spark, str(tmp_path / "study.json")).collect()}
    assert study == {("1", "starred"), ("2", "learned")}
    (tmp_path / "b.txt").write_text("# c\n學校 学校 [xue2 xiao4] /school/CL:所[suo3]/\nbad\n", encoding="utf-8")
    b = readers.read_bilingual(spark, str(tmp_path / "b.txt")).first()
    assert (b["simplified"], b["definitions"]) == ("学校", "school/CL:所[suo3]")
