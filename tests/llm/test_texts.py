"""HTML, pieces, token files, chat, quality, mixing, URLs: worked examples, brute force and round trips."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat, coder, html, mixing, pieces, quality, token_files, urls


def test_main_text():
    page = (
        '<html><head><title>t</title></head><body><header><a href="/">Home</a></header><nav>m</nav><div class="cookie-notice">we use</div><main><article>'
        '<header><h1>Head &amp; line</h1><p>by me</p></header><p>One <b>two\n three</b><br>four<p>five <a href=x>six</a>.<ul><li>a<li>b</ul>'
        "<table><tr><td>c<td>d</table><aside>x</aside><div class=ad>buy</div><script>if(a<b){'</p>'}</script><form><input><label>q</label></form>"
        '3 < 4 &lt;b&gt; tail</article><section id="comments"><p>reader</p></section></main><footer>f</footer></body></html>'
    )
    assert html.main_text(page, set(), set()) == "Head & line\n\nOne two three four\n\nfive six.\n\na\n\nb\n\nc\n\nd\n\n3 < 4 <b> tail"
    assert html.main_text("<p>a<p>b<div>c", set(), set()) == "a\n\nb\n\nc"
    assert html.main_text("<article><p>x<!-- y", set(), set()) == "x"
    assert html.main_text("", set(), set()) == "" and html.main_text("<", set(), set()) == "<"


def test_template_of_a_host(spark):
    def page(i):
        return f'<div id=top><a href=/>Home {i % 3}</a></div><div class=x><p>Printed by the house</p><p>Story {i} goes on</p></div>'

    rows = [(i, f"http://a.example/{i}", page(i), 0) for i in range(20)] + [(20, "http://b.example/", page(20), 0), (21, None, None, 0), (22, "http://a.example/e", "", 0), (22, "http://b.example/", page(20), 0)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.html_extraction(spark.createDataFrame(rows[:20] + rows[20:22] + rows[23:], "page_id long, url string, html string, text int")).collect())
    assert got[3] == (3, "Story 3 goes on", 15)  # the shared line and the link bar belong to the template
    assert got[20] == (20, "Home 2\n\nPrinted by the house\n\nStory 20 goes on", 46)  # a host of few pages has none
    assert got[21] == (21, "", 0) and len(got) == 23
    assert html.html_extraction(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_outside_the_article(spark):
    def page(i):
        twice = "<p class=b>Printed twice</p>" * 2
        most = "" if i == 7 else "<p class=c>On all but one</p>"
        half = "" if i % 2 and i != 1 else "<p class=d>Half of the pages</p><p class=e>have two lines</p>"
        few = "<p class=f>On a few</p>" if i % 5 == 0 else ""
        return f"<div class=x>{twice}{most}{half}{few}<p>Story {i} goes on</p></div>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(40)] + [(40, "http://a.example/e", ""), (41, "http://a.example/n", None)]
    got = {r.page_id: r.text for r in html.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("On a few\n\n" if i % 5 == 0 else "") + f"Story {i} goes on" for i in range(40)} | {40: "", 41: ""}


def test_articles_and_repeated_pages_stay_whole(spark):
    def article(i):
        return f"<div><p>Printed here</p></div><article><h2>Introduction</h2><p>Story {i}</p></article>"

    rows = [(i, f"http://b.example/{i}", "<article><p>One page</p></article>") for i in range(20)] + [(100 + i, f"http://c.example/{i}", "<p>Same page</p>") for i in range(20)]
    rows += [(200 + i, f"http://d.example/{i}", article(i)) for i in range(20)] + [(300, None, "<p>Twin</p>")] * 20
    out = html.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and got[300] == "Twin"
    for i in range(20):
        assert (got[i], got[100 + i], got[200 + i]) == ("One page", "Same page", f"Introduction\n\nStory {i}")


def test_article_text_is_not_cut_by_class_words():
    kept = '<section class="related-work"><p>Rel</p></section><p class="share-price">Up <math><mi>x</mi><mo>=</mo><mn>2</mn></math> now</p><div class=notice>Note</div>'
    more = '<p data-hidden=1 title=" hidden ">Seen</p><p><noscript>No</noscript> <object>Ob</object></p>'
    gone = "<aside>a</aside><div class='x ad'>b</div><div role=navigation>c</div><p hidden>d</p><div id=comments><p>e</p></div>"
    page = f"<noscript>off</noscript><article><h1>T</h1>{kept}{gone}{more}</article><div class=notice>out</div>"
    assert html.main_text(page, set(), set()) == "T\n\nRel\n\nUp x=2 now\n\nNote\n\nSeen\n\nNo Ob"
    assert html.main_text("<article>" + "<p>long text</p>" * 50_000 + "</article>", set(), set()).count("long") == 50_000


def test_template_decides_names_inside_the_article(spark):
    def page(host, i):
        box = f'<div class="box notice"><p>Box {i}</p></div>' if host == "a" or i == 3 else ""
        return f"<article><h1>T {i}</h1>{box}<p>Story {i}</p></article>"

    rows = [(100 * k + i, f"http://{h}.example/{i}", page(h, i)) for k, h in enumerate("ab") for i in range(12)]
    got = {r.page_id: r.text for r in html.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T 3\n\nStory 3"  # a box on every page of its host is the template's
    assert got[103] == "T 3\n\nBox 3\n\nStory 3"  # one author's box is not


def plain_templates(rows):
    """Equivalence classes of a host's tokens by comparing whole vectors."""
    out = {}
    for host, group in rows.items():
        pages = sorted(set(group))
        vectors, about = {}, {}
        for i, page in enumerate(pages):
            for key, (n, chars, linked, parent, shape) in html.page_tokens(page).items():
                vectors.setdefault(key, []).append((i, n))
                old = about.get(key, (0, 0, parent, shape))
                about[key] = (old[0] + chars, old[1] + linked, parent, max(old[3], shape))
        often = {k: tuple(v) for k, v in vectors.items() if len(v) > 1 and len(v) >= html.SPAN * len(pages)}
        size = Counter(often.values())
        valid = {k for k, v in often.items() if size[v] >= html.MIN_CLASS or len(v) >= html.NEARLY * len(pages)}
        tokens = [{t for kind, t in valid if kind == k} for k in (1, 2, 3)]
        menus = {t for t in tokens[0] if about[1, t][1] > html.MOST_LINKS * about[1, t][0]}
        places = [(t, about[3, t][2], about[3, t][0] - about[3, t][1], about[3, t][3]) for t in tokens[2]]
        if valid:
            out[host] = (tokens[1], menus, tokens[0], html.text_slot(places))
    return out


def test_templates_equal_whole_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select(html.host_column(F.col("url")).alias("host"), "html")
    # few hosts of many pages: the made-up hosts are dealt to their last name
    rows = rows.withColumn("host", F.regexp_extract("host", "[^.]*$", 0)).unionAll(rows.limit(3))
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.host, []).append(r.html or "")
    got = {r.host: (set(r.fixed), set(r.menus), set(r.placed), r.slot) for r in html.templates(rows).collect()}
    assert got == plain_templates(groups) and any(slot for *_, slot in got.values())


def table_text(page):
    from html import unescape

    body = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_html_over_the_table(spark, sf):
    got = {r.page_id: r.text for r in html.op3_html_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert got[r.page_id] == table_text(r.html)


def test_text_slot_without_names(spark, sf):
    """All holders are plain div: the template of the host finds the text."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").where("html LIKE '%</article>%'")
    plain = pages.withColumn("html", F.regexp_replace("html", "<(/?)(?:article|nav|footer|aside|header|div)[^>]*>", "<$1div>")).withColumn("url", F.lit("http://a.example/"))
    got = {r.page_id: r.text for r in html.html_extraction(plain).collect()}
    assert got == {r.page_id: table_text(r.html) for r in pages.collect()}


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.model_path())


def plain_viterbi(model, word):
    score = {model.text[i]: s for _, ids, scores, _ in model.tables.values() for i, s in zip(ids.tolist(), scores.tolist())}
    place = {p: i for i, p in enumerate(model.text)}
    best, back = [0.0], [None]
    for e in range(1, len(word) + 1):
        top, step = best[e - 1] + model.unknown, (e - 1, None)
        for s in range(e - 1, max(-1, e - 17), -1):
            if word[s:e] in score and best[s] + score[word[s:e]] >= top:
                top, step = best[s] + score[word[s:e]], (s, word[s:e])
        best.append(top)
        back.append(step)
    out, e = [], len(word)
    while e:
        s, p = back[e]
        out = ([place[p]] if p else [model.byte[b] for b in word[s:e].encode()]) + out
        e = s
    return out


def test_pieces(spark, sf, model):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(12).collect()]
    texts += ["  ", " a", "a ", "  a   b  ", "\t\n x", "日本語🙂 ﷽ z", "é" * 50, "x" * 3000, "\x00 a", "a　b"]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for t, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == [i for w in model.words(t) for i in plain_viterbi(model, w)]
        assert model.decode(ids) == t == library.decode(ids.tolist())
    assert [len(x) for x in model.encode(["", None])] == [0, 0] and model.decode(model.encode(["▁"])[0]) == " "


def test_pieces_in_spark(spark):
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (None, "é", 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, ids int")
    coded = pieces.encode(df)
    assert sorted((str(r.doc_id), r.text) for r in pieces.decode(coded).fillna({"text": "null"}).collect()) == [("1", "a b"), ("1", "a b"), ("2", "null"), ("3", ""), ("None", "é")]
    assert coded.where("not round_trip").count() == 0 and pieces.encode(df.limit(0)).count() == 0


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([5]), rng.integers(0, 65536, 5000), np.repeat(7, 9000), rng.integers(0, 6, 10_001), np.tile(rng.integers(0, 50_000, 40), 100)):
        data = coder.encode(ids)
        assert (coder.decode(data) == ids).all()
    assert len(coder.encode(np.repeat(7, 9000))) < 200
    data = bytearray(coder.encode(rng.integers(0, 9, 500)))
    data[40] ^= 255
    with pytest.raises(ValueError):
        coder.decode(bytes(data))
    with pytest.raises(ValueError):
        coder.encode(np.array([70_000]))


def test_words_equal_the_tokenizer():
    words = token_files.Words(token_files.tokenizer_path())
    odd = ["a  b", "a \n b", " a", "a ", "\t x", "don't  stop 1 2  3 !? ?!", "日本 語 <|endoftext|> x", "  ", "\n\n a", "   x   y  z", "é è  b   c"]
    odd += [f"a{chr(c)} b {chr(c)}c  {chr(c)} d" for c in [*range(0x300), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x180E, 0x1680]]
    for text, ids in zip(odd, words.encode(odd), strict=True):
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_coder_shortens_rare_ids():
    # frequent and rare ids as in texts; ids that no context predicts took 16 bits each before
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 400_000) - 1, 50_000)
    data = coder.encode(ids)
    assert (coder.decode(data) == ids).all() and len(data) < 1.2 * len(ids)
    # blocks of every length, words that carry into words before them, ids at both ends
    for n in (1, 2, coder.BLOCK - 1, coder.BLOCK, coder.BLOCK + 1, 3 * coder.BLOCK + 7):
        for ids in (np.full(n, 65_535), rng.integers(65_000, 65_536, n), rng.choice([0, 65_535], n)):
            assert (coder.decode(coder.encode(ids)) == ids).all()


def test_words_of_a_batch_equal_the_tokenizer():
    rng = random.Random(3)
    parts = ["a", "Zé", "é", "ñ", "ſ", "ɏ", " ", "  ", "\n", "\n\n", "\r\n", "\t", ",", ".", "'", "'s", "'ll", "7", "(", ")", "-", "\xa0", "\u2009", "\x1c", "\x85", "«", "日", "<|endoftext|>", "×", "÷", "_", "word", " word", "\ufeff", "\u0301", "😀", "\0"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000))]
    words = token_files.Words(token_files.tokenizer_path())
    for column in (texts, texts[::-1]):
        ids, lengths = words.ids(pa.array(column, pa.string()).slice(3), 2)
        whole = [words.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in column[3:]]
        assert lengths.tolist() == list(map(len, whole)) and ids.tolist() == [i for x in whole for i in x]
    # most words come from the store or as pieces, not one call each
    calls = []
    words._single = lambda x: calls.extend(x) or token_files.Words._single(words, x)
    words.ids(pa.array([f"Letra{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}ñ, otra{chr(97 + i % 26)}.\nY más" for i in range(2000)]))
    assert not calls


def test_token_files(spark, tmp_path):
    rows = [(5, "the cat sat"), (2, "on the mat " * 300), (9, None), (2, "a twin"), (None, "no id"), (7, "")]
    files = token_files.write_tokens(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(3), file_ids=500)
    got = token_files.read_tokens(files).orderBy("start").collect()
    tokenizer = token_files.words_of(token_files.tokenizer_path()).tokenizer
    ordered = [(None, "no id"), (2, "a twin"), (2, "on the mat " * 300), (5, "the cat sat"), (7, ""), (9, None)]
    at = 0
    for r, (doc, text) in zip(got, ordered, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [token_files.END]
        assert (r.doc_id, r.start, r.ids, r.ids_crc32) == (doc, at, ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_files.export_files(files, str(tmp_path))
    whole = b"".join(p.read_bytes()[:8] for p in sorted(tmp_path.iterdir()))
    assert whole == token_files.MAGIC * files.count()
    assert token_files.read_tokens(token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_chat_sides(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (None, 0, None, "x"), (2, 0, "system", "alone"), (1, None, "ann", "first")]
    rows += [(9, i, f"p{i % 3}", "w" * (i % 7)) for i in range(300)]
    out = chat.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    whole = {}
    for r in sorted(out, key=lambda r: r.position):
        key = (r.conv_id, r.perspective)
        text = whole.get(key, "")
        assert (r.start, r.end) == (len(text), len(text) + len(r.segment))
        if r.train_start is not None:
            assert r.speaker == r.perspective and r.segment[r.train_start - r.start : r.train_end - r.start].endswith("<|im_end|>")
        else:
            assert r.speaker != r.perspective
        whole[key] = text + r.segment
    assert whole[1, "bob"] == "<|im_start|>user name=ann\nfirst<|im_end|>\n<|im_start|>system\nS<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n" + 2 * "<|im_start|>assistant\n<|im_end|>\n"
    assert whole[None, "unknown"] == "<|im_start|>assistant\nx<|im_end|>\n"
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "unknown"), (9, "p0"), (9, "p1"), (9, "p2")}
    assert chat.rendered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    twice = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)


def plain_fit(points):
    """Centre, factor and scale of one group's rows, by the same steps in numpy."""
    v = points / quality.GRID
    floors = np.array(quality.FLOORS)
    centre = np.median(points, 0)
    sigma = np.maximum(1.4826 * np.median(np.abs(points - centre), 0) / quality.GRID, floors)
    mean, cov = centre / quality.GRID, np.diag(sigma**2)
    for step in range(quality.STEPS + 1):
        z = np.linalg.solve(np.linalg.cholesky(cov), (v - mean).T)
        bins = np.floor(np.log1p((z**2).sum(0)) * quality.BIN)
        if step == quality.STEPS:
            return mean, cov, max(1.0, (np.exp(np.median(bins) / quality.BIN) - 1) / quality.CHI_MEDIAN)
        near = v[bins <= np.ceil(np.quantile(bins, quality.SUPPORT))]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) + np.diag(floors**2)


def test_quality_rules(spark):
    rng = np.random.default_rng(7)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))

    rows = [(i, prose(int(rng.integers(50, 200))) + ("\nsame line\nsame line" if i % 11 == 0 else ""), "en", "s0", 1, 2) for i in range(130)]
    rows += [(200 + i, " ".join(w + "***" for w in prose(80).split()), "en", "s0", 1, 2) for i in range(4)]
    rows += [(300, None, None, None, 1, 2), (301, "", "en", "s1", 1, 2), (302, "a b c " * 60, "en", "s0", 1, 2), (303, "# * $ % & | < >", "fr", None, 1, 2), (304, "x\x0by\x0cz w " * 30, "en", "s0", 1, 2), (5, rows[5][1], "en", "s0", 1, 2)]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, v0 int, kept int")).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in out:
        want = plain_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.v0 == 1
    kept = {r.doc_id for r in out if r.kept}
    assert kept == set(range(130))

    def vector(t):
        w, c, s, d, p = plain_counts(t)
        caps = len(re.findall("[A-Z]", t or ""))
        w, c = max(w, 1), max(c, 1)
        return [np.floor(x * quality.GRID + 0.5) for x in (np.log(c / w), np.log1p(100 * s / c), np.log1p(1000 * d / w), np.log1p(100 * p / w), np.log1p(100 * caps / c))]

    own = [r for r in rows if r[3] == "s0"]
    points = np.array([vector(r[1]) for r in own])
    mean, cov, scale = plain_fit(points)
    z = np.linalg.solve(np.linalg.cholesky(cov), (points / quality.GRID - mean).T)
    want = {r[0]: d for r, d in zip(own, (z**2).sum(0) / scale, strict=True)}
    for r in out:
        if r.doc_id in want:
            assert r.d2 == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-9)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.quality_rules(empty).count() == 0


def test_quality_rules_reject_repeats(spark):
    rng = np.random.default_rng(9)

    def words(n):
        return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]

    rows = [(i, " ".join(words(int(rng.integers(80, 160))))) for i in range(200)]
    windows, lines = words(200), words(150)
    windows[100:130] = windows[:30]  # 60 of 200 words stand in repeated windows
    rows += [(300, " ".join(windows)), (301, "\n".join([*lines[:100], *["go up"] * 12]))]
    rows += [(302, "\n".join([" ".join(lines), *["read more"] * 20])), (303, " ".join(windows[:90] + windows[:20]))]
    out = quality.quality_rules(spark.createDataFrame([(*r, "en", "s0") for r in rows], "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in out) and {r.doc_id for r in out if r.kept} == set(range(200))


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "word " * int(rng.integers(1, 40)) + rng.choice(["alpha", "gamma", "delta"]), f"s{i % 3 if i % 2 else 0}", "en" if i % 5 else "fr", 0) for i in range(600)]
    rows += [(700, None, None, None, 0), (701, "", "s0", "en", 0), (5, rows[5][1], rows[5][2], rows[5][3], 0), (None, "a few words", "s1", "fr", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")
    targets = {"source": {"s0": 0.3, "s1": 0.4, "s2": 0.3}, "lang": {"en": 0.7, "fr": 0.3}}
    out = mixing.mix_documents(df, targets=targets, share=0.2, rounds=30).collect()
    assert len(out) == len(rows) and all(0 <= r.probability <= 1 for r in out)
    total = sum(r.n_tokens for r in out)
    for side, wish in targets.items():
        for name, share in wish.items():
            got = sum(r.n_tokens * r.probability for r in out if r[side] == name)
            assert got == pytest.approx(0.2 * total * share, rel=0.02)
    assert {r.topic for r in out if r.doc_id == 701} == {-1} and {r.kept for r in out if r.doc_id in (700, 701)} <= {True, False}
    assert len({r.kept for r in out if r.doc_id == 5}) == 1
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_mixing_meets_its_targets_at_the_defaults(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "word " * int(rng.integers(1, 40)) + str(rng.choice(["alpha", "gamma", "delta", "omega"])), "hot" if i % 2 else f"s{i % 7}", "en" if i % 5 else "fr") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    counted = mixing.stored(mixing.with_tokens(docs, docs["text"]))
    cells = counted.groupBy("source", "lang", "topic").agg(mixing.F.sum("n_tokens").alias("base"))
    out = mixing.fitted_cells(cells).collect()
    total = sum(r.base for r in out)
    assert all(0 <= r.probability <= 1 for r in out) and any(r.probability == 1 for r in out)
    missing = 0
    for side in mixing.SIDES:
        have, base = Counter(), Counter()
        for r in out:
            have[r[side]] += r.base * r.probability
            base[r[side]] += r.base
        wish = {k: (v / total) ** mixing.TEMPER for k, v in base.items()}
        for k in base:
            want = min(base[k], wish[k] / sum(wish.values()) * total * mixing.SHARE)
            short = {r[f"short_{side}"] for r in out if r[side] == k}
            assert len(short) == 1 and short.pop() == pytest.approx(wish[k] / sum(wish.values()) * total * mixing.SHARE - have[k], abs=0.01 * total / 100)
            missing = max(missing, abs(have[k] / want - 1))
    assert missing < 0.02


def test_url_references(spark):
    def link(url):
        return f'<link rel="canonical" href="{url}">'

    rows = [(1, "http://b.net/1?page=2&ref=x", link("http://example.org/es/1")), (2, "http://b.net/2", link("http://b.net/1?page=2&amp;ref=x")), (3, "http://b.net/3", link("&#x2F;1?page=2&#38;ref=x"))]
    rows += [(4, "http://b.net/4", '<meta http-equiv="refresh" content="0; url=&quot;/1?page=2&amp;ref=x&quot;">'), (5, "http://b.net/5", link("/1?page=2&amp;amp;ref=x"))]
    got = {r.page_id: r.verdict for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


LINKS = [  # (url, html, verdict): the forms a link may have, and marks that are none
    ("http://c.net/1", '<link rel="canonical" href="/out?u=http://x.com/de/no">', "allow"),
    ("http://d.net/p?v=1", '<link rel="canonical" href="?v=2">', "block"),
    ("http://d.net/p?v=2", '<link rel="canonical" href="http://x.com/de/no">', "block"),
    ("http://e.net/a/b/c", '<link rel="canonical" href="../z">', "block"),
    ("http://e.net/a/b/d", '<link rel="canonical" href="./../z">', "block"),
    ("http://e.net/a/./z", '<link rel="canonical" href="http://x.com/fr/../de/no">', "block"),
    ("http://f.net/1", '<link rel="canonical" data-href="http://f.net/ok" href="http://x.com/de/no">', "block"),
    ("http://f.net/2", '<link rel="canonical" title=" href=http://x.com/de/no">', "allow"),
    ("http://f.net/3", '<link title="a > b" rel="shortlink Canonical" href=http://x.com/de/no>', "block"),
    ("http://f.net/4", '<link rel="canonical-not" href="http://x.com/de/no">', "allow"),
    ("http://g.net/1", '<!-- <link rel="canonical" href="http://x.com/de/no"> -->', "allow"),
    ("http://g.net/2", """<script>var a = '<link rel="canonical" href="http://x.com/de/no">'</script>""", "allow"),
    ("http://g.net/3", '<script>x</script><link rel="canonical" href="http://x.com/de/no"><!-- open', "block"),
    ("http://h.net/1", '<meta http-equiv="Refresh" content="0;URL=http://x.com/de/a;b">', "block"),
    ("http://h.net/2", """<meta content="5, url='/1' and more" http-equiv=refresh>""", "block"),
    ("http://h.net/3", '<meta http-equiv="refresh" content="30">', "allow"),
    ("http://h.net/4", '<meta rel="canonical" href="http://x.com/de/no"><link rel=canonical href="#top"><link rel=canonical href="mailto:a@x.com">', "allow"),
    ("http://i.net", '<link rel="canonical" href="http://x.com/de/no">', "block"),
    ("http://i.net/", None, "block"),
    ("http://i.net/long", "<link " + "a='b' " * 30_000 + "<meta " * 30_000, "allow"),
]


def test_url_link_forms(spark, tmp_path):
    pages = spark.createDataFrame([(i, *row[:2]) for i, row in enumerate(LINKS)], "page_id long, url string, html string")
    out = urls.url_filter(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    assert {LINKS[r.page_id][0]: r.verdict for r in out} == {u: v for u, _, v in LINKS}
    pages.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    assert sorted(map(str, con.execute(urls.OP10_SQL).fetchall())) == sorted(str(tuple(r)) for r in out)


def test_url_aliases(spark):
    def link(url):
        return f'<html><LINK href="{url}" rel="canonical"><p>'

    rows = [
        (1, "http://A.example.org/es/x", None), (2, "https://b.net/1#top", link("http://a.example.org/es/x")), (3, "https://b.net/2", '<meta http-equiv="refresh" content="0; url=/1">'),
        (4, "http://c.net/", link("http://d.com/fr/ok")), (5, "http://c.net/2", link("http://c.net/")), (6, "http://c.net/2", link("http://x.com/de/no")), (7, None, link("http://x.com/de/no")),
        (8, "no scheme", None), (9, "http://x.org", None), (10, "http://e.net/", None), (11, "http://a.example.org/en/12", None), (1, "http://A.example.org/es/x", None), (12, "http://f.org/", link("//x.com/de/no")),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2][2:] == (None, "block") and got[3][2:] == (None, "block")  # through a chain of links
    assert got[4][2:] == (None, "allow") and got[5][2:] == (None, "allow") and got[6][2:] == (None, "allow")  # an allowed alias outranks a blocked one
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("x.org", "", None, "allow") and got[10][3] == "allow" and got[11][2:] == ("example.org/en/1", "block")
    assert got[12][2:] == ("org/", "allow")
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
