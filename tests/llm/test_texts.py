"""Operators that read texts one by one: tokens, decontamination, languages, pages, toxicity."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcelight.llm import op1_tokens, op5_decontaminate, op6_language, op7_html, op8_toxicity
from tests.llm.helpers import AZ, awkward, sentence, table

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(spark, name):
    path = tokenizers.path(name)
    rows = awkward(random.Random(1)) + [(100, "a  b   c <s> </s> <|endoftext|> " * 50), (101, "x" * 5000), (102, " lead and trail "), (103, "▁mark ▁ ▁▁b c" * 40)]
    got = op1_tokens.token_counts(table(spark, rows), path, part_chars=40, batch_bytes=500).collect()
    encode, _, _ = op1_tokens.counter(path)
    want = sorted((str(i), len((t or "").encode()), encode([t or ""])[0]) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_tokens_of_no_rows(spark):
    assert op1_tokens.token_counts(table(spark, []), tokenizers.path("piece_bpe_32k.model")).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert op1_tokens.token_counts(table(spark, []), tokenizers.path("piece_bpe_32k.model")).count() == 0


def _contaminated(rows, items, window):
    find = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    out = []
    for i, text in rows:
        w, hit, names = find(text), set(), set()
        for name, item in items:
            v = find(item)
            k = min(window, len(v))
            for p in range(len(v) - k + 1 if k and name is not None else 0):
                for q in range(len(w) - k + 1):
                    if w[q:q + k] == v[p:p + k]:
                        hit.update(range(q, q + k))
                        names.add(str(name))
        out.append((str(i), len(w), len(hit), sorted(names)))
    return sorted(out)


@pytest.mark.parametrize("block", [5, 10_000])
def test_decontamination(spark, block):
    rng = random.Random(2)
    items = [(i, sentence(rng, n, 12)) for i, n in enumerate((1, 2, 4, 5, 9, 14))] + [(7, None), (8, ""), (None, "w1 w2 w3 w4"), (9, "!!"), (3, "Only-Here é1")]
    rows = [(i, sentence(rng, rng.randrange(60), 12)) for i in range(30)] + awkward(rng) + [(50, items[5][1] + " x " + items[5][1]), (51, "ONLY here É1 é1")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = op5_decontaminate.benchmark_matches(table(spark, rows), benchmark, window=4, block_words=block)
    found = found.withColumn("n_hit", op5_decontaminate.covered(F.col("matches"))).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted({m["item"] for m in r.matches})) for r in found)
    assert got == _contaminated(rows, items, 4)
    kept = op5_decontaminate.decontaminate(table(spark, rows), benchmark, window=4)
    assert kept.columns == table(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, _, n, _ in got if not n)


def test_longest_matches_have_their_places(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    row = op5_decontaminate.benchmark_matches(table(spark, [(1, "x b c d e f y a b c d")]), benchmark, window=3).first()
    assert sorted((m["item_start"], m["doc_start"], m["n_words"]) for m in row.matches) == [(0, 7, 4), (1, 1, 5)]


def test_decontamination_without_items(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    rows = op5_decontaminate.benchmark_matches(table(spark, [(1, "a b"), (2, None)]), benchmark).collect()
    assert sorted((r.doc_id, r.n_words, len(r.matches)) for r in rows) == [(1, 2, 0), (2, 0, 0)]


LATIN = {"aa": ["bana", "kelo", "miru", "tasu"], "bb": ["xyzz", "qwor", "vupp", "jekk"]}


def _language_rows(rng):
    rows = [(i, " ".join(rng.choice(LATIN[lang]) + rng.choice(LATIN[lang]) for _ in range(30)), lang) for i in range(40) for lang in ("aa", "bb")]
    return [(k, t, lang) for k, (_, t, lang) in enumerate(rows)] + [(900, "привет мир как дела " * 5, "cc"), (901, "мир и дела " * 5, "cc")]


def test_languages(spark):
    rng = random.Random(3)
    model = op6_language.fit(table(spark, _language_rows(rng) + [(None, "no key", "zz"), (5000, None, "yy"), (5001, "no label", None)]))
    assert model.languages == ["aa", "bb", "cc"]
    a, b = (" ".join(rng.choice(LATIN[x]) for _ in range(20)) for x in ("aa", "bb"))
    rows = [(1, a, None), (2, b, None), (3, a + " " + b, None), (4, "мир дела", None), (5, None, None), (6, "12 !?", None), (7, "", None), (8, "日本語", None), (9, a * 3000, None), (9, a, None)]
    got = {(r.doc_id, r.lang_pred): r for r in op6_language.identify(table(spark, rows), model).collect()}
    (got_8,) = [lang for k, lang in got if k == 8]  # letters of no learned script: some learned language, with a low score
    assert got_8 in model.languages and got[8, got_8].score == op6_language.UNSEEN_SCORE
    assert [k for k in sorted(got)] == [(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc"), (5, "und"), (6, "und"), (7, "und"), (8, got_8), (9, "aa")] or (3, "bb") in got
    mixed = got.get((3, "aa")) or got[3, "bb"]
    assert [s["lang"] for s in mixed.spans] == ["aa", "bb"] and 0.4 < mixed.score < 0.6
    text = rows[2][1]
    assert text[mixed.spans[0]["start"]:mixed.spans[0]["end"]] == a and text[mixed.spans[1]["start"]:mixed.spans[1]["end"]] == b
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5, "und"].score == 0


def test_many_languages():
    rng = np.random.default_rng(1)
    for k in (127, 128, 200, 300):
        scores = rng.normal(size=(40, k))
        scores[:20, k - 1] += 30
        scores[20:, k - 2] += 30
        assert op6_language.viterbi(scores, 5.0).tolist() == [k - 1] * 20 + [k - 2] * 20


def test_languages_without_labels(spark):
    model = op6_language.fit(table(spark, []))
    assert [r.lang_pred for r in op6_language.identify(table(spark, [(1, "words")]), model).collect()] == ["und"]


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(60):
        n, k = rng.integers(1, 6), rng.integers(1, 4)
        scores = rng.normal(0, 3, (n, k))
        cost = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(cost(p) for p in itertools.product(range(k), repeat=int(n)))
        assert abs(cost(op6_language.viterbi(scores, 2.0).tolist()) - best) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad --><div class="ad">Buy ten things now for a price.</div>
<article><header><h1>Title &amp; more</h1></header><p>First <b>par</b>agraph,
 with   white space.<br>Line<p>Second&nbsp;one &lt;tag&gt; &eacute;.</p><aside>Related words here</aside><form><label>Mail</label><input></form>
<div class="comments"><p>Reader says many words in this place to be heard.</p></div><p>Last.</p></article><div id="cookie-notice">We use cookies.</div>
<footer>&copy; host &middot; words of a footer that go on for a while.</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "<p>plain <i>text</i> only</p>"), (4, None, "no markup"), (None, "u", "<article><p>" + "word " * 50_000 + "</article>"),
            (6, "u", "<article><p>cut off <b"), (7, "u", "<script>only()</script>"), (8, "u", "<nav>menu</nav>"), (9, "u", "<article>a &lt;b&gt; &#233; &amp;amp; &unknown; &am</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("key", F.lit(1))
    weights = op7_html.fit(pages)
    got = {(r.page_id, r.text): r.n_chars for r in op7_html.extract(pages, weights).collect()}
    assert set(got) == {(1, "Title & more First paragraph, with white space. Line Second one <tag> é. Last."), (2, ""), (3, ""), (4, "plain text only"), (4, "no markup"),
                        (None, ("word " * 50_000).strip()), (6, "cut off"), (7, ""), (8, ""), (9, "a <b> é &amp; &unknown; &am")}
    assert all(n == len(t) for (_, t), n in got.items())
    assert op7_html.extract(pages.limit(0), op7_html.fit(pages.limit(0))).count() == 0


def test_region_is_the_best_one():
    rng = random.Random(5)
    for _ in range(100):
        run = [op7_html.Piece("w " * rng.randrange(4), link=rng.random() < 0.3, out=rng.random() < 0.2) if rng.random() < 0.5 else op7_html.Piece(None, rng.choice("ab"), named=rng.random() < 0.3) for _ in range(12)]
        weights = op7_html.Weights(link=0.2, tags={"a": -1.0, "b": -2.5})
        total = lambda i, j: sum(weights.of(p) for p in run[i:j])
        best = max([0.0] + [total(i, j) for i in range(12) for j in range(i + 1, 13)])
        assert abs(total(*op7_html.region(run, weights)) - best) < 1e-9


def _f1(a: str, b: str) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def test_the_scan_finds_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = op7_html.fit(pages)
    htmls = [r.html for r in pages.select("html").collect()]
    text = [op7_html.main_text(h, weights) for h in htmls]
    # The text between the article's tags, taken by plain string functions.
    inner = [h.split("<article>")[1].split("</article>")[0].replace("<b>", "").replace("</b>", "") for h in htmls]
    assert text == [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", t)).split()) for t in inner]
    div = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in htmls]
    assert all(_f1(op7_html.main_text(h, weights), t) >= 0.95 for h, t in zip(div, text, strict=True))
    # Without any telling name the scan alone is left: taking the whole page instead is worse on every page.
    bare = [re.sub(r"<(/?)(?:nav|footer)", r"<\1div", h).replace('class="ad"', 'class="x1"') for h in div]
    scanned = [_f1(op7_html.main_text(h, weights), t) for h, t in zip(bare, text, strict=True)]
    whole = [_f1(op7_html.joined(op7_html.pieces(h, weights)), t) for h, t in zip(bare, text, strict=True)]
    assert all(a > b for a, b in zip(scanned, whole, strict=True)) and 1 - np.mean(scanned) < 0.6 * (1 - np.mean(whole))


def test_names_of_article_parts_do_not_drop_text(spark):
    page = """<body><div class="sidebar"><p>Side words stand here.</p></div><article><p class="legal">Legal text of the article.</p><ul><li>one <a href="/x">point</a></li><li>two</li></ul>
    <section id="form-theory"><h2>Forms</h2><p>They are studied.</p></section><div class="comments-theory"><p>Kept, as a theory.</p></div></article></body>"""
    assert op7_html.main_text(page, op7_html.Weights()) == "Legal text of the article. one point two Forms They are studied. Kept, as a theory."
    # A name that labelled pages use outside of their articles is learned as furniture.
    rows = [(i, f'<body><article><p>{"word " * 30}</p></article><div class="zz-promo">{"buy this " * 10}</div></body>') for i in range(20)]
    weights = op7_html.fit(spark.createDataFrame(rows, "page_id long, html string"))
    assert op7_html.main_text('<body><main><p>A few words</p><div class="zz-promo">Buy this now</div><p>and some more.</p></main></body>', weights) == "A few words and some more."


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_accepts_what_is_near():
    rng = random.Random(6)
    entries = [op8_toxicity.Entry("abcde", False, 5, 2), op8_toxicity.Entry("abd", False, 4, 0), op8_toxicity.Entry("bcab", True, 3, 0), op8_toxicity.Entry("cabbad", True, 3, 1)]
    values = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(4000)] + ["abcde", "abde", "abcdee", "bbcde", "abd", "bcabz", "cabbadé", "cbbadxx"]
    machine = op8_toxicity.automaton(entries)
    text, entry, edits, _, _ = op8_toxicity.scan(machine, values)
    got = {t: (e, k) for t, e, k in zip(text.tolist(), entry.tolist(), edits.tolist())}
    for i, v in enumerate(values):
        near = []
        for n, e in enumerate(entries):
            d = min(_distance(v[:k], e.text) for k in range(len(v) + 1)) if e.stem else _distance(v, e.text)
            if d <= e.edits:
                near.append((d, -e.exact, n))
        assert (i in got) == bool(near)
        if near:
            assert got[i] == (min(near)[2], min(near)[0])


def test_toxicity(spark):
    rng = random.Random(7)
    plain = [sentence(rng, 40).replace("w", rng.choice("klmn")) for _ in range(300)]
    bad = ["grobnik", "flumpet", "zzorkish"]
    rows = [(i, t if i % 5 else t + f" {rng.choice(bad)} {rng.choice(bad)}") for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(None, 1, 1), (1, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    model = op8_toxicity.fit(table(spark, rows), labels)
    assert {e.text for e in model.entries} == set(bad)
    asked = [(1, "a clean text"), (2, "such a GROBNIK!"), (3, "such a grobmik, you flumpets"), (4, None), (5, ""), (6, "\"grobnik\" is a word"), (None, "zzorkish"), (8, "word " * 30_000 + "flumpet"), (8, "fine")]
    got = {(r.doc_id, r.predicted): r for r in op8_toxicity.score(table(spark, asked), model).collect()}
    assert {k for k in got} >= {(1, 0), (2, 1), (3, 1), (4, 0), (5, 0), (None, 1), (8, 1), (8, 0)}
    six = got.get((6, 0)) or got[6, 1]
    assert six.hits[0]["quoted"] and six.score < got[2, 1].score
    assert got[4, 0].score == got[5, 0].score and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_labels(spark):
    model = op8_toxicity.fit(table(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert op8_toxicity.score(table(spark, [(1, "text")]), model).first().predicted == 0


def test_toxicity_prior_counts_all_labels(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 20).replace("w", rng.choice("klmn")) + (" grobnik" if i % 6 == 0 else "")) for i in range(300)] + [(300, None)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(301)] + [(0, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = op8_toxicity.fit(table(spark, rows), labels, per_label=45)
    assert abs(model.prior - math.log(50.5 / 250.5)) < 1e-9
    got = {r.doc_id: r.predicted for r in op8_toxicity.score(table(spark, [(1, "a clean text"), (2, ""), (3, None), (4, "such a grobnik")]), model).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}


def test_misspellings_are_clean_by_their_rows(spark):
    rng = random.Random(9)
    end = lambda i: " grobnik" * (i % 6 == 0) + " grobmik" * (i in (1, 12, 24)) + " \"grobnix\"" * (i in (2, 3)) + " grobnit" * (i % 12 == 4)
    rows = [(i, sentence(rng, 20).replace("w", rng.choice("klmn")) + end(i)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = op8_toxicity.fit(table(spark, rows), labels)
    assert [e.text for e in model.entries] == ["grobnik"]
    # grobmik: 2 of 50 toxic, 1 of 250 clean rows; grobnix: clean rows quote it; grobnit: 25 clean rows
    assert model.clean == {"grobnit"}
    assert [len(h) for h in op8_toxicity.hits(model, ["grobmik", "grobnix", "grobnit"])] == [1, 1, 0]


def test_misspellings_weigh_by_the_spellings_near(spark):
    rng = random.Random(10)
    near = ["flumpat", "flumpot", "flumput", "flumpit", "flumpett", "flumpeta"]  # clean words, one letter from an entry
    end = lambda i: " grobnik flumpet" * (i % 6 == 0) + " grobnikk" * (i == 6) + (" " + near[i // 6 % 6]) * (i % 6 == 1)
    rows = [(i, sentence(rng, 20).replace("w", rng.choice("klmn")) + end(i)) for i in range(300)]
    model = op8_toxicity.fit(table(spark, rows), spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int"))
    weight = {e.text: e.fuzzy for e in model.entries}
    assert weight["flumpet"] < 0.2 and weight["grobnik"] > 1.5
    got = {r.doc_id: r.predicted for r in op8_toxicity.score(table(spark, [(1, "a flumpef"), (2, "a grobnif grobnix")]), model).collect()}
    assert got[1] == 0


def test_names_of_items_are_hashed(spark, tmp_path):
    spark.createDataFrame([(2, "p q r s t u v w x y"), (10, "p q r")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, [(1, "p q r s t u v w x y z")]).write.parquet(f"{tmp_path}/documents.parquet")
    row = op5_decontaminate.op5_benchmark_decontamination(spark, str(tmp_path)).first()
    assert row.items_sha256 == hashlib.sha256(b"10,2").hexdigest() and (row.n_hit, row.n_items, row.contaminated) == (10, 2, True)
