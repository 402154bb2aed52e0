from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourcelight import constants as K
from sourcelight.functions import text as X
from sourcelight.operators import chunking
from sourcelight.sources.files import path_in_root


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first()["o"]


def model_chunks(text: str) -> list[dict]:
    """The definition, word by word: windows of 500 words, 75 of them shared."""
    spans, start = [], None
    for i, ch in enumerate(text):
        if ch.isspace():
            if start is not None:
                spans.append((start, i))
                start = None
        elif start is None:
            start = i
    if start is not None:
        spans.append((start, len(text)))
    out, first = [], 0
    while first < len(spans):
        last = min(first + 500, len(spans))
        a, b = spans[first][0], spans[last - 1][1]
        heading = None
        for line in reversed(text[:a].split("\n")):
            if line.lstrip().startswith("#"):
                heading = line.strip().lstrip("#").strip() or None
                break
        out.append({
            "ordinal": len(out), "body": text[a:b], "char_start": a, "char_end": b,
            "byte_start": len(text[:a].encode()), "byte_end": len(text[:b].encode()),
            "line_start": text[:a].count("\n") + 1, "line_end": text[:b].count("\n") + 1, "token_count": last - first, "heading": heading,
        })
        if last == len(spans):
            break
        first = last - 75
    return out


def check_chunks(spark, texts: list[str]) -> None:
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got: dict[int, list[dict]] = {i: [] for i in range(len(texts))}
    for row in chunking.chunk_text(df, headings=True).orderBy("id", "ordinal").collect():
        d = row.asDict()
        got[d.pop("id")].append(d)
    for i, text in enumerate(texts):
        assert got[i] == model_chunks(text), repr(text[:80])


def test_chunk_sizes_and_overlap(spark):
    words = [f"token{i}" for i in range(1100)]
    chunks = model_chunks(" ".join(words))
    assert [c["token_count"] for c in chunks] == [500, 500, 250]
    assert chunks[0]["body"].split()[-75:] == chunks[1]["body"].split()[:75]
    check_chunks(spark, [" ".join(words)])


def test_chunk_edges(spark):
    words = lambda n: " ".join(f"é{i}" for i in range(n))
    check_chunks(spark, [
        "", "   ", "a", " \n a  b \n", words(499), words(500), words(501), words(575), words(576), words(925), words(926), words(1000),
        "# Top\n" + words(600) + "\n  ## Inner part \n" + words(600) + "\n#\n" + words(600), "x# no heading\n" + words(900),
        "a b　c" * 300,
    ])


words_of = st.lists(st.sampled_from(["a", "bb", "é", "#", "#x", "\n", "\n# h", "  ", "\t", "𝒳", "\n\n"]), max_size=1800)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(words_of, min_size=1, max_size=4))
def test_chunks_match_the_definition(spark, lists):
    check_chunks(spark, [" ".join(w) for w in lists])


def test_pages(spark):
    df = spark.createDataFrame([(1, "one\f\ftwo words\f"), (2, ""), (3, " \f ")], "id bigint, text string")
    pages = [(r.id, r.page, r.body) for r in chunking.chunk_pages(df).orderBy("id", "page").collect()]
    assert pages == [(1, 1, "one"), (1, 3, "two words")]
    cover = {r.id: (r.pages, r.blank_pages, r.has_embedded_text) for r in chunking.page_text_coverage(df).collect()}
    assert cover == {1: (3, 1, True), 2: (1, 1, False), 3: (2, 2, False)}


def test_normalize_text(spark):
    assert one(spark, "﻿a\r\nb\rc\n﻿", X.normalize_text) == "a\nb\nc\n﻿"


def test_tokens(spark):
    text = "The Éclair, a 12x b-C naïve! ÉCLAIR"
    assert one(spark, text, X.normalized_tokens) == "the éclair 12x naïve éclair"
    assert sorted(one(spark, text, X.token_set)) == sorted(["the", "éclair", "12x", "naïve"])
    assert one(spark, text, X.meaningful_terms) == ["éclair", "12x", "naïve"]
    assert one(spark, "x " + "y" * 40 + " " + "z" * 39, X.index_tokens) == ["x", "y" * 40, "z" * 39]


def test_uri_round_trip(spark):
    for path in ["/a b/é%+~._-x", "/plain", "/tab\tand#?&"]:
        uri = one(spark, path, X.file_uri)
        expected = "file://" + "".join(chr(b) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "/-_.~") else f"%{b:02X}" for b in path.encode())
        assert uri == expected
        assert one(spark, uri, X.file_path) == path
    assert one(spark, "http://x", X.file_path) is None


def test_truncate(spark):
    for text in ["", "abc", "é" * 10, "a𝒳b𝒳", "漢字かな"]:
        for limit in range(0, 14):
            cut = text.encode()[:limit].decode(errors="ignore")
            assert one(spark, text, lambda c: X.truncate_utf8(c, limit)) == cut


def test_mime(spark):
    cases = [
        ("a.txt", b"%PDF-1.7", "application/pdf"), ("a", b"\x89PNG\r\n\x1a\nxx", "image/png"), ("a", b"\xff\xd8\xffx", "image/jpeg"),
        ("a", b"GIF89a", "image/gif"), ("a", b"RIFF1234WEBPVP8", "image/webp"), ("a", b"II*\x00", "image/tiff"), ("a", b"MM\x00*", "image/tiff"),
        ("a.md", b"PK\x03\x04", "application/zip"), ("/x.y/A.MD", b"hi", "text/markdown"), ("b.unknown", b"hi", "text/plain"),
        ("b.bin", b"a\x00b", "application/octet-stream"), ("b", b"\xc3", "application/octet-stream"), (".md", b"\x00", "application/octet-stream"),
        ("c.json", b"\x00", "application/json"), ("cut.bin", b"a" * 511 + "é".encode(), "application/octet-stream"),
    ]
    df = spark.createDataFrame([(p, bytearray(c), m) for p, c, m in cases], "p string, c binary, m string")
    for row in df.select("p", "m", X.mime_type("p", "c").alias("o")).collect():
        assert row.o == row.m, row.p


def test_citations(spark):
    good = "evidence://source/s-1/version/v2#chunk-7"
    row = one(spark, good, X.parse_citation)
    assert (row.source_id, row.version_id, row.ordinal) == ("s-1", "v2", 7)
    for bad in ["", "other://source/a/version/b#chunk-1", good + "x", "evidence://source/a/version/b", "evidence://source/a/version/b#chunk-", "evidence://source/a#chunk-1"]:
        assert one(spark, bad, X.parse_citation) is None


def test_path_in_root(spark):
    df = spark.createDataFrame([("/r/a",), ("/r",), ("/rx/a",), ("/r/../etc",)], "path string")
    got = {r.path: r.reason for r in path_in_root(df, "/r/").collect()}
    assert got["/r/a"] is None and got["/r"] is None and got["/rx/a"] == "outside_root"
    dots = spark.createDataFrame([("/r/../etc",), ("/r/./a",), ("/r/..",), ("/r/..a/b",), ("/r/a..",)], "path string")
    got = {r.path: r.reason for r in path_in_root(dots, "/r").collect()}
    assert got == {"/r/../etc": "outside_root", "/r/./a": "outside_root", "/r/..": "outside_root", "/r/..a/b": None, "/r/a..": None}


def test_word_lists():
    assert len(K.STOP_WORDS) == len(set(K.STOP_WORDS))
    assert len(K.DIRECT_PREDICATES) == 12


def _heading_of(text: str, start: int) -> str | None:
    """The nearest heading line before ``start``, by looking at every line."""
    found, at = None, 0
    for line in text.split("\n"):
        bare = line.lstrip()
        if bare.startswith("#") and at + len(line) - len(bare) < start:
            found = bare[:start - (at + len(line) - len(bare))]
        at += len(line) + 1
    return (found.lstrip("#").strip() or None) if found is not None else None


def test_headings_over_many_passages(spark):
    rng = random.Random(11)
    texts = ["# only heading", "", "   \n# a\n", "#", "word " * 900, "#" + " word" * 2000, "x\n  # b " + "long " * 1300 + "\n#\n" + "y " * 500]
    for _ in range(25):
        parts = []
        for i in range(rng.randrange(400)):
            parts.append(rng.choice(["word ", "two words ", "\n# head %d \n" % i, "\n   ## é %d" % i, "\n", "#no ", "\n#\n", "\t", "\n# open " + "w " * rng.randrange(600), "x" * 30 + " "]) * rng.randrange(1, 4))
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = chunking.chunk_text(df, headings=True).collect()
    assert len(rows) > 60 and sum(r.heading is not None for r in rows) > 20
    for r in rows:
        assert r.heading == _heading_of(texts[r.id], r.char_start), (r.id, r.ordinal)


def test_prefix_sums(spark):
    sizes = [0, 1, 255, 256, 257, 1000]
    df = spark.createDataFrame([(n, [i * i % 7 for i in range(n)]) for n in sizes], "n int, v array<bigint>")
    for r in df.select("n", "v", chunking.prefix_sums(F.col("v")).alias("s")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(r.n)]


def test_white_space_is_that_of_the_pattern(spark):
    """ends are trimmed by a list of characters, which has to be the pattern's own."""
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    assert {r.c for r in df.filter(F.col("c").rlike(r"(?U)\s")).collect()} == set(X.WHITE)
    assert one(spark, "  a b 　\x85", X.strip_ws) == "a b"
    assert "regexp" not in str(X.strip_ws("v")) and "char_length" not in str(X.newlines("v"))
    assert one(spark, "é\n\nü\n", X.newlines, "string") == 3
