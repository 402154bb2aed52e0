"""Cross-tokenizer alignment against a plain version that compares every two tokens of a text."""

from __future__ import annotations

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sourcelight.llm import op11_alignment as op
from tests.llm.helpers import awkward, sentence, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _decoded(token):
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return bytes(chars[c] for c in token)


@pytest.fixture(scope="module")
def encoders():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)

    def both(text):
        e = first.encode(" " + text, add_special_tokens=False)
        pieces = second.encode(text, out_type=str)
        ids = second.encode(text)
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(ids, pieces, strict=True)]
        return [(i, _decoded(t)) for i, t in zip(e.ids, e.tokens, strict=True)], b

    return both


def plain(encoders, rows):
    docs, holds = [], collections.Counter()
    for key, text in rows:
        groups = []
        if text:
            a, b = encoders(text)
            if b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
                p = q = 0
                while p < len(a):
                    ga, gb, x, y = [], [], 0, 0
                    while not ga or x != y:
                        if x <= y:
                            ga.append(a[p][0])
                            x, p = x + len(a[p][1]), p + 1
                        else:
                            gb.append(b[q][0])
                            y, q = y + len(b[q][1]), q + 1
                    groups.append((ga, gb))
                assert q == len(b)
        links = [(i, j) for ga, gb in groups for i in ga for j in gb]
        holds.update(set(links))
        docs.append((key, groups, links))
    most = collections.defaultdict(int)
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    out = []
    for key, groups, links in docs:
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), hashlib.sha256(written.encode()).hexdigest() if groups else "",
                    sum(holds[p] == most[p[0]] for p in links), sum(holds[p] for p in links)))
    return sorted(out, key=repr)


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def _rows(found, key="doc_id"):
    return sorted((tuple(r[c] for c in (key, *COLUMNS)) for r in found.collect()), key=repr)


@pytest.mark.parametrize("block_bytes,joined_rows", [(1 << 20, 1_000_000), (30_000, 2_000)])
def test_against_plain(spark, encoders, block_bytes, joined_rows):
    rng = random.Random(6)
    rows = [*awkward(rng), (20, "Hello  world<|endoftext|></s>  "), (21, "a\t\n\n b\r\n"), (22, "日本語🙂🙂 ﬁ é ½ naïve"), (23, "▁a ▁"), (24, " "), (25, "\x00\x01"), (26, "ab" * 3000), (27, "<0x41>"), (28, "🙂" * 40), (29, "x" + " " * 500 + "y")]
    words = ["the", "cat", "Über", "naïveté", "12345", "--", "(x)", "日本", "🙂", "\n", "running", "don't"]
    rows += [(40 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(200, sentence(rng, 8000)), (201, " ".join(rng.choice(words) for _ in range(9000)))]  # cut into parts
    want = plain(encoders, rows)
    assert _rows(op.alignment(table(spark, rows), A, B, block_bytes=block_bytes, joined_rows=joined_rows)) == want
    assert sum(r[4] for r in want) > 0 and any(r[6] < r[4] for r in want)


def test_empty_table(spark):
    assert _rows(op.alignment(table(spark, [(1, "x")]).filter("false"), A, B)) == []
    assert _rows(op.alignment(table(spark, [(1, None), (2, "")]), A, B)) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


def test_query(spark, encoders):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert _rows(op.op11_cross_tokenizer(spark, folder)) == plain(encoders, [(d.doc_id, d.text) for d in docs])


def test_ranks_give_the_ids_of_the_file():
    """Every character next to letters, digits, blanks and marks, and random mixtures of them."""
    ranked, read = op._ranked(A), op._read(A)
    assert ranked is not None and op._ranked(public_tokenizers.path("word_bpe_49k.json")) is None
    rng = random.Random(12)
    texts = [f" a{c}b{c} 1{c}2 {c}{c} .{c}! {c}\n {c}x's" for c in map(chr, [*range(0x3000), *range(0xD800 - 500, 0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x20000)])]
    some = ["a", "'s", " ", "  ", "\n", "\t", "é", "日", "🙂", "1", "½", "́", " ", " ", "<|endoftext|>", "'LL", "...", "word"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert ranked(texts) == read(texts)
