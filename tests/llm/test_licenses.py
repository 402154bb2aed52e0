"""License scans against a plain version that compares every two detections."""

from __future__ import annotations

import random
import re

import pytest

from sourcelight.llm import op13_license
from sourcelight.llm.op13_rules import rules
from tests.llm.helpers import AZ, awkward, sentence, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, found=None):
    """(n_words, base places, kept detections) by the rules' definition."""
    found = rules() if found is None else found
    ws = WORD.findall((text or "").translate(AZ))
    joined = " " + " ".join(ws) + " "
    base = [(i, i + len(p.split()) - 1, label) for p, label in op13_license.PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    hits = []
    for r in found:
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined):
            first = joined[:m.start()].count(" ") - 1
            hits.append((first, first + m.group().count(" "), r.priority, r.number, r.label))
    def over(a, b):
        longer = (b[1] - b[0]) - (a[1] - a[0])
        return a != b and b[0] <= a[0] and a[1] <= b[1] and (b[2] < a[2] or b[2] == a[2] and (longer > 0 or longer == 0 and b[3] < a[3]))
    return len(ws), sorted(base), sorted(h for h in hits if not any(over(h, b) for b in hits))


def _same(rows, got):
    want = sorted(repr(plain(t)) for _, t in rows)
    have = sorted(repr((r.n_words, sorted(tuple(p) for p in r.phrases), [tuple(d)[:5] for d in r.licenses])) for r in got)
    assert have == want


def test_rules_hold_their_keywords():
    table_ = rules()
    assert len(table_) > 250 and len({(r.kind, r.pattern, r.label) for r in table_}) == len(table_)
    for r in table_:
        assert re.search(rf"(?<![a-z0-9]){r.keyword}(?![a-z0-9])", re.sub(r"\((?:\?:)?[^()]*\)\?", "", r.pattern)), r
        assert not re.search(r"[*+]", r.pattern.replace(r"\S+", "")), r  # every match is bounded


def _samples(rng):
    """A text that each rule may have been written for: its pattern with the choices taken at random."""
    for r in rules():
        text = r.pattern
        while "(" in text:
            def pick(m):
                if m.group(2) in ("?",) and rng.random() < 0.5:
                    return ""
                return rng.choice(m.group(1).split("|")) * (int(m.group(2)[1]) or 1 if m.group(2).startswith("{") else 1)
            new = re.sub(r"\(\?:([^()]*)\)(\?|\{\d,\d+\})?", lambda m: pick(_Pair(m)), text)
            assert new != text
            text = new
        text = text.replace(r"\S+", "word").replace(r"\d", "3").replace("[cs]", "c")
        text = re.sub(r"(.)\?", lambda m: m.group(1) if rng.random() < 0.5 else "", text)
        yield r, re.sub(r" +", " ", text).strip()


class _Pair:
    def __init__(self, m):
        self.m = m

    def group(self, i):
        return self.m.group(i) or ""


def test_scan_finds_every_rule_and_suppresses(spark):
    rng = random.Random(3)
    rows, k = [], 0
    samples = list(_samples(rng))
    for r, text in samples:
        hits = [m for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", f" {text} ")]
        assert hits, (r, text)
        rows.append((k, f"{sentence(rng, 5)} {text.upper() if k % 3 else text}. {sentence(rng, 3)}"))
        k += 1
    for _ in range(60):  # several together, side by side and split by punctuation
        picked = rng.sample(samples, 4)
        rows.append((k, ", ".join(re.sub(" ", lambda m: rng.choice([" ", " ", "-", "\n  * "]), t) for _, t in picked)))
        k += 1
    got = op13_license.scan(table(spark, rows)).collect()
    _same(rows, got)
    kept = [len(r.licenses) for r in got]
    assert min(kept) >= 1 and max(kept) > 1


def test_suppression(spark):
    text = "GNU General Public License version 3 and the MIT License; GNU General Public License"
    (row,) = op13_license.scan(table(spark, [(1, text)])).collect()
    assert [(d.first, d.last, d.label) for d in row.licenses] == [(0, 5, "gpl-3.0"), (7, 9, "mit"), (10, 13, "gpl")]
    assert sorted(tuple(p) for p in row.phrases) == [(0, 3, "gpl"), (8, 9, "mit"), (10, 13, "gpl")]


def test_awkward_rows(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["mit license", "the MIT License,", "GNU General Public License v3", "apache license", "CC BY", "cc by sa 4 0", "word", "Ünï"]) for _ in range(4000))
    rows = [*awkward(rng), (50, long), (51, "MIT LICENSEmit license"), (52, "mit license mit license"), (53, "mit\x00license\x01mit\x02 license"), (54, "cc by, cc-by; CC\nBY"), (55, "mit licénse mit license"), (None, "cc by")]
    got = op13_license.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    _same(rows, got)
    assert op13_license.scan(table(spark, rows).filter("false")).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = {r.doc_id: r for r in op13_license.op13_license_scan(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    weights = [r.weight for r in rules()]
    assert len(docs) == len(got)
    for d in docs:
        n, base, kept = plain(d.text)
        r = got[d.doc_id]
        starts = [b[0] for b in base]
        labels = {b[2] for b in base}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and r.labels == ",".join(sorted(labels | {h[4] for h in kept}))
        assert r.score == max((weights[h[3]] for h in kept), default=0.0) and 0 <= r.score <= 1
    assert any(r.n_base for r in got.values())
