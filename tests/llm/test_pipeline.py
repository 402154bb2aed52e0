"""Registered queries against SQL, and the pipeline against a plain version of its stages."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re

import duckdb
import pytest

import corpus_pipeline
from sourcelight.llm import op4_mix, registry
from tests.llm.helpers import AZ, sentence, words

DIR = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


@given
@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = registry.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert collections.Counter(map(tuple, df.select(*columns).collect())) == collections.Counter(map(tuple, result.fetchall()))


@given
@pytest.mark.parametrize("name", ["op1_token_counts", "op6_language_id", "op7_html_text", "op8_toxicity"])
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, DIR)
    rows = df.collect()
    if name == "op6_language_id":
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
        held = [r for r in rows if r.held_out]
        assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert rows


def _plain(docs: list[tuple], items: list[str]) -> collections.Counter:
    docs = [d for d in docs if d[1] and re.search(r"[^\W\d_]", d[1])]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    held = collections.defaultdict(set)
    for i, t, _ in docs:
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    docs = [(i, "\n".join(x for x in t.split("\n") if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i), s) for i, t, s in docs]
    sets = [(i, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for i, t, _ in docs]
    parent = {i: i for i, _, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    docs = [d for d in docs if find(d[0]) == d[0]]
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(AZ))
    windows = {tuple(w[p:p + min(10, len(w))]) for w in map(split, items) for p in range(len(w) - min(10, len(w)) + 1)}
    leaks = lambda w: any(tuple(w[p:p + k]) in windows for k in {len(v) for v in windows} for p in range(len(w) - k + 1))
    docs = [d for d in docs if not leaks(split(d[1]))]
    mass = collections.Counter()
    for _, t, s in docs:
        mass[s] += len(t.encode())
    total, weight = sum(mass.values()), sum(m**op4_mix.POWER for m in mass.values() if m)
    out = collections.Counter()
    for i, t, s in docs:
        rate = total * mass[s]**op4_mix.POWER / weight / mass[s] if mass[s] else 1.0
        u = (int(hashlib.md5(f"{op4_mix.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c < u:
            n += 1
            p *= rate / n
            c += p
        out.update((i, t, copy) for copy in range(1, n + 1))
    return out


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    letters = lambda text: text.translate(str.maketrans("0123456789", "abcdefghij"))
    shared = [letters(f"A line that many documents share, number {k}, of some length") for k in range(3)]
    items = [letters(sentence(rng, 25)) for _ in range(4)] + ["short item"]
    docs = []
    for i in range(120):
        text = letters(sentence(rng, rng.randrange(20, 80)))
        if i % 4 == 0:
            text += "\n" + rng.choice(shared) + "\n" + letters(sentence(rng, 5))
        if i % 9 == 0:
            text += " " + " ".join(items[i % 4].split()[3:15])
        if i % 7 == 0 and docs:
            other = docs[rng.randrange(len(docs))][1].split(" ")
            other[len(other) // 2] = "changed"
            text = " ".join(other)
        docs.append((i, text, f"s{i % 3 if i % 2 else 0}"))
    docs += [(500, "12 34 !?", "s0"), (501, "", "s1"), (502, None, "s1"), (503, shared[0], "s9"), (504, "Short  ITEM", "s9")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    rows = got.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    assert collections.Counter((r.doc_id, r.text, r.copy) for r in rows) == _plain(docs, items)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
