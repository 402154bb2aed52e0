"""Operators that compare rows with each other: near duplicates, fingerprints, mixing, repeated strings and lines."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import unittest.mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourcelight.llm import components, op2_ngram_join, op3_fingerprint, op4_mix, op9_substrings, op10_lines
from tests.llm.helpers import AZ, awkward, sentence, table, words


def _roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    ids = {x for a, b in links if a != b for x in (a, b)}
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: r for i, r in _roots(range(400), links).items() if i in ids}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_rows_of_one_id_keep_the_links_of_each(spark):
    rng = random.Random(10)
    x, y = sentence(rng, 60), sentence(rng, 60)
    rows = [(3, x), (5, x), (5, y), (9, _edited(rng, y, 1)), (11, sentence(rng, 60))]
    for short in (64, 1):
        got = {r.doc_id: r.component_id for r in op2_ngram_join.similar(table(spark, rows), short=short).collect()}
        assert got == {3: 3, 5: 3, 9: 3, 11: 11}


def _shingles(text, width):
    w = words(text)
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width,percent,short", [(5, 80, 64), (3, 90, 4), (2, 50, 3)])
def test_near_duplicates(spark, width, percent, short):
    rng = random.Random(width * percent + short)
    base = [sentence(rng, n) for n in (9, 10, 11, 12, 20, 40, 80, 200)]
    passage = sentence(rng, 30)
    rows = [(None, base[5])] + [(i, _edited(rng, base[i % 8], rng.choice((0, 0, 1, 1, 2, 3, 8)))) for i in range(90)]
    rows += [(200 + i, sentence(rng, 25) + " " + passage) for i in range(12)] + [(300, base[5].upper()), (300, base[6])] + [(i + 1000 if i is not None else None, t) for i, t in awkward(rng)]
    got = op2_ngram_join.similar(table(spark, rows), width=width, percent=percent, short=short, tile=300, sketches_at_once=7).collect()
    sets = [(i, _shingles(t, width)) for i, t in rows]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t)]
    root = _roots({i for i, _ in rows if i is not None}, links)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter((i, len(s), root.get(i)) for i, s in sets)
    assert len({root[i] for i in root}) < len(root)


@pytest.mark.parametrize("rows_in_batch,held", [(1000, 100_000), (7, 100_000), (7, 20)])
def test_lists_give_no_more_rows_than_postings(rows_in_batch, held):
    # Lists of 2 to 64 sets, each set sent by three tasks.
    lists = {token: list(range(100 * token, 100 * token + n)) for token, n in enumerate((2, 8, 9, 30, 64, 64, 5))}
    rows = [(t, x, 50) for t, members in lists.items() for x in members for _ in range(3)]
    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, ["token", "node", "n"])
    batches = [batch.slice(k, rows_in_batch) for k in range(0, len(rows), rows_in_batch)]
    found = pa.Table.from_batches(op2_ngram_join._paired(80, op2_ngram_join.PAIRED, held)(iter(batches))).to_pylist()
    pairs = {(r["a"], r["b"]) for r in found if r["list"] is None}
    groups = collections.defaultdict(set)
    for r in found:
        if r["list"] is not None:
            groups[r["list"]].add(r["a"])
    assert len(found) <= len(rows)
    for members in lists.values():  # every two sets of a list meet, and no others
        assert set(itertools.combinations(members, 2)) <= pairs or set(members) in groups.values()
    assert all(a // 100 == b // 100 for a, b in pairs) and all(len({x // 100 for x in g}) == 1 for g in groups.values())


def test_sketches_of_lists_join_what_pairs_would():
    rng = np.random.default_rng(5)
    rows, expected = [], []
    for block, n in enumerate((2, 9, 40, 3)):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.integers(0, 25):], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)])) for _ in range(n)]
        sketches = [op2_ngram_join.sketch(x, 80) for x in sets]
        rows += [(str(block), 0, True, 100 * block + k, len(x), s) for k, (x, s) in enumerate(zip(sets, sketches, strict=True))]
        expected += [(100 * block + i, 100 * block + j) for i in range(n) for j in range(i) if op2_ngram_join.near(sketches[i], sketches[j], len(sets[i]), len(sets[j]), 80)]
    table = pa.Table.from_pylist([dict(zip(("block", "part", "alone", "id", "n", "sketch"), r, strict=True)) for r in rows])
    roots = []
    for most in (op2_ngram_join.PAIR_LIST, 1):  # all pairs at once, and set by set
        with unittest.mock.patch.object(op2_ngram_join, "PAIR_LIST", most):
            links = [(r["a"], r["b"]) for b in op2_ngram_join._sketched(80)(iter(table.to_batches(13))) for r in b.to_pylist()]
        assert len(links) < len(rows)
        roots.append(_roots({r[3] for r in rows}, links))
    assert roots[0] == roots[1] == _roots({r[3] for r in rows}, expected)


def test_words_are_those_of_a_split():
    texts = ["a B\x0bc", " é\x85É x", "\ud800 y\x1cz", "w" * 70 + " " + "w" * 70, "", " \n", "aa bb aa bb aa"]
    for width in (1, 2, 5):
        got = list(op2_ngram_join.shingle_sets(texts, width))
        split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        sets = [{tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for w in split]
        assert [len(x) for x in got] == [len(x) for x in sets]
        assert [[len(np.intersect1d(x, y)) for y in got] for x in got] == [[len(x & y) for y in sets] for x in sets]


def test_near_duplicates_kept_once(spark):
    rng = random.Random(9)
    text = sentence(rng, 60)
    rows = [(1, text), (2, _edited(rng, text, 1)), (3, sentence(rng, 60)), (None, text), (4, None), (5, "")]
    kept = op2_ngram_join.keep_first(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "None"]
    assert op2_ngram_join.similar(table(spark, [])).count() == 0


def test_search_finds_what_reaches_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(150):
        percent = int(rng.choice((50, 80, 90)))
        base = np.unique(rng.integers(0, 60, 30).astype(np.uint64))
        members = [np.unique(np.where(rng.random(len(base)) < 0.1, rng.integers(0, 90, len(base)).astype(np.uint64), base)) for _ in range(int(rng.integers(1, 20)))]
        got = op2_ngram_join.Index(members, percent).search(base).tolist()
        assert got == [i for i, m in enumerate(members) if 100 * len(np.intersect1d(base, m)) >= percent * len(np.union1d(base, m))]


def test_sets_meet_in_what_they_send():
    rng = np.random.default_rng(3)
    for _ in range(600):
        percent = int(rng.choice((50, 80, 90)))
        base = np.unique(rng.integers(0, 2**40, int(rng.integers(2, 150))).astype(np.uint64))
        other = np.unique(np.where(rng.random(len(base)) < (100 - percent) / 220, rng.integers(0, 2**40, len(base)).astype(np.uint64), base))
        every = np.union1d(base, other)
        frequent = every[rng.random(len(every)) < rng.choice((0, 0.3, 0.5, 0.6, 0.95))]
        if 100 * len(np.intersect1d(base, other)) >= percent * len(every):
            sent = [x[op2_ngram_join.signature(x, frequent, percent)] for x in (base, other)]
            assert len(np.intersect1d(*sent))
            assert op2_ngram_join.near(op2_ngram_join.sketch(base, percent), op2_ngram_join.sketch(other, percent), len(base), len(other), percent)


def _likeness(a, b):
    a, b = (collections.Counter(w for w in words_as_they_are(t)) for t in (a, b))
    if not a or not b:
        return float(not a and not b)
    return sum((a & b).values()) / sum((a | b).values())


def words_as_they_are(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_fingerprints(spark):
    rng = random.Random(4)
    rows = [(i * 7, sentence(rng, rng.randrange(20, 400), rng.choice((30, 300)))) for i in range(40)] + [(500, "é" * 9 + " ab"), (501, None), (502, ""), (503, " "), (504, "x"), (505, "same"), (505, "same"), (None, "one two"), (506, "x")]
    got = op3_fingerprint.fingerprints(table(spark, rows)).collect()
    assert len(got) == len(rows)
    keyed = sorted({i: t or "" for i, t in rows if i is not None}.items())
    after = {i: keyed[(k + 1) % len(keyed)][1] for k, (i, _) in enumerate(keyed)}
    texts = dict(keyed) | {None: "one two"}
    errors = []
    for r in got:
        t = texts[r.doc_id]
        h = len(t) // 2
        e = t[:len(t) - h] + after.get(r.doc_id, "")[:h]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        errors += [r.near_edited - _likeness(t, e), r.near_next - _likeness(t, after[r.doc_id]) if r.doc_id is not None else 0.0]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.sqrt(np.mean(np.square(errors))) < 0.1 and abs(np.mean(errors)) < 0.03
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[""] == {""} and op3_fingerprint.fingerprints(table(spark, [])).count() == 0


def test_fingerprint_of_the_only_row(spark):
    r = op3_fingerprint.fingerprints(table(spark, [(3, "abcdef gh")])).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdeabcd").hexdigest()


def test_mixture(spark):
    rows = [(i, "t" * (1 + i % 7), "en", ["a", "a", "b", None, "zero"][i % 5]) for i in range(2000)] + [(i, None, "en", "void") for i in range(5000, 5400)] + [(None, "x", "en", "a"), (1, "tt", "en", "b")]
    docs = table(spark, rows)
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 1.0), ("void", 1.0)], "source string, weight double")
    got = op4_mix.mix(docs, weights=weights)
    assert got.columns == [*docs.columns, "copy"]
    out = got.collect()
    mass = collections.Counter()
    for r in out:
        mass[r.source] += len(r.text or "")
    total = sum(len(r[1] or "") for r in rows)
    assert "zero" not in mass and abs(sum(mass.values()) / total - 1) < 0.1
    assert abs(mass["b"] / sum(mass.values()) - 0.6) < 0.05 and abs(mass["a"] / sum(mass.values()) - 0.2) < 0.04
    assert 300 < sum(r.source == "void" for r in out) < 500
    copies = collections.Counter(r.doc_id for r in out if r.source == "b" and r.doc_id != 1)
    rate = 0.6 * total / sum(len(r[1]) for r in rows if r[3] == "b")
    held = collections.Counter(copies[r[0]] for r in rows if r[3] == "b" and r[0] != 1)
    import math
    for k in range(6):  # the numbers of copies follow the Poisson distribution
        assert abs(held[k] / 400 - math.exp(-rate) * rate**k / math.factorial(k)) < 0.08
    key = lambda df: sorted((str(r.doc_id), str(r.source), r.copy) for r in df.collect())
    assert key(op4_mix.mix(docs.repartition(7), weights=weights)) == key(got)
    assert op4_mix.mix(table(spark, [])).count() == 0


def test_cdf_of_large_rates(spark):
    row = spark.range(1).select(op4_mix.poisson_cdf(F.lit(2000.0)).alias("c")).first()
    assert abs(row.c[-1] - 1) < 1e-9 and abs(row.c[2000] - 0.5059) < 0.01


def _removed(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data):
        hit = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if count[d[p:p + length]] > 1:
                hit[p:p + length] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((str(i), len(d), int(hit.sum()), runs, hashlib.sha256(bytes(b for b, h in zip(d, hit) if not h)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,hot", [(40, 50_000), (40, 2), (9, 3), (64, 10)])
def test_repeated_strings(spark, monkeypatch, length, hot):
    rng = random.Random(length + hot)
    passage, other = sentence(rng, 30), "é日" * 40
    rows = [(i, sentence(rng, rng.randrange(1, 40)) + " " + (passage[rng.randrange(40):rng.randrange(60, 150)] if i % 2 else "") + sentence(rng, 10)) for i in range(30)]
    rows += [(100, passage), (101, passage), (101, passage), (102, other), (103, "x" + other), (104, "ab" * 200), (105, "abc" * 100 + passage + passage), (106, "y" * 39), (107, "y" * 40), (108, passage[:length]), (109, passage[:length - 1])]
    rows += [(None if i is None else i + 2000, t[:3000] if t else t) for i, t in awkward(rng)]
    monkeypatch.setattr(op9_substrings, "SEGMENT", 500)
    got = op9_substrings.remove_repeated(table(spark, rows), length=length, hot=hot).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _removed(rows, length)
    assert op9_substrings.remove_repeated(table(spark, []), length=length).count() == 0


def _line_rows(rng):
    common = [f"Line number {k} that many documents share, with enough characters" for k in range(4)]
    rows = [(i, "\n".join(rng.choice(["  " + c.upper() + "\t", c, "own line " + sentence(rng, 8), "short", ""]) for c in rng.sample(common, 3))) for i in range(40)]
    return rows + awkward(rng) + [(60, common[0] + "\n" + common[0]), (61, common[0] + "\r"), (62, "é" * 39 + "\n" + "é" * 40)] + [(70 + i, "é" * 40 + "\n" + "é" * 39) for i in range(5)]


def _dropped(rows, least=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < least or max(held[key(x)]) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def _shown(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_repeated_lines(spark):
    rows = _line_rows(random.Random(5))
    docs = table(spark, rows)
    assert _shown(op10_lines.drop_lines(docs, op10_lines.build_state(docs))) == _dropped(rows)
    empty = table(spark, [])
    assert op10_lines.drop_lines(empty, op10_lines.build_state(empty)).count() == 0


def test_lines_come_and_go(spark):
    rows = _line_rows(random.Random(6))
    first, second = rows[::2], rows[1::2]
    state = op10_lines.build_state(table(spark, first))
    state = op10_lines.insert(state, table(spark, second))
    state = op10_lines.insert(state, table(spark, second))  # again: nothing changes
    assert _shown(op10_lines.drop_lines(table(spark, rows), state)) == _dropped(rows)
    gone = {i for i, _ in rows if i is not None and i % 3 == 0}
    state = op10_lines.delete(state, spark.createDataFrame([(i,) for i in sorted(gone)] + [(None,), (10**6,)], "doc_id long"))
    rest = [r for r in rows if r[0] not in gone]
    assert _shown(op10_lines.drop_lines(table(spark, rest), state)) == _dropped(rest)
    again = op10_lines.build_state(table(spark, rest))
    assert sorted(map(tuple, state.refs.collect())) == sorted(map(tuple, again.refs.collect()))
    state = op10_lines.insert(state, table(spark, [r for r in rows if r[0] in gone]))
    assert _shown(op10_lines.drop_lines(table(spark, rows), state)) == _dropped(rows)


def test_deleted_lines_leave_others_in_grown_filters(spark):
    pool = [f"line {i} of a pool that is long enough to count as one" for i in range(150_000)]
    keys = np.array([op10_lines._digest(op10_lines.line_key(x.encode()))[0] for x in pool])
    small, large = (op10_lines.Cuckoo(np.zeros((n, 4), np.uint16))._places(keys) for n in (16, 32))
    low = lambda places: np.minimum(places[1], places[2])
    alike = collections.defaultdict(list)  # the same in 16 buckets, not in 32
    for i, k in enumerate(zip(small[0].tolist(), low(small).tolist())):
        alike[k].append(i)
    pairs = [(a, b) for v in alike.values() for a in v for b in v if low(large)[a] != low(large)[b] and keys[b] > 2**63 - 2**59][:12]
    assert len(pairs) == 12
    further = [f"further line {i} that is long enough to count as one" for i in range(118)]
    early = "\n".join([pool[a] for a, _ in pairs] + further[:28])
    late = "\n".join([pool[b] for _, b in pairs] + further[28:])
    state = op10_lines.build_state(table(spark, [(1, early), (2, early)]), least=2)
    state = op10_lines.insert(state, table(spark, [(3, late), (4, late)]))
    state = op10_lines.delete(state, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    rest = table(spark, [(3, late), (4, late)])
    again = op10_lines.build_state(rest, least=2)
    assert state.shards == 1 and sorted(map(tuple, state.refs.collect())) == sorted(map(tuple, again.refs.collect()))
    want = _shown(op10_lines.drop_lines(rest, again))
    assert [n for _, _, n, _ in want] == [102, 0] and _shown(op10_lines.drop_lines(rest, state)) == want


def test_cuckoo_filter():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(-2**62, 2**62, 5000))
    filter_ = op10_lines.Cuckoo.sized(len(keys))
    left = filter_.insert(keys)
    inside = keys[~np.isin(keys, left)]
    assert len(left) < 100 and filter_.contains(inside).all()
    other = rng.integers(-2**62, 2**62, 20_000)
    assert filter_.contains(other).mean() < 0.002
    assert filter_.delete(inside[:2500]).all() and filter_.contains(inside[2500:]).all()
    assert filter_.contains(inside[:2500]).mean() < 0.01
    tiny = op10_lines.Cuckoo.sized(4)
    full = tiny.insert(keys[:100])
    assert len(full) and tiny.contains(keys[:100][~np.isin(keys[:100], full)]).all()
