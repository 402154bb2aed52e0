from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourcelight.operators import fusion, lexical, vector
from sourcelight.operators.ordered import ordered_scan
from sourcelight.operators.segments import SearchIndex
from sourcelight.session import scratch_dir
from sourcelight.sources.files import read_index, read_lengths, write_index

CHUNK = "chunk_id bigint, source_id bigint, version_id bigint, ordinal bigint, display_name string, heading string, body string"


def corpus(spark, seed=1, n=400):
    """A third of all passages hold the word "hot" and a third come from one version."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        body = " ".join(rng.choices(vocabulary, k=rng.randint(3, 25)) + (["hot"] * rng.randint(1, 3) if i % 3 == 0 else []))
        version = 0 if i % 3 == 1 else i
        rows.append((i, version, version, i, f"doc {i}.md", "head w1" if i % 5 == 0 else None, body))
    return rows, spark.createDataFrame(rows, CHUNK)


def bm25(rows, query: str) -> dict[int, float]:
    fields = {"name": 4, "heading": 5, "body": 6}
    words = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "")).lower().split()]
    scores: Counter = Counter()
    for place in fields.values():
        docs = {r[0]: words(r[place]) for r in rows}
        mean = sum(map(len, docs.values())) / len(docs)
        for term, times in Counter(words(query)).items():
            df = sum(term in d for d in docs.values())
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            for key, d in docs.items():
                tf = d.count(term)
                if tf:
                    scores[key] += times * idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return scores


@pytest.mark.parametrize("hot", [None, 5, 60])
def test_lexical_matches_brute_force(spark, hot):
    rows, chunks = corpus(spark)
    asked = ["w1 hot", "hot w2 w3 w3", "w59", "hot", "head doc w7", "nothing here", " "]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query string")
    got: dict[int, list] = {}
    for r in lexical.lexical_search(queries, chunks, 7, hot_postings=hot).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for number, query in enumerate(asked):
        best = sorted(((-round(s, 4), k) for k, s in bm25(rows, query).items()))[:7]
        assert [c for c, _ in got.get(number, [])] == [k for _, k in best], query
        assert [s for _, s in got.get(number, [])] == pytest.approx([-s for s, _ in best], abs=2e-4)


def test_stored_index_and_version_replacement(spark):
    rows, chunks = corpus(spark)
    path = scratch_dir(spark)
    write_index(lexical.build_index(chunks), path, files=3)
    index = read_index(spark, path)
    queries = spark.createDataFrame([(1, "w1 hot w5")], "query_id bigint, query string")
    fresh = [tuple(r) for r in lexical.lexical_scores(queries, lexical.build_index(chunks), 9).orderBy("rank").collect()]
    assert [tuple(r) for r in lexical.lexical_scores(queries, index, 9).orderBy("rank").collect()] == fresh
    lengths = read_lengths(spark, path)
    assert [tuple(r) for r in lexical.lexical_scores(queries, index, 9, lengths=lengths).orderBy("rank").collect()] == fresh
    assert not lexical.index_freshness(index, chunks).first().stale
    changed = chunks.filter("version_id = 0").withColumn("body", F.lit("w1 only"))
    renewed = lexical.replace_versions(index, changed)
    assert lexical.index_freshness(index, chunks.filter("chunk_id > 3")).first().stale
    both = chunks.filter("version_id <> 0").unionByName(changed)
    a = [tuple(r) for r in lexical.lexical_scores(queries, renewed, 9).orderBy("rank").collect()]
    assert a == [tuple(r) for r in lexical.lexical_scores(queries, lexical.build_index(both), 9).orderBy("rank").collect()]


def test_phrases_match_brute_force(spark):
    rows, chunks = corpus(spark)
    rng = random.Random(5)
    phrases = []
    for i in range(60):
        body = rng.choice(rows)[6].split()
        start = rng.randrange(len(body))
        phrases.append((i, " ".join(body[start:start + rng.randint(1, 7)])))
    phrases += [(100, "no such words"), (101, "head w1"), (102, "")]
    df = spark.createDataFrame(phrases, "phrase_id bigint, phrase string")
    got = {tuple(r) for r in lexical.phrase_search(df, chunks).collect()}
    expected = set()
    for number, phrase in phrases:
        words = f" {phrase} " if phrase else None
        for r in rows:
            for field, text in (("display_name", r[4]), ("heading", r[5]), ("body", r[6])):
                tokens = [w for w in "".join(c if c.isalnum() else " " for c in (text or "")).lower().split() if len(w) > 1]
                if words and words in " " + " ".join(tokens) + " ":
                    expected.add((number, r[0], field))
    assert got == expected


@pytest.mark.parametrize("block", [4096, 7])
def test_vector_topk_matches_brute_force(spark, block):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(230, 8)), rng.normal(size=(25, 8))
    v[5] = v[6] = v[7]  # ties go by id
    v[8] = 0.0
    vectors = spark.createDataFrame([(i, i % 9, "m1", x.tolist()) for i, x in enumerate(v)], "chunk_id bigint, version_id bigint, embedding_identity string, vector array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id bigint, vector array<double>")
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    scores = np.round(unit(q) @ unit(v).T, 4)
    got: dict[int, list[int]] = {}
    for r in vector.vector_topk(queries, vectors, 6, block_rows=block, tile_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for i in range(len(q)):
        assert got[i] == sorted(range(len(v)), key=lambda j: (-scores[i, j], j))[:6]


@pytest.mark.parametrize("block", [4096, 3])
def test_vector_topk_with_unusable_vectors(spark, block):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 1.0]), (10, [None, 1.0]), (11, [2.0, 1.0, 0.0]), (12, [-1.0, 0.0])]
    vectors = spark.createDataFrame([(i, 0, "m", v) for i, v in rows], "chunk_id bigint, version_id bigint, embedding_identity string, vector array<double>")
    asked = [(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0] * 7)]
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<double>")
    got: dict[int, list[int]] = {}
    for r in vector.vector_topk(queries, vectors, 3, block_rows=block, tile_rows=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: [1, 9, 8], 2: [11, 3]}


def test_vector_ties_stay_within_k_rows_per_task(spark):
    vectors = spark.range(3000).repartition(2).selectExpr("cast(id as string) as chunk_id", "0 as version_id", "'m' as embedding_identity", "array(1D, 1D) as vector")
    queries = spark.range(20).selectExpr("id as query_id", "array(1D, 1D) as vector")
    assert vector._topk_block(queries, vectors, 5, "query_id bigint, chunk_id string, version_id int, score double").count() <= 2 * 20 * 5
    best = sorted(str(i) for i in range(3000))[:5]
    got = vector.vector_topk(queries, vectors, 5).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got] == best * 20


def test_long_words_are_found(spark):
    word = "x" * 45
    chunks = spark.createDataFrame([(1, 1, 1, "name", None, f"some {word} here"), (2, 2, 2, "name", None, "some other words")], "chunk_id bigint, source_id bigint, version_id bigint, display_name string, heading string, body string")
    hits = lexical.lexical_scores(spark.createDataFrame([(1, word)], "query_id bigint, query string"), lexical.build_index(chunks), 5).collect()
    assert [r.chunk_id for r in hits] == [1]


def test_vector_validation(spark):
    nan = float("nan")
    rows = [("a", 1, [1.0, 0.0]), ("a", 1, [0.5, 0.5]), ("b", 1, [1.0]), ("b", 1, [1.0, 2.0]), ("c", 1, [nan, 1.0]), ("d", 1, [0.0, 0.0]),
            ("e", 1, [1.0, 1.0]), ("e", 2, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "embedding_identity string, batch_id int, vector array<double>")
    got = {(r.embedding_identity, r.batch_id): (r.dimension, r.reason) for r in vector.vector_validate(df).collect()}
    assert got[("a", 1)] == (2, None) and got[("b", 1)][1] == "ragged" and got[("c", 1)][1] == "not_finite"
    assert got[("d", 1)][1] == "zero_norm" and got[("e", 1)][1] is None and got[("e", 2)][1] == "dimension_changed"


def test_embedding_batches(spark):
    assert [vector.batch_size(n) for n in (0, 10**9, 4)] == [32, 64, 4]
    chunks = spark.createDataFrame([(i, f"text {i}", None) for i in range(70)], "chunk_id bigint, body string, embedding_identity string")
    sizes = spark.sparkContext.accumulator(0)

    def model(texts):
        assert len(texts) <= 8
        sizes.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    made = vector.embed_chunks(chunks, model, "m1", batch=8)
    assert made.count() == 70 and sizes.value >= 70
    half = made.filter("chunk_id < 30")
    marked = vector.mark_embedded(chunks, half, "m1")
    assert vector.embedding_pending(marked, "m1").count() == 40
    with pytest.raises(Exception, match="wrong number"):
        vector.embed_chunks(chunks, lambda t: [[1.0]], "m1").collect()
    with pytest.raises(Exception, match="unusable"):
        vector.embed_chunks(chunks, lambda t: [[0.0]] * len(t), "m1").collect()


RANKED = "query_id bigint, chunk_id string, version_id string, score double, rank bigint"


def test_fusion_prefers_shared_passages(spark):
    lex = spark.createDataFrame([(1, "a", "v", 9.0, 1), (1, "s", "v", 8.0, 2)], RANKED)
    vec = spark.createDataFrame([(1, "b", "v", 0.9, 1), (1, "s", "v", 0.8, 2)], RANKED)
    rows = fusion.rrf_fuse(lex, vec).orderBy("rank").collect()
    assert rows[0].chunk_id == "s" and rows[0].lexical_score == 8.0 and rows[0].vector_score == 0.8
    assert rows[0].fused_score == round(2 / 62, 6)


def test_fusion_caps_versions_before_the_limit(spark):
    lex = spark.createDataFrame([(1, f"c{i}", "v1", 1.0, i + 1) for i in range(5)] + [(1, "other", "v2", 0.1, 6)], RANKED)
    rows = fusion.rrf_fuse(lex, lex.limit(0), 10).collect()
    assert sorted(r.chunk_id for r in rows) == ["c0", "c1", "c2", "other"]


HIT = "query_id bigint, query string, rank bigint, score double, source_id bigint, version_id bigint, chunk_id bigint, ordinal bigint, display_name string, heading string, passage string"


def test_rerank_rewards_coverage_and_bounds(spark):
    hits = spark.createDataFrame([(1, "alpha beta", 1, 1.0, 1, 1, 1, 0, "n", None, "nothing"), (1, "alpha beta", 2, 0.8, 2, 2, 2, 0, "n", None, "beta then alpha")], HIT)
    rows = fusion.rerank(hits).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [2, 1] and rows[0].score == pytest.approx(0.55 * 0.8 + 0.35)
    many = spark.createDataFrame([(1, "x", i + 1, 1.0, i, i, i, 0, "n", None, "x y") for i in range(34)], HIT)
    assert fusion.rerank(many).count() == 12
    negative = spark.createDataFrame([(1, "", 1, -1.0, 1, 1, 1, 0, "n", None, "x")], HIT)
    assert fusion.rerank(negative).first().score == 0.0


def test_relevance_gate(spark):
    rows = [(1, "What is alpha?", 1, 0.1, 1, 1, 1, 0, "alpha", None, "no match"), (1, "What is alpha?", 2, 0.1, 1, 1, 2, 1, "n", None, "ALPHA here"),
            (2, "what is the", 1, 0.55, 1, 1, 3, 0, "n", None, "what is the"), (2, "what is the", 2, 0.56, 1, 1, 4, 0, "n", None, "z")]
    kept = fusion.relevance_gate(spark.createDataFrame(rows, HIT)).collect()
    assert sorted(r.chunk_id for r in kept) == [2, 4]


EVIDENCE = "query_id bigint, rank bigint, citation_uri string, source_id bigint, version_id bigint, chunk_id bigint, ordinal bigint, display_name string, heading string, coordinates struct<page:int>, retrieved_at string, passage string"


def pick(rows):
    """The selection rule one hit after another."""
    seen, versions, used, out = set(), Counter(), 0, []
    for r in sorted(rows, key=lambda r: r[1]):
        if len(out) == 12 or r[5] in seen:
            continue
        seen.add(r[5])
        if versions[r[4]] == 3:
            continue
        record = dict(zip(["citation_uri", "source_id", "version_id", "chunk_id", "ordinal", "display_name", "heading", "coordinates", "retrieved_at", "passage"], r[2:]))
        record["coordinates"] = {"page": None}
        size = -(-len(json.dumps(record, separators=(",", ":"), ensure_ascii=False).encode()) // 4)
        if used + size > 1500:
            continue
        used += size
        versions[r[4]] += 1
        out.append(r[1])
    return out


hit_lists = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 40), st.sampled_from([5, 60, 400, 900, 2400])), max_size=50)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(hit_lists, min_size=1, max_size=5))
def test_evidence_selection(spark, lists):
    rows = [
        (q, n + 1, f"u{n}", v, v, c, n, "name", None, (None,), "t", "x" * size)
        for q, hits in enumerate(lists) for n, (v, c, size) in enumerate(hits)
    ]
    got: dict[int, list[int]] = {}
    for r in fusion.select_evidence(spark.createDataFrame(rows, EVIDENCE)).orderBy("query_id", "idx").collect():
        got.setdefault(r.query_id, []).append(r.rank)
    for q in range(len(lists)):
        assert got.get(q, []) == pick([r for r in rows if r[0] == q])


def test_any_number_of_hits_is_taken(spark):
    rows = [(1, n + 1, f"u{n}", n // 4, n // 4, n, n, "n", None, (None,), "t", "x" * (9000 if n < 60 else 5)) for n in range(130)]
    rows += [(2, 1, "u", 1, 1, 1, 1, "n", None, (None,), "t", "x")]
    got: dict[int, list[int]] = {}
    for r in fusion.select_evidence(spark.createDataFrame(rows, EVIDENCE)).orderBy("query_id", "idx").collect():
        got.setdefault(r.query_id, []).append(r.rank)
    assert got == {1: pick([r for r in rows if r[0] == 1]), 2: [1]} and got[1][0] == 61


def test_limits_over_the_bound_are_errors(spark):
    with pytest.raises(ValueError):
        fusion.rerank(spark.createDataFrame([], EVIDENCE), limit=13)


def test_ordered_scan_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(0 if i % 3 else i % 5, rng.randint(0, 300), i, rng.choice([None, i])) for i in range(900)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, id bigint, v bigint")
    out = ordered_scan(df, ["k"], ["t", "id"], rank="rn", lags={"prev": "v"}, carried={"last": "v"}, sums={"total": "id"}, maxes={"high": "id"})
    got = {r.id: (r.rn, r.prev, r["last"], r.total, r.high) for r in out.collect()}
    assert len(got) == 900
    for key in {r[0] for r in rows}:
        prev = last = high = None
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))):
            total += r[2]
            assert got[r[2]] == (n + 1, prev, last, total, high)
            prev, last = r[3], r[3] if r[3] is not None else last
            high = r[2] if high is None else max(high, r[2])


def _found(df):
    return [tuple(r) for r in df.select("query_id", "chunk_id", "version_id", "score", "rank").orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("seeds", [1, 8])
def test_segment_index_through_changes(spark, seeds):
    """Create, replace, remove, compact: after each step searches, postings and statistics are those of a new index."""
    rows, chunks = corpus(spark, n=900)
    queries = spark.createDataFrame([(1, "w1 hot w5"), (2, "hot"), (3, "w3 w3 head doc"), (4, "nothing"), (5, ""), (6, "w7 w8 w9 w10 w11 hot"), (7, "renewed")], "query_id bigint, query string")
    index = SearchIndex.create(chunks, scratch_dir(spark))

    def same(now):
        fresh = lexical.build_index(now)
        assert _found(index.search(queries, 9, seeds=seeds)) == _found(lexical.lexical_scores(queries, fresh, 9))
        columns = ["term", "field", "chunk_id", "version_id", "tf", "len"]
        want, got = lexical.postings(fresh).select(*columns), index.postings().select(*columns)
        assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
        assert not index.freshness(now).first().stale and index.freshness(now.limit(5)).first().stale

    same(chunks)
    before = set(index._live())
    changed = chunks.filter("version_id in (0, 5, 6)").withColumn("body", F.lit("w1 renewed words, hot")).filter("chunk_id % 2 = 0 or version_id = 5")
    index.replace_versions(changed)
    assert before < set(index._live())  # nothing older was written anew
    now = chunks.filter("version_id not in (0, 5, 6)").unionByName(changed)
    same(now)
    index.replace_versions(changed.filter("version_id = 5").withColumn("body", F.lit("w1 w2")), spark.createDataFrame([(6,), (8,), (12345,)], "version_id bigint"))
    now = now.filter("version_id not in (5, 6, 8)").unionByName(changed.filter("version_id = 5").withColumn("body", F.lit("w1 w2")))
    same(now)
    index.compact()
    assert len(index._live()) == 1 and not index._dead()
    same(now)
    index.replace_versions(chunks.filter("version_id = 8"))
    same(now.unionByName(chunks.filter("version_id = 8")))
    again = SearchIndex(spark, index.folder)
    assert again.figures() == index.figures() and _found(again.search(queries, 9)) == _found(index.search(queries, 9))


def test_blocks_stay_closed(spark):
    """Only blocks that can reach the k-th score are opened, ties by smaller id."""
    rows = [(i, i, i, i, f"source-{i}.md", "benchmark", f"passage {i} contains a stable searchable token" + (" unique" if i == 4000 else "")) for i in range(5000)]
    index = SearchIndex.create(spark.createDataFrame(rows, CHUNK), scratch_dir(spark))
    query = spark.createDataFrame([(1, "stable searchable token unique")], "query_id bigint, query string")
    opened = []
    scored = index._scored
    index._scored = lambda blocks, *more: (opened.append(blocks.count()), scored(blocks, *more))[1]
    got = index.search(query, 50).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [4000, *range(49)]
    assert opened[1] <= 8 < 40


def test_phrases_of_one_and_many_words(spark):
    rows, chunks = corpus(spark)
    long = " ".join(f"w{i % 7}" for i in range(20))
    extra = spark.createDataFrame([(9000, 1, 1, 0, "n", "w1 a w2", f"x {long} {long} y"), (9001, 1, 1, 1, "n", None, long[3:]), (9002, 1, 1, 2, "Ünï", None, "w1 w1 w1 w1")], CHUNK)
    phrases = spark.createDataFrame([(1, long), (2, "w1"), (3, "W1, w2!"), (4, "w1 w1 w1"), (5, "ünï"), (6, "a"), (None, "w1"), (7, "w1 missing"), (8, f"{long} {long}")], "phrase_id bigint, phrase string")
    index = SearchIndex.create(chunks.unionByName(extra), scratch_dir(spark))
    index.replace_versions(spark.createDataFrame([(9100, 77, 77, 0, "n", None, f"{long}")], CHUNK))
    held = chunks.unionByName(extra).filter("version_id <> 77").collect()
    texts = [(r.chunk_id, f, " " + " ".join(w for w in "".join(c if c.isalnum() else " " for c in (r[f] or "")).lower().split() if len(w) > 1) + " ") for r in held for f in ("display_name", "heading", "body")] + [(9100, "body", f" {long} ")]
    want = set()
    for p in phrases.collect():
        words = " ".join(w for w in "".join(c if c.isalnum() else " " for c in p.phrase).lower().split() if len(w) > 1)
        want |= {(p.phrase_id, c, f) for c, f, t in texts if words and p.phrase_id is not None and f" {words} " in t}
    found = index.phrases(phrases)
    assert {tuple(r) for r in found.select("phrase_id", "chunk_id", "field").collect()} == want and {1, 2, 3, 4, 5, 8} == {w[0] for w in want}


def test_all_tables_of_a_segment_number_the_same_blocks(spark):
    # With one sampled row per range, two jobs that cut their own ranges would cut them differently.
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        chunks = spark.range(4000).selectExpr("id AS chunk_id", "id AS version_id", "'n' AS display_name", "CAST(NULL AS string) AS heading", "concat('w', id % 7) AS body")
        index = SearchIndex.create(chunks.repartition(8), scratch_dir(spark))
    finally:
        spark.conf.set(key, before)
    rows = index._table("rows", index._live()).select("block", F.explode("entries.chunk_id").alias("chunk_id")).distinct()
    passages = index._passages().select("block", "chunk_id")
    assert rows.count() == passages.count() == 4000
    assert rows.exceptAll(passages).isEmpty() and passages.groupBy("block").count().agg(F.max("count")).first()[0] <= 128


def test_scoring_tasks_follow_the_pairs(spark, monkeypatch):
    # Three words of each passage are asked for by twenty queries: 60 pairs a passage, whatever its bytes.
    monkeypatch.setattr(lexical, "TASK_PAIRS", 1000)
    queries = spark.range(20).selectExpr("id AS query_id", "'alpha beta gamma' AS query")
    chunks = spark.range(500).selectExpr("id AS chunk_id", "id AS version_id", "'n' AS display_name", "CAST(NULL AS string) AS heading", "concat('alpha beta gamma w', id) AS body")
    found = lexical.lexical_scores(queries, lexical.build_index(chunks).localCheckpoint(), 3)
    assert "REPARTITION_BY_NUM" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 30)" in plan
    assert [(r.query_id, r.chunk_id) for r in found.orderBy("query_id", "rank").collect()] == [(q, c) for q in range(20) for c in range(3)]


def test_small_tiles_do_not_multiply_what_is_sent(spark):
    numbers = "array(double(id % 7) + 1, double(id % 5), 1.0D) AS vector"
    rows = spark.range(600).selectExpr("id AS chunk_id", "id AS version_id", "'m' AS embedding_identity", numbers)
    queries = spark.range(600).selectExpr("id AS query_id", numbers)
    tiled = vector.vector_topk(queries, rows, 3, block_rows=20, tile_rows=16)
    plan = tiled._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(?<![#\d_])(59|74)\b", plan)  # one block a side, not 60 and 75, numbered to 59 and 74
    assert tiled.exceptAll(vector.vector_topk(queries, rows, 3)).isEmpty() and tiled.count() == 1800


def test_blocks_of_vectors_grow_with_what_a_group_can_hold():
    # By 2048 and 4096 rows to a block 102 560 vectors were 51 blocks of queries and 26 of vectors, six times as many 301 and 151.
    n = 102_560
    q_blocks, v_blocks = vector.group_blocks(n, 64 * n, n, 64 * n, 10, 48)
    assert q_blocks * v_blocks >= 48 and q_blocks <= 10 and v_blocks <= 7
    q_blocks, v_blocks = vector.group_blocks(6 * n, 6 * 64 * n, 6 * n, 6 * 64 * n, 10, 48)
    assert (q_blocks, v_blocks) == (39, 10)
    assert vector.group_blocks(600, 1800, 600, 1800, 3, 48) == (1, 1) and vector.group_blocks(0, 0, 0, 0, 10, 48) == (1, 1)


def test_pruning_deals_postings_out_once_where_no_query_is_safe(spark):
    chunks = spark.range(60).selectExpr("id AS chunk_id", "id AS version_id", "'name' AS display_name", "cast(NULL AS string) AS heading", "concat('common word', id % 3, if(id = 7, ' rare', '')) AS body")
    queries = spark.createDataFrame([(1, "common word1"), (2, "rare common"), (3, "word2")], "query_id bigint, query string")
    index = lexical.build_index(chunks)
    asked = queries.unionByName(spark.range(300).selectExpr("id + 10 AS query_id", "concat('other', id) AS query"))  # more words than are pushed down
    pruned = lexical.lexical_scores(asked, index, 5, hot_postings=3)
    plan = pruned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") <= 1
    full = lexical.lexical_scores(asked, index, 5)
    assert pruned.exceptAll(full).isEmpty() and full.exceptAll(pruned).isEmpty() and full.count() == 15


def test_blocks_are_gathered_whole_from_any_batches():
    """postings of a block are gathered as its passages come, however these are cut into batches."""
    import pyarrow as pa

    from sourcelight.operators import segments

    r = random.Random(4)
    words = ["aa", "bb", "\x01x", "cc", "\x01y"]
    rows = [{"block": n // 3, "chunk_id": n * 10, "version_id": n % 4, "display_name": ["name"], "heading": [], "body": r.choices(words, k=r.randint(0, 9))} for n in range(50)]
    schema = pa.schema([("block", pa.int64()), ("chunk_id", pa.int64()), ("version_id", pa.int64()), *[(f, pa.list_(pa.string())) for f in segments.FIELDS]])
    expected = {}
    for row in rows:
        for field in segments.FIELDS:
            place = [t for t in row[field] if not t.startswith("\x01")]
            for word in sorted(set(row[field])):
                entry = {"chunk_id": row["chunk_id"], "version_id": row["version_id"], "tf": row[field].count(word), "len": len(row[field]),
                         "positions": [i for i, t in enumerate(place) if t == word]}
                expected.setdefault((row["block"], word.lstrip("\x01"), field), []).append(entry)
    for step in (1, 4, 50):
        batches = [pa.RecordBatch.from_pylist(rows[i:i + step], schema) for i in range(0, len(rows), step)]
        made = [x for b in segments._segment_rows(iter(batches)) for x in b.to_pylist()]
        assert len(made) == len(expected)
        for x in made:
            held = expected[x["block"], x["term"], x["field"]]
            assert x["entries"] == held and x["n"] == len(held) and x["first_id"] == held[0]["chunk_id"]
            assert x["max_tf"] == max(e["tf"] for e in held) and x["min_len"] == min(e["len"] for e in held)


def test_compaction_makes_no_row_of_a_posting(spark, monkeypatch):
    _, chunks = corpus(spark, n=300)
    index = SearchIndex.create(chunks, scratch_dir(spark))

    def refused(*_):
        raise AssertionError("a posting became a row")

    with monkeypatch.context() as m:
        m.setattr("sourcelight.operators.segments.F.explode", refused)
        index.replace_versions(chunks.filter("false"), spark.createDataFrame([(2,), (5,)], "version_id bigint"))
        index.compact()
    columns = ["term", "field", "chunk_id", "version_id", "tf", "len"]
    want = lexical.postings(lexical.build_index(chunks.filter("version_id not in (2, 5)"))).select(*columns)
    got = index.postings().select(*columns)
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_scores_of_a_block_are_summed_where_its_rows_are(spark):
    _, chunks = corpus(spark, n=300)
    index = SearchIndex.create(chunks, scratch_dir(spark))
    index.replace_versions(chunks.filter("version_id = 5"))
    weights = spark.createDataFrame([(1, "hot", "body", 1.0), (2, "w3", "body", 2.0)], "query_id bigint, term string, field string, weight double")
    rows = index._rows(None)
    blocks = rows.select("segment", "block").distinct().crossJoin(weights.select("query_id").distinct())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index._scored(blocks, weights, rows, False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.index("Generate") < plan.index("Exchange")  # nothing is sent after postings became rows
