from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from sourcelight import constants as K
from sourcelight.operators import claims as C
from sourcelight.operators import dossiers as D
from sourcelight.operators.catalog import open_citations
from sourcelight.plans.inputs import Inputs

GIVEN = "/root/testdata/sf0.001"

NOW = dt.datetime(2024, 7, 1)
DRAFT = "claim_id bigint, schema_version int, topic string, subject string, predicate string, object string, inferred boolean"
ITEM = "claim_id bigint, idx bigint, citation_uri string, relationship string"


def now():
    return F.lit(NOW)


def test_assessment_order(spark):
    s, c = "supporting", "contradicting"
    cases = [
        (1, (1, "t", "s", "is", "o"), [("a", s)], "supported", None), (2, (1, "t", "s", "is", "o"), [("a", s), ("b", c)], "disputed", None),
        (3, (2, "t", "s", "is", "o"), [("a", s)], None, "unsupported_schema"), (4, (1, " ", "s", "is", "o"), [("a", s)], None, "invalid_field:topic"),
        (5, (1, "t", "s", "is", "x" * 2049), [("a", s)], None, "invalid_field:object"), (6, (1, "t", "s", "is", "o"), [], None, "invalid_evidence_count"),
        (7, (1, "t", "s", "is", "o"), [("a", s)] * 13, None, "invalid_evidence_count"), (8, (1, "t", "s", "is", "o"), [("a", s), ("zz", s)], None, "invalid_citation"),
        (9, (1, "t", "s", "is", "o"), [("a", s), ("a", c), ("zz", s)], None, "duplicate_evidence"), (10, (1, "t", "s", "is", "o"), [("a", c)], None, "unsupported"),
    ]
    drafts = spark.createDataFrame([(i, *f, False) for i, f, *_ in cases], DRAFT)
    items = spark.createDataFrame([(i, n, u, r) for i, _, ev, *_ in cases for n, (u, r) in enumerate(ev)], ITEM)
    allowed = spark.createDataFrame([("a",), ("b",)], "citation_uri string")
    got = {r.claim_id: (r.status, r.reason) for r in C.assess_claims(drafts, items, allowed).collect()}
    for i, _, _, status, reason in cases:
        assert got[i] == (status, reason), i


def test_direct_match_folds_the_phrase_only(spark):
    claims = spark.createDataFrame([(1, 1, "t", " The  Cat", "IS", "black", False), (2, 1, "t", "cat", "likes", "milk", False), (3, 1, "t", "a", "is", "b", False)], DRAFT)
    passages = spark.createDataFrame([(1, "x THE CAT is black."), (2, "cat likes milk"), (3, "a  is b")], "claim_id bigint, passage string")
    got = {r.claim_id: r.direct for r in C.direct_match(claims, passages).collect()}
    assert got == {1: True, 2: False, 3: False}


def resolve(mentions):
    """Names and aliases one mention after another."""
    entities, aliases, out = {}, {}, {}
    for number, name, listed in mentions:
        n = name.strip().lower()
        found = [e for e, c in entities.items() if c == n] + ([aliases[n]] if n in aliases else [])
        entity = min(found) if found else number
        if not found:
            entities[number] = n
        out[number] = entity
        for a in listed:
            aliases.setdefault(a.strip().lower(), entity)
    return out, entities, aliases


@pytest.mark.parametrize("seed", range(4))
def test_entities_match_sequential_resolution(spark, seed):
    rng = random.Random(seed)
    names = [f"N{i}" for i in range(25)]
    mentions = []
    for number in range(300):
        name = "hot" if rng.random() < 0.3 else rng.choice(names)
        listed = [a for a in rng.sample(names + ["hot"], rng.choice([0, 0, 0, 1, 2])) if a.lower() != name.lower()]
        mentions.append((number, f" {name} ", listed))
    df = spark.createDataFrame(mentions, "mention_no bigint, name string, aliases array<string>")
    resolved, entities, aliases = C.resolve_entities(df)
    want, want_entities, want_aliases = resolve(mentions)
    assert {r.mention_no: r.entity_id for r in resolved.collect()} == want
    assert {r.entity_id: r.canonical_name.lower() for r in entities.collect()} == want_entities
    assert {r.normalized_alias: r.entity_id for r in aliases.collect()} == want_aliases


def test_long_alias_chain(spark):
    # Each mention names the next one's name as an alias, so the last name leads back to the first entity.
    mentions = [(i, f"n{i}", [f"n{i + 1}"]) for i in range(40)]
    df = spark.createDataFrame(mentions, "mention_no bigint, name string, aliases array<string>")
    resolved, entities, _ = C.resolve_entities(df)
    assert {r.entity_id for r in resolved.collect()} == {0} and entities.count() == 1


def test_alias_rules(spark):
    rows = [("Ann", ["A"]), ("Ann", ["ann "]), ("Ann", ["b", "B"]), ("Ann", [" "]), ("Ann", [f"x{i}" for i in range(17)]), ("Ann", ["y" * 2049]), ("Ann", [])]
    got = [r.r for r in spark.createDataFrame(rows, "name string, aliases array<string>").select(C.alias_reason().alias("r")).collect()]
    assert got == [None] + ["invalid_aliases"] * 5 + [None]


def library(spark):
    sources = spark.createDataFrame([
        (1, "active", 1, NOW - dt.timedelta(days=1), "daily"), (2, "active", 3, NOW - dt.timedelta(days=100), "weekly"), (3, "missing", 1, NOW, "daily"),
    ], "source_id bigint, state string, authority_tier int, last_checked_at timestamp, refresh_policy string")
    chunks = spark.createDataFrame([(10, 1, 1, 0), (20, 2, 2, 0), (21, 2, 2, 1), (30, 3, 3, 0)], "chunk_id bigint, source_id bigint, version_id bigint, ordinal bigint")
    return sources, chunks


def test_dossier_scores(spark):
    sources, chunks = library(spark)
    topics = spark.createDataFrame([(1, "b", ["q"] * 3), (2, "A", [])], "topic_id bigint, label string, questions array<string>")
    claims = spark.createDataFrame([(1, 1, "s", "is", "o", "disputed", True)], "claim_id bigint, topic_id bigint, subject string, predicate string, object string, status string, inferred boolean")
    evidence = spark.createDataFrame([(1, 10, "supporting"), (1, 20, "supporting"), (1, 21, "contradicting"), (1, 30, "supporting")], "claim_id bigint, chunk_id bigint, relationship string")
    rows = D.dossiers(topics, claims, evidence, chunks, sources, now()).collect()
    assert [r.label for r in rows] == ["A", "b"]
    empty, full = rows
    assert (empty.coverage_score, empty.authority_score, empty.freshness_status, empty.claim_count) == (0.0, 0.0, "stale", 0)
    # Three pieces of evidence from two active sources: tiers 1, 3, 3; one of them fresh.
    assert full.coverage_score == pytest.approx(60) and full.authority_score == pytest.approx(200 / 3, abs=1e-5)
    assert full.independence_score == pytest.approx(200 / 3, abs=1e-5) and full.freshness_score == pytest.approx(100 / 3, abs=1e-5)
    assert full.disputed and full.unresolved_question_score == pytest.approx(60) and len(full.warnings) == 3
    review = D.claim_reviews(claims, evidence, chunks, sources, now()).first()
    assert review.source_count == 3 and not review.fresh and review.evidence_count == 4  # reviews look at every state
    assert review.warnings == [K.WARN_DISPUTED, K.WARN_STALE, K.WARN_INFERRED]
    listed = D.review_evidence(evidence, chunks).orderBy("position").collect()
    assert [r.position for r in listed] == [0, 1, 2, 3] and [r.relationship for r in listed].count("contradicting") == 1


def test_evidence_of_a_large_claim_is_numbered(spark):
    chunks = spark.range(3000).selectExpr("id as chunk_id", "id % 700 as source_id", "id % 700 as version_id", "id div 700 as ordinal")
    evidence = chunks.selectExpr("if(chunk_id % 3 = 0, chunk_id % 50, 7) as claim_id", "chunk_id", "if(chunk_id % 5 = 0, 'contradicting', 'supporting') as relationship")
    got = D.review_evidence(evidence, chunks).collect()
    per: dict = {}
    for r in got:
        per.setdefault(r.claim_id, []).append((r.position, r.citation_uri))
    want: dict = {}
    for r in evidence.join(chunks, "chunk_id").collect():
        want.setdefault(r.claim_id, []).append((r.source_id, r.ordinal, r.relationship, r.chunk_id))
    assert len(got) == 3000
    for claim, rows in per.items():
        uris = [f"evidence://source/{s}/version/{s}#chunk-{o}" for s, o, _, _ in sorted(want[claim])]
        assert sorted(rows) == list(enumerate(uris))


def test_refresh_order_and_boundary(spark):
    exact, old = NOW - dt.timedelta(days=90), NOW - dt.timedelta(days=91)
    sources = spark.createDataFrame([
        (1, "active", "daily", old), (2, "active", "weekly", None), (3, "active", "filesystem_event", None), (4, "active", "daily", exact),
        (5, "missing", "daily", None), (6, "active", "daily", old),
    ], "source_id bigint, state string, refresh_policy string, last_checked_at timestamp")
    schema = "source_id bigint, next_due_at timestamp, state string, attempts bigint, last_error string, updated_at timestamp"
    later = spark.createDataFrame([(6, NOW + dt.timedelta(days=1), "retry", 2, "e", NOW)], schema)
    rows = D.due_refreshes(sources, later, now(), 1).collect()
    assert [(r.source_id, r.skipped_over_budget) for r in rows] == [(2, 1)]
    claimed = spark.createDataFrame([(1, old, "claimed", 2, "e", old), (9, old, "scheduled", 0, None, old)], schema)
    out = {r.source_id: r for r in D.schedule_refreshes(claimed, D.due_refreshes(sources, claimed, now()), now()).collect()}
    assert out[1].state == "claimed" and out[1].next_due_at == old and out[1].updated_at == NOW
    assert out[2].state == "scheduled" and out[2].next_due_at == NOW and out[9].updated_at == old


def test_questions_are_all_or_nothing(spark):
    topics = spark.createDataFrame([(1,), (2,), (3,), (4,)], "topic_id bigint")
    rows = [(1, 1, " b "), (1, 0, "a"), (2, 0, "x"), (2, 1, "X "), (3, 0, " "), (9, 0, "q")] + [(4, i, f"q{i}") for i in range(17)]
    good, bad = D.set_questions(topics, spark.createDataFrame(rows, "topic_id bigint, position bigint, question string"))
    assert [(r.topic_id, r.questions) for r in good.collect()] == [(1, ["a", "b"])]
    assert {r.topic_id: r.reason for r in bad.collect()} == {2: "invalid_questions", 3: "invalid_questions", 4: "invalid_questions", 9: "unknown_topic"}


def test_question_limit_counts_bytes_as_given(spark):
    topics = spark.createDataFrame([(1,), (2,)], "topic_id bigint")
    rows = spark.createDataFrame([(1, 0, " " + "x" * 2047), (2, 0, " " + "x" * 2048)], "topic_id bigint, position bigint, question string")
    good, bad = D.set_questions(topics, rows)
    assert [r.topic_id for r in good.collect()] == [1] and [r.topic_id for r in bad.collect()] == [2]


def test_proposals_fail_as_a_batch(spark):
    evidence = spark.createDataFrame([(b, 0, f"u{b}", "Cat is black") for b in (1, 2, 3)], "batch_id bigint, idx bigint, citation_uri string, passage string")
    schema = "batch_id bigint, claim_id bigint, subject string, predicate string, object string, subject_aliases array<string>, object_aliases array<string>, inferred boolean, supporting array<bigint>, contradicting array<bigint>"
    rows = [(1, 10, "cat", "is", "black", [], [], False, [0], []), (1, 11, "dog", "is", "black", [], [], False, [0], []),
            (2, 20, "cat", "is", "black", [], [], False, [0], []), (2, 21, "cat", "is", "black", [], [], False, [1], []),
            (3, 30, "cat", "is", "black", [], [], False, [0], [0])]
    batches = spark.createDataFrame([(b, "t") for b in (1, 2, 3)], "batch_id bigint, topic string")
    reasons, drafts, items = C.claims_from_proposals(batches, spark.createDataFrame(rows, schema), evidence)
    assert {r.batch_id: r.reason for r in reasons.collect()} == {1: None, 2: "invalid_extraction", 3: "invalid_extraction"}
    assert {r.claim_id: r.inferred for r in drafts.collect()} == {10: False, 11: True} and items.count() == 2


def test_proposal_replies(spark):
    ok = '{"claims": [{"subject": "a", "predicate": "is", "object": "b", "supporting_evidence": [0]}]}'
    replies = [ok, '{"claims": []}', ok.replace('"object"', '"objekt"'), ok.replace("}]}", ', "x": 1}]}'), '{"claims": [], "y": 1}', "no", ok.replace("[0]", "[-1]")]
    read, rows = C.parse_proposals(spark.createDataFrame(list(enumerate(replies)), "question_id bigint, content string"))
    assert [r.ok for r in read.orderBy("batch_id").collect()] == [True, True, False, False, False, False, False]
    row = rows.first()
    assert (row.claim_id, row.subject, row.inferred, row.supporting, row.contradicting) == (0, "a", False, [0], [])


def test_reviews_list_their_evidence(spark):
    claims = spark.createDataFrame([(1, 0, "a", "is", "b", False, "supported")], "claim_id bigint, topic_id bigint, subject string, predicate string, object string, inferred boolean, status string")
    chunks = spark.createDataFrame([(10, 1, 1, 0), (11, 1, 1, 1), (20, 2, 2, 0)], "chunk_id bigint, source_id bigint, version_id bigint, ordinal bigint")
    evidence = spark.createDataFrame([(1, 11, "supporting"), (1, 20, "supporting"), (1, 10, "contradicting")], "claim_id bigint, chunk_id bigint, relationship string")
    sources = spark.createDataFrame([(1, None), (2, None)], "source_id bigint, last_checked_at timestamp")
    found = D.claim_reviews(claims, evidence, chunks, sources, F.current_timestamp()).first()
    assert [(e.relationship, e.source_id, e.ordinal) for e in found.evidence] == [("contradicting", 1, 0), ("supporting", 2, 0), ("supporting", 1, 1)]


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="the given tables are not here")
def test_texts_are_cut_once_for_all_that_reads_drafts(spark):
    inputs = Inputs(spark, GIVEN)
    for rows in (inputs.claims(), inputs.claim_items(), inputs.chunk_places(), inputs.stored_claims()[1]):
        assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()
    places = Inputs(spark, GIVEN).chunk_places()  # from the texts themselves
    assert sorted(inputs.chunk_places().collect()) == sorted(places.collect())


def test_a_citation_is_parsed_once_for_each_row(spark):
    cited = spark.createDataFrame([("evidence://source/1/version/2#chunk-3",), ("evidence://source/x/version/2#chunk-3",), ("a/b/3",)], "citation_uri string")
    chunks = spark.createDataFrame([(1, 2, 3, "text")], "source_id bigint, version_id bigint, ordinal bigint, body string")
    sources = spark.createDataFrame([(1, "active", "n", "u")], "source_id bigint, state string, display_name string, canonical_uri string")
    opened = open_citations(cited, chunks, sources)
    assert [r.body for r in opened.collect()] == ["text"]
    assert opened._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_aliases_read_the_mentions_once(spark, tmp_path):
    """the entity of an alias follows from its owner's name, so mentions are not joined with names again."""
    rows = [(1, "A", ["b"]), (2, "B", ["c"]), (3, "c", ["d"]), (4, "E", ["d", "f"]), (5, "b", ["g"])]
    spark.createDataFrame(rows, "mention_no bigint, name string, aliases array<string>").write.parquet(str(tmp_path / "m"))
    _, _, aliases = C.resolve_entities(spark.read.parquet(str(tmp_path / "m")))
    assert {(r.alias, r.entity_id) for r in aliases.collect()} == {("b", 1), ("c", 1), ("d", 1), ("f", 4), ("g", 1)}
    assert aliases._jdf.queryExecution().optimizedPlan().toString().count("mention_no#") > 0
    assert aliases._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def test_drafts_are_rows_before_their_words_are_taken(spark, monkeypatch):
    """the words of a draft are found by compiled code, not inside a function over the drafts of a passage."""
    from sourcelight.plans import inputs

    monkeypatch.setattr(inputs, "stored", lambda df: df)
    drafts = Inputs(spark, GIVEN).claim_drafts()
    assert "posexplode(regexp_extract_all(body" in drafts._jdf.queryExecution().analyzed().toString()
    row = drafts.filter("part = 1").orderBy("claim_id").first()
    body = {r.chunk_id: r.body for r in Inputs(spark, GIVEN).chunks().filter(F.col("chunk_id") == row.chunk_id).collect()}[row.chunk_id]
    w = body.split()[40:80]
    assert (row.first, row.second, row.third, row.others) == (w[0], w[1], w[2], " ".join(w[2:]))
