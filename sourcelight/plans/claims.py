"""Registered queries: claims, entities, dossiers and refreshes."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight import constants as K
from sourcelight.operators import claims as C
from sourcelight.operators import dossiers as D
from sourcelight.operators import lexical
from sourcelight.plans.inputs import NOW_SQL, PREDICATES, now
from sourcelight.plans.registry import query
from sourcelight.session import scratch_dir
from sourcelight.sources.keyed import KeyedTable

VERBS = repr(PREDICATES).replace('"', "'")

ASSESS = r"""
    per AS (SELECT claim_id, count(*) AS n, bool_or(relationship = 'supporting') AS sup, bool_or(relationship = 'contradicting') AS con,
                   min(CASE WHEN again > 1 THEN idx END) AS dup, min(CASE WHEN known IS NULL THEN idx END) AS unknown
            FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, citation_uri ORDER BY idx) AS again FROM items
                  LEFT JOIN ({known}) USING (citation_uri)) GROUP BY claim_id),
    judged AS (SELECT cl.claim_id, CASE WHEN schema_version <> 1 THEN 'unsupported_schema'
                 WHEN trim(subject) = '' OR strlen(subject) > 2048 THEN 'invalid_field:subject' WHEN trim(predicate) = '' OR strlen(predicate) > 2048 THEN 'invalid_field:predicate' WHEN trim(object) = '' OR strlen(object) > 2048 THEN 'invalid_field:object'
                 WHEN n IS NULL OR n > 12 THEN 'invalid_evidence_count'
                 WHEN unknown IS NOT NULL AND (dup IS NULL OR unknown <= dup) THEN 'invalid_citation' WHEN dup IS NOT NULL THEN 'duplicate_evidence'
                 WHEN NOT sup THEN 'unsupported' END AS reason, CASE WHEN con THEN 'disputed' ELSE 'supported' END AS status
               FROM cl LEFT JOIN per USING (claim_id))"""
OPEN = "SELECT DISTINCT 'evidence://source/' || source_id || '/version/' || version_id || '#chunk-' || ordinal AS citation_uri, 1 AS known FROM chunks WHERE state <> 'deleted'"
DIRECT = rf"""
    direct AS (SELECT claim_id, bool_or(list_contains({VERBS}, lower(trim(predicate))) AND contains(lower(body), phrase)) AS direct
               FROM (SELECT *, lower(array_to_string(regexp_extract_all(subject || ' ' || predicate || ' ' || object, '\S+'), ' ')) AS phrase FROM cl)
                    JOIN items USING (claim_id) JOIN chunks c ON c.chunk_id = items.chunk_id
               WHERE relationship = 'supporting' {{limit}} GROUP BY claim_id)"""


def open_uris(i):
    from sourcelight.functions.text import citation_uri

    live = i.sources().filter("state <> 'deleted'").select("source_id")
    return i.chunk_places().join(live, "source_id").select(citation_uri("source_id", "version_id", "ordinal").alias("citation_uri"))


@query("assess_claims", f"""
    WITH {ASSESS.format(known=OPEN)}
    SELECT claim_id, CASE WHEN reason IS NULL THEN status END AS status, reason FROM judged""", "cl", "items", "chunks")
def _(i):
    return C.assess_claims(i.claims(), i.claim_items(), open_uris(i)).select("claim_id", "status", "reason")


@query("direct_match", f"WITH {DIRECT.format(limit='')} SELECT claim_id, direct FROM direct", "cl", "items", "chunks")
def _(i):
    cited = i.claim_items().filter("relationship = 'supporting'").select("claim_id", "chunk_id")
    return C.direct_match(i.claims(), cited, PREDICATES, i.chunks().select("chunk_id", F.col("body").alias("passage")))


@query("record_claims", f"""
    WITH {ASSESS.format(known=OPEN)}, {DIRECT.format(limit="AND state <> 'deleted' AND claim_id IN (SELECT claim_id FROM items GROUP BY claim_id HAVING count(*) <= 12)")},
    lost AS (SELECT DISTINCT claim_id FROM items LEFT JOIN ({OPEN}) USING (citation_uri) WHERE known IS NULL AND claim_id IN (SELECT claim_id FROM items GROUP BY claim_id HAVING count(*) <= 12)),
    final AS (SELECT claim_id, topic, status, inferred, CASE WHEN claim_id IN (SELECT claim_id FROM lost) THEN 'citation_not_found'
                     WHEN NOT inferred AND NOT coalesce(direct, false) THEN 'unsupported_evidence' ELSE reason END AS reason
              FROM cl JOIN judged USING (claim_id) LEFT JOIN direct USING (claim_id))
    SELECT f.claim_id, topic, CASE WHEN reason IS NULL THEN status END AS status, CASE WHEN reason IS NULL THEN CASE status WHEN 'supported' THEN 0.75 ELSE 0.5 END::DOUBLE END AS confidence,
           reason, CASE WHEN reason IS NULL THEN n ELSE 0 END AS evidence_rows
    FROM final f LEFT JOIN (SELECT claim_id, count(*) AS n FROM items GROUP BY claim_id) USING (claim_id)""", "cl", "items", "chunks")
def _(i):
    recorded, stored, rejected = C.record_claims(i.claims(), i.claim_items(), i.chunks(), i.sources(), PREDICATES)
    counts = stored.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    kept = recorded.join(counts, "claim_id", "left").select("claim_id", "status", "confidence", F.lit(None).cast("string").alias("reason"), "n")
    lost = rejected.select("claim_id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("confidence"), "reason", F.lit(0).cast("bigint").alias("n"))
    return kept.unionByName(lost).join(i.claims().select("claim_id", "topic"), "claim_id").select(
        "claim_id", "topic", "status", "confidence", "reason", F.coalesce("n", F.lit(0)).alias("evidence_rows")
    )


@query("recorded_evidence", f"""
    WITH {ASSESS.format(known=OPEN)}, {DIRECT.format(limit="AND state <> 'deleted' AND claim_id IN (SELECT claim_id FROM items GROUP BY claim_id HAVING count(*) <= 12)")},
    lost AS (SELECT DISTINCT claim_id FROM items LEFT JOIN ({OPEN}) USING (citation_uri) WHERE known IS NULL),
    good AS (SELECT claim_id FROM cl JOIN judged USING (claim_id) LEFT JOIN direct USING (claim_id)
             WHERE reason IS NULL AND (inferred OR direct) AND claim_id NOT IN (SELECT claim_id FROM lost))
    SELECT claim_id, chunk_id, relationship FROM items WHERE claim_id IN (SELECT claim_id FROM good)""", "cl", "items", "chunks")
def _(i):
    _, stored, _ = C.record_claims(i.claims(), i.claim_items(), i.chunks(), i.sources(), PREDICATES)
    return stored


@query("claims_from_proposals", rf"""
    WITH ev AS (SELECT conv_id AS batch_id, turn AS idx, 'evidence://source/' || conv_id || '/version/' || conv_id || '#chunk-' || turn AS citation_uri, text AS passage FROM conversations),
    sizes AS (SELECT batch_id, count(*) AS n FROM ev GROUP BY batch_id),
    pr AS (SELECT batch_id, batch_id * 100 + idx AS claim_id, idx, w[1] AS subject, w[2] AS predicate, array_to_string(w[3:], ' ') AS object, passage,
                  CASE WHEN batch_id % 12 = 5 AND idx = 1 THEN [idx, idx] WHEN batch_id % 12 = 6 AND idx = 0 THEN [99] ELSE [idx] END AS sup,
                  CASE WHEN batch_id % 3 = 0 AND idx > 0 THEN [0] ELSE [] END AS con
           FROM (SELECT *, regexp_extract_all(passage, '\S+') AS w FROM ev)),
    judged AS (SELECT pr.*, n, CASE WHEN list_max(sup) >= n OR len(list_distinct(list_concat(sup, con))) < len(sup) + len(con) THEN 'invalid_extraction'
                 WHEN coalesce(subject, '') = '' THEN 'invalid_field:subject' WHEN coalesce(predicate, '') = '' THEN 'invalid_field:predicate' WHEN coalesce(object, '') = '' OR strlen(object) > 2048 THEN 'invalid_field:object' END AS why,
                 list_contains({VERBS}, lower(predicate)) AND contains(lower(passage), lower(subject || ' ' || predicate || ' ' || object)) AS direct
               FROM pr JOIN sizes USING (batch_id)),
    b AS (SELECT batch_id, CASE WHEN batch_id % 15 = 14 OR any_value(n) > 12 THEN 'invalid_extraction' ELSE min_by(why, claim_id) FILTER (WHERE why IS NOT NULL) END AS reason FROM judged GROUP BY batch_id)
    SELECT b.batch_id, reason, count(j.claim_id) AS drafts, count(CASE WHEN NOT direct THEN 1 END) AS inferred, CAST(coalesce(sum(len(sup) + len(con)) FILTER (WHERE j.claim_id IS NOT NULL), 0) AS BIGINT) AS evidence_rows
    FROM b LEFT JOIN judged j ON j.batch_id = b.batch_id AND reason IS NULL GROUP BY ALL""")
def _(i):
    # Conversations as batches: each turn is a passage and gives one proposal from all its words.
    from sourcelight.functions.text import citation_uri, words

    b, t = F.col("batch_id"), F.col("idx")
    ev = i.table("conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("idx"), citation_uri("conv_id", "conv_id", "turn").alias("citation_uri"), F.col("text").alias("passage"))
    w = words("passage")
    none = F.array().cast("array<string>")
    pick = lambda n: F.coalesce(F.get(w, F.lit(n)), F.lit(""))
    proposals = ev.select(
        "batch_id", (b * 100 + t).alias("claim_id"), pick(0).alias("subject"), pick(1).alias("predicate"), F.array_join(F.slice(w, F.lit(3), F.greatest(F.size(w), F.lit(1))), " ").alias("object"),
        none.alias("subject_aliases"), none.alias("object_aliases"), F.lit(False).alias("inferred"),
        F.when((b % 12 == 5) & (t == 1), F.array(t, t)).when((b % 12 == 6) & (t == 0), F.array(F.lit(99).cast("bigint"))).otherwise(F.array(t)).alias("supporting"),
        F.when((b % 3 == 0) & (t > 0), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("contradicting"),
    )
    batches = i.table("conversations").select(F.col("conv_id").alias("batch_id")).distinct().withColumn("topic", F.when(b % 15 == 14, " ").otherwise("topic"))
    reasons, drafts, items = C.claims_from_proposals(batches, proposals, ev, PREDICATES)
    per = drafts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("drafts"), F.count_if("inferred").alias("inferred"))
    rows = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("evidence_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return reasons.join(per, "batch_id", "left").join(rows, "batch_id", "left").select("batch_id", "reason", zero("drafts"), zero("inferred"), zero("evidence_rows"))


@query("topic_get_or_create", """
    WITH known AS (SELECT 't' || item_id AS topic_id, 'src' || (item_id % 10) AS label FROM benchmark)
    SELECT label, coalesce(id, sha256(label)[1:32]) AS topic_id, id IS NULL AS created
    FROM (SELECT DISTINCT source AS label FROM documents) LEFT JOIN (SELECT label, min(topic_id) AS id FROM known GROUP BY label) USING (label)""")
def _(i):
    known = i.table("benchmark").select(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("topic_id"), F.concat(F.lit("src"), (F.col("item_id") % 10).cast("string")).alias("label"))
    return C.topic_get_or_create(i.table("documents").select(F.col("source").alias("label")), known)


@query("alias_rules", r"""
    SELECT claim_id, CASE WHEN len(a) > 16 OR list_contains(a, lower(first)) OR len(list_distinct(a)) < len(a) THEN 'invalid_aliases' END AS reason
    FROM (SELECT doc_id AS claim_id, lower(w[1]) AS first, list_transform(w[2 : 2 + doc_id % 20], lambda x: lower(x)) AS a FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents))""")
def _(i):
    from sourcelight.functions.text import words

    d = F.col("doc_id")
    rows = i.table("documents").select(d.alias("claim_id"), words("text").alias("w"), (d % 20).alias("k"))
    rows = rows.select("claim_id", F.get("w", F.lit(0)).alias("name"), F.slice("w", F.lit(2), (F.col("k") + 1).cast("int")).alias("aliases"))
    return rows.select("claim_id", C.alias_reason().alias("reason"))


MENTIONS = r"""
    m AS (SELECT claim_id * 2 AS mention_no, trim(subject) AS name, CASE WHEN r % 2 = 0 AND lower(alias) <> lower(first) AND alias <> '' THEN alias END AS alias FROM cl
          UNION ALL SELECT claim_id * 2 + 1, trim(object), NULL FROM cl),
    named AS (SELECT mention_no, lower(name) AS n, lower(alias) AS a FROM m),
    firsts AS (SELECT n, min(mention_no) AS p FROM named GROUP BY n),
    bound AS (SELECT a AS n, min(mention_no) AS q FROM named WHERE a IS NOT NULL GROUP BY a),
    own AS (SELECT f.n, p, q, CASE WHEN q IS NULL OR q >= p THEN p END AS own FROM firsts f LEFT JOIN bound b USING (n)),
    -- From a mention of a name that is an alias by then, follow who listed it, and who that name stood for.
    walk AS (SELECT mention_no, o.own AS found, CASE WHEN o.q < mention_no THEN o.q END AS step FROM named JOIN own o USING (n)
             UNION ALL
             SELECT w.mention_no, o.own, CASE WHEN o.q < w.step THEN o.q END FROM walk w JOIN named x ON x.mention_no = w.step JOIN own o ON o.n = x.n)"""


@query("resolve_entities", f"WITH {MENTIONS} SELECT mention_no, min(found) AS entity_id FROM walk GROUP BY mention_no", "cl", recursive=True)
def _(i):
    resolved, _, _ = C.resolve_entities(C.claim_mentions(i.claims()))
    return resolved


@query("entity_names", f"""
    WITH {MENTIONS} SELECT own AS entity_id, name AS canonical_name FROM own JOIN m ON m.mention_no = own.p WHERE own IS NOT NULL""", "cl", recursive=True)
def _(i):
    return C.resolve_entities(C.claim_mentions(i.claims()))[1].select("entity_id", "canonical_name")


@query("entity_aliases", f"""
    WITH {MENTIONS}, e AS (SELECT mention_no, min(found) AS entity_id FROM walk GROUP BY mention_no)
    SELECT entity_id, alias, b.n AS normalized_alias FROM bound b JOIN m ON m.mention_no = b.q JOIN e ON e.mention_no = b.q""", "cl", recursive=True)
def _(i):
    return C.resolve_entities(C.claim_mentions(i.claims()))[2].select("entity_id", "alias", "normalized_alias")


@query("entity_relationships", f"""
    WITH {MENTIONS}, e AS (SELECT mention_no, min(found) AS entity_id FROM walk GROUP BY mention_no)
    SELECT claim_id, s.entity_id AS subject_id, predicate, o.entity_id AS object_id
    FROM cl JOIN e s ON s.mention_no = claim_id * 2 JOIN e o ON o.mention_no = claim_id * 2 + 1 WHERE s.entity_id <> o.entity_id""", "cl", recursive=True)
def _(i):
    resolved, _, _ = C.resolve_entities(C.claim_mentions(i.claims()))
    return C.entity_relationships(i.claims(), resolved)


SCORES = f"""
    ev AS (SELECT s.topic_id, source_id, authority_tier, coalesce(last_checked_at >= {NOW_SQL} - INTERVAL 90 DAY, false) AS fresh, status = 'disputed' AS dis, inferred AS inf
           FROM stored s JOIN proof USING (claim_id) JOIN (SELECT chunk_id, source_id FROM chunks) USING (chunk_id)
                JOIN (SELECT source_id, authority_tier, last_checked_at, state FROM library) USING (source_id) WHERE state = 'active'),
    agg AS (SELECT topic_id, count(*) AS n, count(DISTINCT source_id) AS k, avg((5 - authority_tier) / 4.0) AS auth, avg(CASE WHEN fresh THEN 1.0 ELSE 0.0 END) AS fr,
                   bool_or(dis) AS dis, bool_or(inf) AS inf FROM ev GROUP BY topic_id),
    scored AS (SELECT topic_id, label, round(least(coalesce(n, 0) / 5.0, 1.0) * 100, 6) AS coverage_score, round(coalesce(auth, 0) * 100, 6) AS authority_score,
                      round(coalesce(k / n, 0) * 100, 6) AS independence_score, round(coalesce(fr, 0) * 100, 6) AS freshness_score,
                      CASE WHEN coalesce(fr, 0) < 1 THEN 'stale' ELSE 'fresh' END AS freshness_status, round(least(questions / 5.0, 1.0) * 100, 6) AS unresolved_question_score,
                      coalesce(dis, false) AS disputed, coalesce(k, 0) AS source_count,
                      array_to_string(list_filter([CASE WHEN dis THEN 'disputed' END, CASE WHEN coalesce(fr, 0) < 1 THEN 'stale' END,
                          CASE WHEN coalesce(k, 0) < 2 THEN 'single_source' END, CASE WHEN inf THEN 'inferred' END], lambda x: x IS NOT NULL), '|') AS warnings
               FROM topics LEFT JOIN agg USING (topic_id))"""
SCORE_COLUMNS = ["topic_id", "label", "coverage_score", "authority_score", "independence_score", "freshness_score", "freshness_status",
                 "unresolved_question_score", "disputed", "source_count"]


def _short(warnings="warnings"):
    return F.array_join(F.transform(warnings, lambda w: F.substring_index(w, ":", 1)), "|").alias("warnings")


@query("score_dossier", f"WITH {SCORES} SELECT {', '.join(SCORE_COLUMNS)}, warnings FROM scored", "stored", "proof", "chunks", "library", "topics")
def _(i):
    c, e = i.stored_claims()
    return D.score_dossier(i.topics(), c, e, i.chunk_places(), i.sources(), now()).select(*SCORE_COLUMNS, _short())


@query("dossiers", f"""
    WITH {SCORES} SELECT {', '.join(SCORE_COLUMNS)}, warnings, coalesce(n, 0) AS claim_count
    FROM scored LEFT JOIN (SELECT topic_id, count(*) AS n FROM stored WHERE claim_id IN (SELECT claim_id FROM proof) GROUP BY topic_id) USING (topic_id)""",
       "stored", "proof", "chunks", "library", "topics")
def _(i):
    c, e = i.stored_claims()
    return D.dossiers(i.topics(), c, e, i.chunk_places(), i.sources(), now()).select(*SCORE_COLUMNS, _short(), "claim_count")


@query("unresolved_score", "SELECT topic_id, least(questions / 5.0, 1.0)::DOUBLE AS score FROM topics", "topics")
def _(i):
    return i.topics().select("topic_id", D.unresolved_score("questions").alias("score"))


REVIEWS = f"""
    rv AS (SELECT claim_id, count(DISTINCT source_id) AS source_count, bool_and(coalesce(last_checked_at >= {NOW_SQL} - INTERVAL 90 DAY, false)) AS fresh,
                  count(*) AS evidence_count,
                  string_agg(relationship || '=' || source_id || '#' || ordinal, ',' ORDER BY relationship, ordinal, citation_uri) AS evidence
           FROM proof JOIN (SELECT chunk_id, source_id, ordinal FROM chunks) USING (chunk_id) JOIN (SELECT source_id, last_checked_at FROM library) USING (source_id) GROUP BY claim_id)"""
LABELS = """array_to_string(list_filter([CASE WHEN status = 'disputed' THEN 'disputed' END, CASE WHEN NOT fresh THEN 'stale' END,
                          CASE WHEN source_count < 2 THEN 'single_source' END, CASE WHEN inferred THEN 'inferred' END], lambda x: x IS NOT NULL), '|')"""


def _reviews(i):
    c, e = i.stored_claims()
    return D.claim_reviews(c, e, i.chunk_places(), i.sources(), now())


@query("claim_reviews", f"""
    WITH {REVIEWS} SELECT claim_id, topic_id, subject || ' ' || predicate || ' ' || object AS statement, status, source_count, evidence_count, fresh, evidence, {LABELS} AS warnings
    FROM stored JOIN rv USING (claim_id)""", "stored", "proof", "chunks", "library")
def _(i):
    listed = F.array_join(F.transform("evidence", lambda e: F.concat(e["relationship"], F.lit("="), e["source_id"].cast("string"), F.lit("#"), e["ordinal"].cast("string"))), ",")
    return _reviews(i).select("claim_id", "topic_id", "statement", "status", "source_count", "evidence_count", "fresh", listed.alias("evidence"), _short())


@query("review_evidence", """
    SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY source_id, ordinal, relationship, chunk_id) - 1 AS position,
           'evidence://source/' || source_id || '/version/' || source_id || '#chunk-' || ordinal AS citation_uri, relationship
    FROM (SELECT claim_id, chunk_id, relationship FROM proof) JOIN (SELECT chunk_id, source_id, ordinal FROM chunks) USING (chunk_id)""", "proof", "chunks")
def _(i):
    return D.review_evidence(i.stored_claims()[1], i.chunk_places())


TOPIC_ROW = "topic_id bigint, coverage_score double, authority_score double, independence_score double, questions bigint, scored bigint"


@query("topic_write_back", f"""
    WITH {SCORES} SELECT topic_id, coverage_score, authority_score, independence_score, CAST(CASE WHEN topic_id % 2 = 0 THEN 0 ELSE topics.questions END AS BIGINT) AS questions,
           CAST(CASE WHEN topic_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS scored FROM scored JOIN topics USING (topic_id)""", "stored", "proof", "chunks", "library", "topics")
def _(i):
    # Scores are written to a keyed table; a second run writes every third topic again, and half of the topics lose their questions.
    table = KeyedTable(i.spark, scratch_dir(i.spark), ["topic_id"], T.StructType.fromDDL(TOPIC_ROW))
    c, e = i.stored_claims()
    topics = i.topics()
    scores = D.score_dossier(topics, c, e, i.chunk_places(), i.sources(), now()).join(topics.select("topic_id", F.size("questions").cast("bigint").alias("questions")), "topic_id")
    table.upsert(scores.select("topic_id", "coverage_score", "authority_score", "independence_score", "questions", F.lit(1).cast("bigint").alias("scored")), expected=0)
    held = table.read()
    table.upsert(held.filter("topic_id % 3 = 0").withColumn("scored", F.col("scored") + 1), expected=1)
    held = table.read()
    table.upsert(held.filter("topic_id % 2 = 0").withColumn("questions", F.lit(0).cast("bigint")), expected=2)
    return table.read()


@query("claim_warnings", f"WITH {REVIEWS} SELECT w AS warnings, count(*) AS claims FROM (SELECT {LABELS} AS w FROM stored JOIN rv USING (claim_id)) GROUP BY w", "stored", "proof", "chunks", "library")
def _(i):
    return _reviews(i).select(_short()).groupBy("warnings").agg(F.count(F.lit(1)).alias("claims"))


DUE = f"""
    due AS (SELECT source_id, refresh_policy, last_checked_at FROM library WHERE state = 'active' AND refresh_policy <> 'filesystem_event'
              AND (last_checked_at IS NULL OR last_checked_at < {NOW_SQL} - INTERVAL 90 DAY) AND source_id NOT IN (SELECT source_id FROM schedule WHERE next_due_at > {NOW_SQL}))"""


@query("due_refreshes", f"""
    WITH {DUE} SELECT source_id, refresh_policy, epoch_us(last_checked_at) AS checked_us, greatest((SELECT count(*) FROM due) - 32, 0) AS skipped_over_budget
    FROM due ORDER BY last_checked_at ASC NULLS FIRST, source_id LIMIT 32""", "library", "schedule")
def _(i):
    return D.due_refreshes(i.sources(), i.schedule(), now()).select("source_id", "refresh_policy", F.unix_micros("last_checked_at").alias("checked_us"), "skipped_over_budget")


@query("schedule_refreshes", f"""
    WITH {DUE}, top AS (SELECT source_id, true AS hit FROM due ORDER BY last_checked_at ASC NULLS FIRST, source_id LIMIT 32)
    SELECT source_id, epoch_us(CASE WHEN hit AND coalesce(state NOT IN ('claimed', 'retry'), true) THEN {NOW_SQL} ELSE next_due_at END) AS due_us,
           CASE WHEN hit AND coalesce(state NOT IN ('claimed', 'retry'), true) THEN 'scheduled' ELSE state END AS state, coalesce(attempts, 0) AS attempts,
           epoch_us(CASE WHEN hit THEN {NOW_SQL} ELSE updated_at END) AS updated_us
    FROM schedule FULL JOIN top USING (source_id)""", "library", "schedule")
def _(i):
    out = D.schedule_refreshes(i.schedule(), D.due_refreshes(i.sources(), i.schedule(), now()), now())
    return out.select("source_id", F.unix_micros("next_due_at").alias("due_us"), "state", "attempts", F.unix_micros("updated_at").alias("updated_us"))


@query("set_questions", r"""
    WITH q AS (SELECT conv_id AS topic_id, turn AS position, CASE WHEN conv_id % 7 = 6 AND turn = 1 THEN ' ' WHEN conv_id % 7 = 5 THEN 'Same? ' ELSE ' ' || trim(text, E' \n') END AS question FROM conversations),
    j AS (SELECT topic_id, CASE WHEN count(*) > 16 OR bool_or(trim(question) = '' OR strlen(question) > 2048) OR count(DISTINCT lower(trim(question, E' \n'))) < count(*) THEN 'invalid_questions'
                           WHEN topic_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0) THEN 'unknown_topic' END AS reason,
                 string_agg(trim(question, E' \n'), '|' ORDER BY position) AS asked FROM q GROUP BY topic_id)
    SELECT topic_id, reason, CASE WHEN reason IS NULL THEN md5(asked) END AS questions_md5 FROM j""")
def _(i):
    c, t = F.col("conv_id"), F.col("turn")
    asked = F.when((c % 7 == 6) & (t == 1), " ").when(c % 7 == 5, "Same? ").otherwise(F.concat(F.lit(" "), F.btrim("text", F.lit(" \n"))))
    rows = i.table("conversations").select(c.alias("topic_id"), t.alias("position"), asked.alias("question"))
    topics = i.table("documents").filter(F.col("doc_id") % 10 != 0).select(F.col("doc_id").alias("topic_id"))
    good, bad = D.set_questions(topics, rows)
    kept = good.select("topic_id", F.lit(None).cast("string").alias("reason"), F.md5(F.array_join("questions", "|")).alias("questions_md5"))
    return kept.unionByName(bad.select("topic_id", "reason", F.lit(None).cast("string").alias("questions_md5")))


def first_words_model(prompts: list[str]) -> list[str]:
    """A stand-in for a model: one proposal per numbered passage from its first words."""
    replies = []
    for prompt in prompts:
        found = re.findall(r"(?:^|\n)\[(\d+)\] (\S+)\s+(\S+)\s+(\S+)", prompt)
        replies.append(json.dumps({"claims": [
            {"subject": s, "predicate": p, "object": o, "supporting_evidence": [int(n)]} for n, s, p, o in found
        ]}))
    return replies


@query("extract_claims", rf"""
    WITH h AS (SELECT query_id, rank - 1 AS idx, regexp_extract_all(body, '\S+') AS w, body FROM lex JOIN current USING (chunk_id) WHERE rank <= 12)
    SELECT query_id * 100 + idx AS claim_id, w[1] AS subject, w[2] AS predicate, w[3] AS object,
           NOT (list_contains({VERBS}, lower(w[2])) AND contains(lower(body), lower(w[1] || ' ' || w[2] || ' ' || w[3]))) AS inferred, 'supported' AS status, 0.75::DOUBLE AS confidence FROM h""", "lex", "current")
def _(i):
    hits = lexical.lexical_search(i.queries(), i.current(), K.MAX_EXTRACTED_CLAIMS).select(
        F.col("query_id").alias("batch_id"), (F.col("rank") - 1).alias("idx"), "source_id", "version_id", "ordinal", F.col("body").alias("passage"))
    topics = i.queries().select(F.col("query_id").alias("batch_id"), F.concat(F.lit("Item "), F.col("query_id").cast("string")).alias("topic"))
    made, _, _, _ = C.extract_claims(topics, hits, i.chunks(), i.sources(), first_words_model, PREDICATES)
    return made.select("claim_id", "subject", "predicate", "object", "inferred", "status", "confidence")
