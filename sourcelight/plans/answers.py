"""Registered queries: questions, prompts and tables of model answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight.operators import answers as A
from sourcelight.operators import fusion
from sourcelight.plans.registry import query
from sourcelight.plans.retrieval import EVIDENCE_SQL, hybrid_hits
from sourcelight.session import scratch_dir, stored
from sourcelight.sources.keyed import KeyedTable


@query("validate_questions", r"""
    SELECT question_id, CASE WHEN trim(question, E' \n') = '' OR strlen(question) > 4096 THEN 'invalid_question' WHEN trim(provider) = '' THEN 'invalid_model_identity' END AS reason FROM questions""", "questions")
def _(i):
    return A.validate_questions(i.questions()).select("question_id", "reason")


WINDOW = """
    hist AS (SELECT conversation_id, ordinal, role, content, n, cnt - n AS position,
                 sum(strlen(content)) OVER p <= 32768 AND NOT bool_or(role NOT IN ('user', 'assistant') OR trim(content) = '') OVER p AS valid
          FROM (SELECT *, count(*) OVER (PARTITION BY conversation_id) AS cnt FROM (
                  SELECT conv_id AS conversation_id, turn AS ordinal, role, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {table}) WHERE n <= 8)
          WINDOW p AS (PARTITION BY conversation_id))"""


@query("history_window", f"WITH {WINDOW.format(table='conversations')} SELECT conversation_id, position, ordinal, role, md5(content) AS content_md5, valid FROM hist")
def _(i):
    w = A.history_window(i.messages())
    return w.select("conversation_id", "position", "ordinal", "role", F.md5("content").alias("content_md5"), "valid")


LONG = "(SELECT conv_id // 4 AS conv_id, conv_id * 10 + turn AS turn, role, text || ' ' || text AS text FROM conversations)"


def _long_history(i):
    """Four conversations run together and every turn doubled, so that windows overflow."""
    c = F.col("conv_id")
    rows = i.table("conversations").select(F.floor(c / 4).cast("bigint").alias("conversation_id"), (c * 10 + F.col("turn")).alias("ordinal"), "role",
                                           F.concat("text", F.lit(" "), "text").alias("content"))
    return A.history_window(rows)


@query("prompt_history", rf"""
    WITH {WINDOW.format(table=LONG)},
    sized AS (SELECT *, strlen(role) + 32 AS o, coalesce(sum(strlen(role) + 32 + strlen(content)) OVER (PARTITION BY conversation_id ORDER BY position DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM hist),
    cut AS (SELECT *, list_max(list_filter(range(0, length(content) + 1), lambda k: strlen(content[1 : k]) <= 4096 - prior - o)) AS k FROM sized WHERE prior + o < 4096)
    SELECT conversation_id, position, role, md5(content[1 : k]) AS content_md5 FROM cut WHERE k > 0""")
def _(i):
    return A.prompt_history(_long_history(i)).select("conversation_id", "position", "role", F.md5("content").alias("content_md5"))


def requests(i):
    evidence = i.supplied().select(
        "question_id", "idx", "citation_uri", F.col("conv_id").alias("source_id"), F.col("turn").alias("version_id"), F.col("idx").alias("chunk_id"),
        F.col("idx").alias("ordinal"), F.lit("conversation").alias("display_name"), F.lit(None).cast("string").alias("heading"),
        F.struct(F.col("turn").alias("line_start")).alias("coordinates"), F.lit("2024-06-01T00:00:00Z").alias("retrieved_at"), F.col("question").alias("passage"))
    history = A.prompt_history(A.history_window(i.messages()))
    turns = i.questions().select("question_id", F.col("conv_id").alias("conversation_id")).join(history, "conversation_id")
    return A.build_requests(i.questions(), evidence, turns.drop("conversation_id"))


@query("build_requests", f"""
    WITH {WINDOW.format(table='conversations')},
    sized AS (SELECT *, strlen(role) + 32 AS o, coalesce(sum(strlen(role) + 32 + strlen(content)) OVER (PARTITION BY conversation_id ORDER BY position DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM hist),
    turns AS (SELECT conversation_id, list({{'role': role, 'content': content[1 : k]}} ORDER BY position) AS t
              FROM (SELECT *, list_max(list_filter(range(0, length(content) + 1), lambda k: strlen(content[1 : k]) <= 4096 - prior - o)) AS k FROM sized WHERE prior + o < 4096) WHERE k > 0 GROUP BY conversation_id),
    ev AS (SELECT question_id, count(*) AS n, list(json_object('citation_uri', citation_uri, 'source_id', conv_id, 'version_id', turn, 'chunk_id', idx, 'ordinal', idx, 'display_name', 'conversation', 'heading', NULL,
                  'coordinates', json_object('line_start', turn), 'retrieved_at', '2024-06-01T00:00:00Z', 'passage', question) ORDER BY idx) AS e
           FROM supplied JOIN questions USING (question_id) GROUP BY question_id)
    SELECT question_id, n AS evidence_count, md5(CAST(json_object('schema_version', 1, 'task_id', CAST(question_id AS VARCHAR), 'question', trim(question, E' \\n'), 'provider', provider, 'model', 'm',
               'conversation', t, 'evidence', e, 'limits', json_object('max_evidence_chunks', 12, 'max_evidence_tokens', 1500, 'max_output_tokens', 512)) AS VARCHAR)) AS payload_md5
    FROM questions JOIN ev USING (question_id) JOIN turns ON conversation_id = conv_id""", "questions", "supplied")
def _(i):
    made = requests(i).filter("reason is null")
    payload = F.substring_index(F.substring_index("prompt", "\nEND-evidence-", 1), "\n", -1)
    return made.select("question_id", "evidence_count", F.md5(payload).alias("payload_md5"))


def echo_model(prompts: list[str]) -> list[str]:
    """A stand-in for a model that cites the first passage. By question number, some first replies are flawed
    and some replies stay wrong."""
    replies = []
    for prompt in prompts:
        number = int(re.search(r'"task_id":"(\d+)"', prompt).group(1))
        body = {"schema_version": 3 if number % 7 == 0 else 1, "summary": "Read.", "summary_evidence": [0],
                "claims": [{"statement": "It was read.", "support": "direct", "evidence": [0]}], "warnings": [], "unresolved_gaps": []}
        if number % 3 == 0 and "PREVIOUS-REPLY" not in prompt:
            body["summary_evidence"] = [50]
        replies.append(json.dumps(body))
    return replies


@query("run_model", """
    SELECT question_id, 'Read.' AS summary, CASE WHEN question_id % 7 = 0 THEN '' ELSE citation_uri END AS citations,
           CASE WHEN question_id % 7 = 0 THEN 'unknown_indexed_schema' END AS reason FROM supplied WHERE idx = 0""", "supplied")
def _(i):
    made = requests(i)
    checked = A.answer_questions(made, i.supplied(), echo_model)
    return checked.select("question_id", "summary", F.array_join("summary_citations", ",").alias("citations"), "reason")


_FOLD, _LAST = EVIDENCE_SQL.rsplit("SELECT f.query_id, i - 1 AS idx", 1)


@query("question_to_answer", f"""{_FOLD.strip()}, chosen AS (SELECT f.query_id, i - 1 AS idx{_LAST})
    SELECT query_id AS question_id, CASE WHEN citation_uri IS NULL THEN 'no_evidence' ELSE 'Read.' END AS summary,
           CASE WHEN citation_uri IS NULL OR query_id % 7 = 0 THEN '' ELSE citation_uri END AS citations,
           CASE WHEN citation_uri IS NOT NULL AND query_id % 7 = 0 THEN 'unknown_indexed_schema' END AS reason
    FROM queries LEFT JOIN (SELECT query_id, citation_uri FROM chosen WHERE idx = 0 AND query_id % 10 <> 9) USING (query_id)""", "reranked", "queries", recursive=True)
def _(i):
    # Retrieval, evidence, request, model, repair and check; one question in ten is left without evidence.
    questions = i.queries().select(F.col("query_id").alias("question_id"), F.col("query").alias("question"), F.lit("local").alias("provider"), F.lit("m").alias("model"))
    chosen = fusion.select_evidence(hybrid_hits(i)).filter("query_id % 10 <> 9").withColumnRenamed("query_id", "question_id")
    chosen = stored(chosen.select("question_id", "idx", *fusion.EVIDENCE_FIELDS))
    replies = KeyedTable(i.spark, scratch_dir(i.spark), ["request"], T.StructType.fromDDL(A.REPLIES))
    found = A.answer_or_gap(questions, chosen, echo_model, replies=replies)
    return found.select("question_id", "summary", F.array_join("summary_citations", ",").alias("citations"), "reason")


def shown(df):
    """An answer as plain columns."""
    refs = F.transform("claims", lambda c: F.concat(c["support"], F.lit(":"), F.array_join(F.transform(c["evidence"], lambda e: e.cast("string")), "+"), F.array_join(c["citations"], "+")))
    return df.select(
        "question_id", "schema_version", "summary", F.size("claims").cast("bigint").alias("claims"),
        F.md5(F.array_join(F.transform("claims", lambda c: c["statement"]), "|")).alias("statements_md5"), F.array_join(refs, "|").alias("refs"),
        F.array_join(F.transform("summary_evidence", lambda e: e.cast("string")), "+").alias("summary_refs"), F.array_join("summary_citations", "+").alias("summary_citations"),
        F.array_join("warnings", "|").alias("warnings"), F.array_join("unresolved_gaps", "|").alias("gaps"), "reason",
    )


NOT_JSON = "unreadable_answer"


@query("decode_answers", f"""
    WITH good AS (SELECT *, variant = 7 AS cited, CASE WHEN variant IN (3, 8) OR (variant = 5 AND len(se) = 0) THEN '{NOT_JSON}' END AS reason FROM drafted)
    SELECT question_id, CASE WHEN reason IS NULL THEN CASE WHEN cited THEN 'cited' ELSE 'indexed' END END AS form,
           CASE WHEN reason IS NULL THEN schema_version END::BIGINT AS schema_version, CASE WHEN reason IS NULL THEN summary END AS summary,
           CASE WHEN reason IS NULL THEN len(cs) ELSE -1 END AS claims,
           CASE WHEN reason IS NULL THEN md5(array_to_string(list_transform(cs, lambda c: c.s), '|')) END AS statements_md5,
           CASE WHEN reason IS NULL THEN array_to_string(list_transform(cs, lambda c: c.k || ':' || CASE WHEN cited THEN 'uri-' ELSE '' END || c.e), '|') END AS refs,
           CASE WHEN reason IS NULL THEN CASE WHEN cited THEN '' WHEN variant = 5 THEN CAST(se[1] AS VARCHAR) ELSE array_to_string(se, '+') END END AS summary_refs,
           CASE WHEN reason IS NULL THEN CASE WHEN cited THEN 'uri-0' ELSE '' END END AS summary_citations,
           CASE WHEN reason IS NULL THEN CASE WHEN variant = 9 THEN 'one note' ELSE array_to_string(w, '|') END END AS warnings,
           CASE WHEN reason IS NULL THEN array_to_string(g, '|') END AS gaps, reason FROM good""", "drafted")
def _(i):
    d = A.decode_answers(i.responses())
    out = shown(d).withColumn("claims", F.coalesce("claims", F.lit(-1).cast("bigint")))
    return out.join(d.select("question_id", "form"), "question_id")


URI = "'evidence://source/' || conv_id || '/version/' || turn || '#chunk-' || "
BOUND = f"""
    bound AS (SELECT *, CASE WHEN schema_version <> 1 THEN 'unknown_indexed_schema'
                          WHEN list_max(se) >= given OR list_max(list_transform(cs, lambda c: c.e)) >= given THEN 'unknown_reference' END AS why,
                     list_transform(se, lambda x: {URI} x) AS sc FROM drafted)"""
REFS = f"""array_to_string(list_transform(cs, lambda c: c.k || ':' || c.e || CASE WHEN why IS NULL THEN {URI} c.e ELSE '' END), '|')"""


@query("materialize_answers", f"""
    WITH {BOUND}
    SELECT question_id, CAST(schema_version AS BIGINT) AS schema_version, summary, len(cs) AS claims, md5(array_to_string(list_transform(cs, lambda c: c.s), '|')) AS statements_md5, {REFS} AS refs,
           array_to_string(se, '+') AS summary_refs, CASE WHEN why IS NULL THEN array_to_string(sc, '+') ELSE '' END AS summary_citations,
           array_to_string(w, '|') AS warnings, array_to_string(g, '|') AS gaps, why AS reason FROM bound""", "drafted")
def _(i):
    return shown(A.materialize_answers(i.drafted(), i.supplied()))


FINAL = f"""
    {BOUND},
    final AS (SELECT *, list_transform(cs, lambda c: CASE WHEN c.k = 'inference' AND NOT contains(lower(c.s), 'infer') THEN 'Inference: ' || trim(c.s, E' \\n') ELSE c.s END) AS st,
                     CASE WHEN len(cs) = 0 THEN [] WHEN why IS NULL THEN sc ELSE [] END AS fc,
                     CASE WHEN len(cs) = 0 THEN 'no_evidence' ELSE summary END AS fs,
                     CASE WHEN len(cs) = 0 AND len(g) = 0 THEN ['no_supported_answer'] ELSE g END AS fg,
                     coalesce(why, CASE WHEN len(list_filter(cs, lambda c: c.k = 'inference' AND NOT contains(lower(c.s), 'infer') AND trim(c.s, E' \\n') = '')) > 0 THEN 'invalid_statement' END) AS why2 FROM bound)"""


@query("finalize_answers", f"""
    WITH {FINAL}
    SELECT question_id, CAST(schema_version AS BIGINT) AS schema_version, fs AS summary, len(cs) AS claims, md5(array_to_string(st, '|')) AS statements_md5, {REFS} AS refs,
           array_to_string(se, '+') AS summary_refs, array_to_string(fc, '+') AS summary_citations, array_to_string(w, '|') AS warnings, array_to_string(fg, '|') AS gaps, why2 AS reason FROM final""", "drafted")
def _(i):
    return shown(A.finalize_answers(A.materialize_answers(i.drafted(), i.supplied())))


@query("validate_answers", f"""
    WITH {FINAL}, stated AS (SELECT *, list_transform(st, lambda x: trim(x, E' \\n')) AS ts FROM final),
    faults AS (SELECT *, list_position(list_transform(ts, lambda x, n: x = '' OR strlen(st[n]) > 4096 OR list_position(ts, x) < n), true) AS bad_at FROM stated)
    SELECT question_id, coalesce(why2, CASE WHEN strlen(fs) > 8192 OR trim(fs) = '' THEN 'invalid_summary'
        WHEN len(cs) > 32 THEN 'too_many_parts'
        WHEN len(list_filter(list_concat(w, fg), lambda x: trim(x) = '')) > 0 THEN 'invalid_note'
        WHEN len(list_distinct(fc)) < len(fc) THEN 'repeated_citation'
        WHEN bad_at IS NOT NULL THEN CASE WHEN ts[bad_at] = '' OR strlen(st[bad_at]) > 4096 THEN 'invalid_statement' ELSE 'repeated_statement' END END) AS reason FROM faults""", "drafted")
def _(i):
    rows = A.validate_answers(A.finalize_answers(A.materialize_answers(i.drafted(), i.supplied())))
    return rows.select("question_id", "reason")


@query("evidence_gap", """
    SELECT question_id, 1::BIGINT AS schema_version, 'no_evidence' AS summary, 'no_passage' AS gap
    FROM questions WHERE question_id NOT IN (SELECT question_id FROM supplied)""", "questions", "supplied")
def _(i):
    gaps = A.evidence_gap(i.questions(), i.supplied())
    return gaps.select("question_id", "schema_version", "summary", F.array_join("unresolved_gaps", "|").alias("gap"))


@query("answer_citations", f"""
    WITH {BOUND}
    SELECT question_id, array_to_string(list_sort(list_distinct(CASE WHEN why IS NULL THEN list_concat(sc, list_transform(cs, lambda c: {URI} c.e)) ELSE [] END)), ' ') AS citations FROM bound""", "drafted")
def _(i):
    rows = A.materialize_answers(i.drafted(), i.supplied())
    return rows.select("question_id", F.array_join(F.array_sort(A.answer_citations()), " ").alias("citations"))


@query("answer_text", """
    SELECT question_id, rtrim(summary || CASE WHEN len(cs) > 0 THEN chr(10) || chr(10) || 'Claims:' || chr(10) || array_to_string(list_transform(cs, lambda c: '- [' || c.k || '] ' || c.s || chr(10)), '') ELSE '' END
        || CASE WHEN len(w) > 0 THEN chr(10) || 'Warnings:' || chr(10) || array_to_string(list_transform(w, lambda x: '- ' || x || chr(10)), '') ELSE '' END
        || CASE WHEN len(g) > 0 THEN chr(10) || 'Unresolved gaps:' || chr(10) || array_to_string(list_transform(g, lambda x: '- ' || x || chr(10)), '') ELSE '' END, E' \\n') AS text FROM drafted""", "drafted")
def _(i):
    return i.drafted().select("question_id", A.answer_text().alias("text"))


@query("error_class", """
    SELECT event_id, event_type IN ('view', 'error') AS retryable, event_type IN ('error', 'view', 'purchase', 'signup') AS reconnectable FROM events""")
def _(i):
    t = F.col("event_type")
    kind = F.when(t == "view", "unavailable").when(t == "error", "rejected").otherwise("invalid")
    message = (F.when(t == "view", "Model UNAVAILABLE now").when(t == "error", "HTTP 503 returned").when(t == "purchase", "read Timed out")
               .when(t == "signup", "request failed").otherwise("bad input, HTTP 404"))
    rows = i.table("events").select("event_id", kind.alias("kind"), message.alias("message"))
    return rows.select("event_id", A.error_class("kind", "message").alias("c")).select("event_id", "c.*")
