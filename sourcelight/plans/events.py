"""Registered queries: conversations and task events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcelight.operators import conversations as V
from sourcelight.operators import tasks as T
from sourcelight.plans.inputs import NOW_SQL, now
from sourcelight.plans.registry import query


@query("append_messages", r"""
    WITH d AS (SELECT conv_id AS conversation_id, turn, role, text, CASE WHEN conv_id % 14 = 3 THEN 65 ELSE turn END AS cites FROM conversations),
    j AS (SELECT *, CASE WHEN trim(text, E' \n') = '' OR strlen(text) > 262144 THEN 'invalid_content' WHEN role NOT IN ('user', 'assistant') THEN 'invalid_role'
                         WHEN cites > 64 THEN 'too_many_citations' WHEN conversation_id NOT IN (SELECT conversation_id FROM convs) THEN 'not_found' END AS reason FROM d)
    SELECT conversation_id, turn, reason, CASE WHEN reason IS NULL THEN top + row_number() OVER (PARTITION BY conversation_id, reason IS NULL ORDER BY turn) END AS ordinal
    FROM j LEFT JOIN (SELECT conv_id AS conversation_id, max(turn) AS top FROM conversations GROUP BY conv_id) USING (conversation_id)""", "convs")
def _(i):
    c = F.col("conversation_id")
    cites = F.array_repeat(F.lit("uri"), F.when(c % 14 == 3, 65).otherwise(F.col("turn")).cast("int"))
    drafts = i.messages().select("conversation_id", F.col("ordinal").alias("turn"), "role", "content").withColumn("citations", cites)
    added, _, rejected = V.append_messages(i.conversations(), i.messages(), drafts, ["turn"], now())
    kept = added.select("conversation_id", "turn", F.lit(None).cast("string").alias("reason"), "ordinal")
    return kept.unionByName(rejected.select("conversation_id", "turn", "reason", F.lit(None).cast("bigint").alias("ordinal")))


@query("list_conversations", "SELECT conversation_id, title, epoch_us(updated_at) AS updated_us FROM convs", "convs")
def _(i):
    return V.list_conversations(i.conversations()).select("conversation_id", "title", F.unix_micros("updated_at").alias("updated_us"))


def message_objects(i):
    return i.messages().groupBy(F.col("content_sha256").alias("sha256")).agg(F.first("content").alias("payload"), F.count(F.lit(1)).alias("reference_count"))


@query("get_conversation", "SELECT conv_id AS conversation_id, turn AS ordinal, role, text AS content FROM conversations")
def _(i):
    rows = V.get_conversations(i.messages().drop("content"), message_objects(i))
    return rows.select("conversation_id", "ordinal", "role", "content")


@query("rename_conversation", f"""
    WITH r AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN '  ' WHEN conv_id % 5 = 1 THEN repeat('t', 257) ELSE ' New ' || conv_id || ' ' END AS t FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT conv_id AS conversation_id, CASE WHEN trim(t) = '' OR strlen(trim(t)) > 256 THEN 'invalid_title' WHEN conversation_id IS NULL THEN 'not_found' END AS reason,
           CASE WHEN trim(t) <> '' AND strlen(trim(t)) <= 256 AND conversation_id IS NOT NULL THEN trim(t) END AS title
    FROM r LEFT JOIN convs ON conv_id = conversation_id""", "convs")
def _(i):
    c = F.col("conversation_id")
    title = F.when(c % 5 == 0, "  ").when(c % 5 == 1, F.repeat(F.lit("t"), 257)).otherwise(F.concat(F.lit(" New "), c.cast("string"), F.lit(" ")))
    renames = i.messages().select("conversation_id").distinct().withColumn("title", title)
    changed, rejected = V.rename_conversations(i.conversations(), renames, now())
    kept = changed.select("conversation_id", F.lit(None).cast("string").alias("reason"), "title")
    return kept.unionByName(rejected.select("conversation_id", "reason", F.lit(None).cast("string").alias("title")))


@query("delete_conversation", """
    WITH m AS (SELECT conv_id, sha256(text) AS sha256 FROM conversations)
    SELECT sha256, count(*) FILTER (WHERE conv_id % 3 <> 0) AS reference_count FROM m GROUP BY sha256""")
def _(i):
    gone = i.messages().filter("conversation_id % 3 = 0").select("conversation_id")
    _, _, objects = V.delete_conversations(i.conversations(), i.messages(), message_objects(i), gone)
    return objects.select("sha256", "reference_count")


@query("conversation_title", r"SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '\S+'), ' ')[1:72] AS title FROM conversations")
def _(i):
    return i.table("conversations").select("conv_id", "turn", V.conversation_title("text").alias("title"))


EVENT = "task_id, sequence, epoch_us(timestamp) AS at_us, state, phase_name"


def _event(df):
    return df.select("task_id", "sequence", F.unix_micros("timestamp").alias("at_us"), "state", "phase_name")


@query("latest_event", f"SELECT {EVENT} FROM latest", "latest")
def _(i):
    return _event(T.latest_event(i.task_events()))


@query("visible_tasks", f"""
    SELECT {EVENT} FROM (SELECT *, row_number() OVER (PARTITION BY state IN ('completed', 'failed') ORDER BY sequence DESC) AS n FROM latest) WHERE state NOT IN ('completed', 'failed') OR n <= 20""", "latest")
def _(i):
    return _event(T.visible_tasks(i.task_events()))


@query("merge_events", """
    SELECT sequence, task_id, state, CASE WHEN value > 20 THEN 'live' ELSE 'snapshot' END AS origin
    FROM (SELECT t.*, value FROM tev t JOIN events ON event_id = sequence) ORDER BY sequence DESC LIMIT 500""", "tev")
def _(i):
    rows = i.task_events().select("sequence", "task_id", "state", "arrival")
    snapshot = rows.drop("arrival").withColumn("origin", F.lit("snapshot"))
    live = rows.filter("arrival > 20").drop("arrival").withColumn("origin", F.lit("live"))
    return T.merge_events(snapshot, live)


@query("sequence_violations", """
    SELECT task_id, sequence, prev AS previous_sequence FROM (
      SELECT task_id, sequence, max(sequence) OVER (PARTITION BY task_id ORDER BY arrival, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM tev) WHERE sequence <= prev""", "tev")
def _(i):
    return T.sequence_violations(i.task_events(), ["arrival", "sequence"]).select("task_id", "sequence", "previous_sequence")


@query("task_rows", """
    SELECT task_id, arg_min(phase_name, sequence) AS kind, arg_max(state, sequence) AS state, arg_max(phase_name, sequence) AS phase, arg_max(progress, sequence) AS progress,
           arg_max(state, sequence) IN ('cancelling', 'cancelled') AS cancellation_requested, CASE WHEN arg_max(recoverable, sequence) THEN 'failed' END AS error_code,
           arg_max(recoverable, sequence) AS recoverable, epoch_us(arg_min(timestamp, sequence)) AS created_us, epoch_us(arg_max(timestamp, sequence)) AS updated_us FROM tev GROUP BY task_id""", "tev")
def _(i):
    return T.task_rows(i.task_events()).select("task_id", "kind", "state", "phase", "progress", "cancellation_requested", "error_code", "recoverable",
                                               F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


@query("task_event_log", """
    SELECT task_id, segment, string_agg(sequence || ':' || state, ',' ORDER BY sequence) AS log, max(sequence) AS last_sequence
    FROM (SELECT *, (row_number() OVER (PARTITION BY task_id ORDER BY sequence) - 1) // 40 AS segment FROM tev) GROUP BY task_id, segment""", "tev")
def _(i):
    log = T.task_event_log(i.task_events(), segment=40)
    line = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["sequence"].cast("string"), e["state"])), ",")
    return log.select("task_id", "segment", line.alias("log"), "last_sequence")


@query("maximum_sequence", "SELECT max(sequence) AS maximum_sequence FROM tev", "tev")
def _(i):
    return T.maximum_sequence(i.task_events())


@query("log_consistency", """
    SELECT task_id, CASE WHEN task_id % 10 = 0 THEN 'queued' ELSE state END AS state, state AS log_state FROM latest WHERE task_id % 10 = 0 AND state <> 'queued'""", "latest")
def _(i):
    state = F.when(F.col("task_id") % 10 == 0, "queued").otherwise(F.col("state"))
    rows = T.task_rows(i.task_events()).select("task_id", state.alias("state"))
    return T.log_consistency(rows, i.task_events())


@query("interrupted_tasks", f"""
    SELECT task_id, (SELECT max(sequence) FROM tev) + row_number() OVER (ORDER BY task_id) AS sequence, epoch_us({NOW_SQL}) AS at_us, 'failed_interrupted' AS state, phase_name
    FROM latest WHERE state IN ('running', 'cancelling')""", "latest", "tev")
def _(i):
    return _event(T.interrupted_tasks(i.task_events(), now()))


@query("status_rollup", """
    WITH l AS (SELECT *, task_id % 7 AS team, CASE phase_name WHEN 'phase-0' THEN 'web Search' WHEN 'phase-1' THEN 'build page' ELSE phase_name END AS ph FROM latest),
    g AS (SELECT team, arg_max(state, sequence) FILTER (WHERE state IN ('cancelling', 'queued', 'running')) AS a, arg_max(ph, sequence) FILTER (WHERE state IN ('cancelling', 'queued', 'running')) AS p, arg_max(state, sequence) AS z FROM l GROUP BY team)
    SELECT team, CASE WHEN a = 'cancelling' THEN 'cancelling' WHEN a IS NOT NULL AND regexp_matches(p, '(?i)research|fetch|search') THEN 'researching'
                      WHEN a IS NOT NULL AND regexp_matches(p, '(?i)creat|generat|build|image') THEN 'creating' WHEN a IS NOT NULL THEN 'thinking'
                      WHEN z = 'failed' THEN 'error' WHEN z = 'completed' THEN 'completed' ELSE 'idle' END AS status FROM g""", "latest")
def _(i):
    p = F.col("phase_name")
    named = F.when(p == "phase-0", "web Search").when(p == "phase-1", "build page").otherwise(p)
    last = T.latest_event(i.task_events()).withColumn("phase_name", named).withColumn("team", F.col("task_id") % 7)
    return T.status_rollup(last, ["team"])
