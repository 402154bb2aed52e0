"""Registered queries: search requests, URL rules, budgets and integrity scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcelight.operators import checks, webpolicy
from sourcelight.plans.registry import query


@query("normalize_queries", r"""
    WITH q AS (SELECT conv_id AS request_id, turn AS position, CASE WHEN conv_id % 8 = 7 AND turn = 0 THEN ' ' WHEN turn % 3 = 2 THEN upper('again') WHEN turn % 3 = 1 THEN ' again ' ELSE ' ' || text || ' ' END AS query FROM conversations),
    k AS (SELECT request_id, lower(trim(query)) AS f, min(position) AS position, arg_min(trim(query), position) AS query, bool_or(trim(query) = '' OR strlen(trim(query)) > 512) AS bad FROM q GROUP BY ALL),
    r AS (SELECT request_id, bool_or(bad) AS bad, count(*) AS n FROM k GROUP BY request_id)
    SELECT request_id, CASE WHEN r.bad THEN 'invalid_query' WHEN n > 5 THEN 'too_many_queries' END AS reason, CASE WHEN NOT r.bad AND n <= 5 THEN string_agg(query, '|' ORDER BY position) END AS queries
    FROM k JOIN r USING (request_id) GROUP BY request_id, r.bad, n""")
def _(i):
    c, t = F.col("conv_id"), F.col("turn")
    text = (F.when((c % 8 == 7) & (t == 0), " ").when(t % 3 == 2, "AGAIN").when(t % 3 == 1, " again ")
            .otherwise(F.concat(F.lit(" "), "text", F.lit(" "))))
    rows = i.table("conversations").select(c.alias("request_id"), t.alias("position"), text.alias("query"))
    good, bad = webpolicy.normalize_queries(rows)
    lists = good.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", "query"))).alias("q"))
    kept = lists.select("request_id", F.lit(None).cast("string").alias("reason"), F.array_join("q.query", "|").alias("queries"))
    return kept.unionByName(bad.select("request_id", "reason", F.lit(None).cast("string").alias("queries")))


SHAPED = """
    SELECT page_id, CASE page_id % 10 WHEN 5 THEN replace(url, '://', '://user:pw@') WHEN 6 THEN 'ftp' || substr(url, 5) WHEN 7 THEN 'http://10.1.2.' || (page_id % 250) || '/x'
           WHEN 8 THEN 'http://host' || page_id || '.local/' WHEN 9 THEN url || ' ' ELSE url END AS url FROM pages"""


def shaped(i):
    """Page URLs, half of them damaged by rule: credentials, other scheme, private address, local name, blank."""
    p, u = F.col("page_id"), F.col("url")
    return i.table("pages").select("page_id", (
        F.when(p % 10 == 5, F.replace(u, F.lit("://"), F.lit("://user:pw@"))).when(p % 10 == 6, F.concat(F.lit("ftp"), F.substring(u, 5, 10_000)))
        .when(p % 10 == 7, F.concat(F.lit("http://10.1.2."), (p % 250).cast("string"), F.lit("/x"))).when(p % 10 == 8, F.concat(F.lit("http://host"), p.cast("string"), F.lit(".local/")))
        .when(p % 10 == 9, F.concat(u, F.lit(" "))).otherwise(u)).alias("url"))


POLICY = f"""
    SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]*)', 1)) AS host,
           CASE WHEN regexp_matches(url, '\\s') THEN 'invalid_url' WHEN NOT regexp_matches(url, '^https?:') THEN 'unsupported_scheme'
                WHEN regexp_matches(url, '^https?://[^/]*@') OR contains(url, '#') THEN 'unsafe_url_metadata'
                WHEN regexp_matches(lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)), '(^|\\.)(localhost|local|lan|internal|home\\.arpa|example\\.net)$') THEN 'blocked_domain'
                WHEN regexp_matches(url, '^https?://10\\.') THEN 'non_public_address' END AS reason FROM ({SHAPED})"""


def blocked(i):
    return i.spark.range(1).select(F.lit(" Example.NET. ").alias("domain"))


@query("url_policy", POLICY)
def _(i):
    return webpolicy.url_policy(shaped(i), "url", blocked(i)).select("page_id", "url", "host", "reason")


@query("dedup_results", f"""
    WITH r AS (SELECT page_id % 5 AS request_id, page_id % 3 AS query_place, page_id AS result_place, regexp_replace(url, '[?].*$', '') AS url FROM pages),
    ok AS (SELECT * FROM r WHERE NOT contains(url, '#') AND NOT regexp_matches(lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)), '(^|\\.)example\\.net$')),
    f AS (SELECT *, row_number() OVER (PARTITION BY request_id, url ORDER BY query_place, result_place) AS n FROM ok),
    p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY query_place, result_place) AS place FROM f WHERE n = 1)
    SELECT request_id, place, url AS normal_url, result_place FROM p WHERE place <= 50""")
def _(i):
    p = F.col("page_id")
    rows = i.table("pages").select((p % 5).alias("request_id"), (p % 3).alias("query_place"), p.alias("result_place"), F.regexp_replace("url", r"[?].*\z", "").alias("url"),
                                   F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("snippet"))
    return webpolicy.dedup_results(rows, blocked(i)).select("request_id", "place", "normal_url", "result_place")


@query("budget_check", """
    SELECT page_id, CASE WHEN page_id % 7 = 6 THEN 'unsupported_schema' WHEN page_id % 5 = 0 THEN 'invalid_budget:max_documents' WHEN len(url) % 4 = 0 THEN 'invalid_budget:max_pages_per_origin'
                         WHEN page_id % 4 = 3 THEN 'excessive_budget:crawl_depth' WHEN page_id % 50 > 40 THEN 'excessive_budget:max_documents' WHEN length(html) * 100000 > 262144000 THEN 'excessive_budget:max_download_bytes' END AS reason FROM pages""")
def _(i):
    p = F.col("page_id")
    rows = i.table("pages").select(
        "page_id", F.when(p % 7 == 6, 2).otherwise(1).alias("schema_version"), F.when(p % 5 == 0, 0).otherwise(p % 50).alias("max_documents"),
        (F.char_length("html") * F.lit(100000).cast("bigint")).alias("max_download_bytes"), F.lit(60).alias("max_duration_seconds"),
        (F.char_length("url") % 4).alias("max_pages_per_origin"), F.lit(2).alias("max_concurrent_requests"), F.lit(500).alias("min_origin_interval_ms"), (p % 4).alias("crawl_depth"))
    return webpolicy.budget_check(rows).select("page_id", "reason")


MARKERS = ["and the", "é", "<script>", "zzzz"]


@query("marker_scan", f"""
    SELECT path, marker, strlen(string_split(content, marker)[1]) AS byte_offset FROM (
      SELECT 'p/' || page_id AS path, html AS content FROM pages UNION ALL SELECT 'd/' || doc_id, text FROM documents), (SELECT unnest({MARKERS!r}) AS marker)
    WHERE contains(content, marker)""")
def _(i):
    files = i.table("pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("content")).unionByName(
        i.table("documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")))
    return checks.marker_scan(files, MARKERS)


@query("enum_constraints", """
    SELECT 'messages' AS table_name, conv_id || '-' || turn AS row_key, 'role' AS column_name, role AS value FROM conversations WHERE role NOT IN ('user', 'assistant')
    UNION ALL SELECT 'sources', CAST(source_id AS VARCHAR), 'authority_tier', CAST(authority_tier + 2 AS VARCHAR) FROM library WHERE authority_tier + 2 > 4
    UNION ALL SELECT 'sources', CAST(source_id AS VARCHAR), 'state', state || '?' FROM library WHERE source_id % 25 = 0""", "library")
def _(i):
    messages = i.table("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "role")
    state = F.when(F.col("source_id") % 25 == 0, F.concat("state", F.lit("?"))).otherwise(F.col("state"))
    sources = i.sources().select("source_id", "kind", (F.col("authority_tier") + 2).alias("authority_tier"), state.alias("state"))
    return checks.enum_constraints(messages, "messages", "key").unionByName(checks.enum_constraints(sources, "sources", "source_id"))


@query("referential_check", """
    SELECT 'labels.doc_id' AS relation, CAST(doc_id + 5 AS VARCHAR) AS row_key, CAST(doc_id + 5 AS VARCHAR) AS missing_key FROM labels WHERE doc_id + 5 NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'messages.conversation_id', conv_id || '-' || turn, CAST(conv_id AS VARCHAR) FROM conversations WHERE conv_id NOT IN (SELECT conversation_id FROM convs)
    UNION ALL SELECT 'events.task_id', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR) FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)""", "convs")
def _(i):
    labels = i.table("labels").select((F.col("doc_id") + 5).alias("doc_id"))
    messages = i.table("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("conv_id").alias("conversation_id"))
    events = i.table("events").select("event_id", F.col("user_id").alias("task_id"))
    tasks = i.table("documents").filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("task_id"))
    return checks.referential_check([
        ("labels.doc_id", labels, "doc_id", "doc_id", i.table("documents"), "doc_id"),
        ("messages.conversation_id", messages, "key", "conversation_id", i.conversations(), "conversation_id"),
        ("events.task_id", events, "event_id", "task_id", tasks, "task_id"),
    ])


