"""Registered queries: files, extraction, chunking, stored objects and versions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sourcelight.functions.text import file_path, file_uri, mime_type, normalize_text
from sourcelight.operators import catalog, chunking
from sourcelight.plans.inputs import NOW_SQL, now
from sourcelight.plans.registry import query
from sourcelight.sources.files import path_in_root, write_table
from sourcelight.session import scratch_dir


@query("path_in_root", """
    SELECT path, CASE WHEN list_has_any(string_split(path, '/'), ['.', '..']) OR NOT (path = '/d/src1' OR starts_with(path, '/d/src1/')) THEN 'outside_root' END AS reason
    FROM (SELECT '/d/' || source || CASE WHEN doc_id % 5 = 0 THEN '0' ELSE '' END || CASE doc_id % 7 WHEN 3 THEN '/../x/' WHEN 4 THEN '/./' WHEN 5 THEN '/..x/' ELSE '/' END || doc_id AS path FROM documents)""")
def _(i):
    # A sibling folder whose name merely begins with the root's name is outside, and so are dot components.
    d = F.col("doc_id")
    paths = i.table("documents").select(F.concat(F.lit("/d/"), "source", F.when(d % 5 == 0, "0").otherwise(""),
        F.when(d % 7 == 3, "/../x/").when(d % 7 == 4, "/./").when(d % 7 == 5, "/..x/").otherwise("/"), d.cast("string")).alias("path"))
    return path_in_root(paths, "/d/src1/")


@query("file_uri", r"""
    SELECT doc_id, 'file://' || replace(replace(url_encode(path), '%2F', '/'), '+', '%20') AS uri, path AS decoded
    FROM (SELECT doc_id, '/d/' || source || '/' || text AS path FROM documents)""")
def _(i):
    path = F.concat(F.lit("/d/"), "source", F.lit("/"), "text")
    rows = i.table("documents").select("doc_id", file_uri(path).alias("uri"))
    return rows.withColumn("decoded", file_path("uri"))


@query("mime_detect", "SELECT path, mime_type FROM files", "files")
def _(i):
    return i.files().select("path", "mime_type")


@query("extraction_state", """
    SELECT path, CASE WHEN ok THEN 'active' ELSE 'unsupported' END AS state, CASE WHEN ok THEN 'ready' ELSE 'unsupported' END AS processing_state,
           CASE WHEN NOT ok THEN 'no_text_format' END AS reason
    FROM (SELECT path, mime_type LIKE 'text/%' OR mime_type IN ('application/json', 'application/yaml', 'application/xml') AS ok FROM files)""", "files")
def _(i):
    return catalog.extraction_state(i.files()).select("path", "state", "processing_state", "reason")


@query("normalize_text", r"""
    SELECT doc_id, md5(replace(replace(replace(regexp_replace(raw, '^\x{FEFF}', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), 'x', 'x')) AS text_md5
    FROM (SELECT doc_id, chr(65279) || replace(replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) ELSE chr(13) END), '. ', chr(65279) || '. ') AS raw FROM documents)""")
def _(i):
    # Line ends and byte order marks put in by rule.
    ends = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")
    raw = F.concat(F.lit("﻿"), F.replace(F.replace("text", F.lit("\n"), ends), F.lit(". "), F.lit("﻿. ")))
    return i.table("documents").select("doc_id", F.md5(normalize_text(raw)).alias("text_md5"))


@query("chunk_text", r"""
    SELECT chunk_id, ordinal, md5(body) AS body_md5, char_start, char_start + length(body) AS char_end,
           strlen(text[1 : CAST(char_start AS BIGINT)]) AS byte_start, strlen(text[1 : CAST(char_start AS BIGINT)]) + strlen(body) AS byte_end,
           1 + length(p) - length(replace(p, chr(10), '')) AS line_start,
           1 + length(p) - length(replace(p, chr(10), '')) + length(body) - length(replace(body, chr(10), '')) AS line_end, token_count
    FROM (SELECT *, text[1 : CAST(char_start AS BIGINT)] AS p FROM chunks)""", "chunks")
def _(i):
    return i.chunks().select("chunk_id", "ordinal", F.md5("body").alias("body_md5"), "char_start", "char_end", "byte_start", "byte_end",
                             "line_start", "line_end", "token_count")


@query("chunk_heading", r"""
    WITH marked AS (SELECT doc_id, '# ' || replace(text, chr(10), chr(10) || CASE doc_id % 3 WHEN 0 THEN '  ## ' WHEN 1 THEN '#' || chr(10) ELSE '' END) AS text FROM documents),
    cut AS (SELECT doc_id, text, t, unnest(range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 500 THEN 1 ELSE 1 + CAST(ceil((len(t) - 500) / 425.0) AS BIGINT) END)) AS ordinal
            FROM (SELECT *, regexp_extract_all(text, '\S+\s*') AS t FROM marked)),
    seen AS (SELECT doc_id, ordinal, regexp_extract_all(array_to_string(t[1 : ordinal * 425], ''), '(?:^|\n)[ \t]*(#[^\n]*)', 1) AS h FROM cut)
    SELECT doc_id, ordinal, nullif(regexp_replace(regexp_replace(h[-1], '^#+\s*', ''), '\s+$', ''), '') AS heading FROM seen""")
def _(i):
    # Heading lines put in by rule: one in front, then on every line, as empty headings, or none.
    d = F.col("doc_id")
    mark = F.when(d % 3 == 0, "\n  ## ").when(d % 3 == 1, "\n#\n").otherwise("\n")
    rows = i.texts().select("doc_id", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), mark)).alias("text"))
    return chunking.chunk_text(rows, headings=True).select("doc_id", "ordinal", "heading")


PAGED = r"SELECT doc_id, replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(12) ELSE chr(12) || chr(12) END) || CASE WHEN doc_id % 3 = 0 THEN chr(12) ELSE '' END AS text FROM documents"


def _paged(i):
    """Line ends turned into form feeds by rule, some doubled (an empty page) and some at the end."""
    d = F.col("doc_id")
    feed = F.when(d % 2 == 0, "\f").otherwise("\f\f")
    return i.texts().select("doc_id", F.concat(F.replace("text", F.lit("\n"), feed), F.when(d % 3 == 0, "\f").otherwise("")).alias("text"))


@query("chunk_pages", rf"""
    WITH paged AS ({PAGED}), pages_of AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS p, generate_subscripts(string_split(text, chr(12)), 1) AS page FROM paged),
    toks AS (SELECT doc_id, page, regexp_extract_all(p, '\S+\s*') AS t FROM pages_of),
    cut AS (SELECT *, unnest(range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 500 THEN 1 ELSE 1 + CAST(ceil((len(t) - 500) / 425.0) AS BIGINT) END)) AS page_ordinal FROM toks)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, page_ordinal) - 1 AS ordinal, page, page_ordinal, md5(regexp_replace(array_to_string(t[page_ordinal * 425 + 1 : page_ordinal * 425 + 500], ''), '\s+$', '')) AS body_md5 FROM cut""")
def _(i):
    return chunking.chunk_pages(_paged(i)).select("doc_id", "ordinal", "page", "page_ordinal", F.md5("body").alias("body_md5"))


@query("page_text_coverage", rf"""
    WITH paged AS ({PAGED}), split AS (SELECT doc_id, string_split(text, chr(12)) AS p FROM paged),
    kept AS (SELECT doc_id, CASE WHEN len(p) > 1 AND p[-1] = '' THEN p[1 : len(p) - 1] ELSE p END AS p FROM split)
    SELECT doc_id, len(p) AS pages, len(list_filter(p, lambda x: NOT regexp_matches(x, '\S'))) AS blank_pages,
           len(list_filter(p, lambda x: regexp_matches(x, '\S'))) > 0 AS has_embedded_text, len(p) > 10000 AS over_limit FROM kept""")
def _(i):
    return chunking.page_text_coverage(_paged(i))


REFS = """
    refs AS (SELECT sha256(text) AS sha256, strlen(text) AS n, mime_type FROM files
             UNION ALL SELECT sha256(text), strlen(text), 'text/plain' FROM files
             UNION ALL SELECT sha256(body), strlen(body), 'text/plain' FROM chunks
             UNION ALL SELECT sha256(text), strlen(text), 'text/plain' FROM conversations)"""


def references(i):
    """Originals, extractions, passages and messages as references to stored objects."""
    files = i.files()
    parts = [
        catalog.object_references(files, "content", F.col("mime_type")),
        catalog.object_references(i.table("documents"), "text", "text/plain"),
        catalog.object_references(i.chunks(), "body", "text/plain"),
        catalog.object_references(i.table("conversations"), "text", "text/plain"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("content_objects", f"""
    WITH {REFS}
    SELECT sha256, uncompressed_length, mime_type, CASE WHEN mime_type = 'application/octet-stream' THEN 'binary' ELSE 'text' END AS compression_class,
           CAST(CASE WHEN mime_type = 'application/octet-stream' THEN 3 ELSE 6 END AS BIGINT) AS compression_level, reference_count
    FROM (SELECT sha256, min(n) AS uncompressed_length, min(mime_type) AS mime_type, count(*) AS reference_count FROM refs GROUP BY sha256)""", "files", "chunks")
def _(i):
    return catalog.content_objects(references(i))


@query("verify_objects", """
    SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'invalid_hash' WHEN strlen(text) > 4000 THEN 'read_limit_exceeded'
                        WHEN doc_id % 10 = 2 THEN 'checksum_mismatch' END AS reason FROM documents""")
def _(i):
    d = F.col("doc_id")
    good = F.sha2("text", 256)
    named = F.when(d % 10 == 1, F.upper(F.concat(good, F.lit("x")))).when(d % 10 == 2, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(good)
    rows = i.table("documents").select("doc_id", named.alias("sha256"), F.col("text").alias("payload"))
    return catalog.verify_objects(rows, limit=4000).select("doc_id", "reason")


def history(i):
    """Documents as versions of their source, in id order; every eleventh extraction fails."""
    d = F.col("doc_id")
    return i.table("documents").select(F.col("source").alias("source_id"), d.alias("version_id"), d.alias("seq"), (d % 11 != 0).alias("extraction_ok"))


HISTORY = "SELECT source AS source_id, doc_id AS version_id, doc_id AS seq, doc_id % 11 <> 0 AS ok FROM documents"


@query("version_chain", f"""
    WITH h AS ({HISTORY}), w AS (
      SELECT *, row_number() OVER p AS rn, first_value(version_id) OVER p AS first,
             last_value(CASE WHEN ok THEN version_id END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM h WINDOW p AS (PARTITION BY source_id ORDER BY seq))
    SELECT source_id, version_id, seq, ok AS extraction_ok, CASE WHEN ok AND rn > 1 THEN coalesce(prev, first) END AS superseded_version_id,
           CASE WHEN ok THEN version_id ELSE coalesce(prev, first) END AS current_version_id FROM w""")
def _(i):
    return catalog.version_chain(history(i))


@query("current_versions", f"""
    SELECT source_id, coalesce(max(CASE WHEN ok THEN version_id END), min(version_id)) AS current_version_id FROM ({HISTORY}) GROUP BY source_id""")
def _(i):
    return catalog.current_versions(history(i))


@query("append_chunks", """
    SELECT version_id, seq, coalesce(top, 0) + row_number() OVER (PARTITION BY version_id ORDER BY seq) - 1 AS ordinal
    FROM (SELECT conv_id AS version_id, turn AS seq FROM conversations) LEFT JOIN (SELECT version_id, max(ordinal) + 1 AS top FROM chunks GROUP BY version_id) USING (version_id)""", "chunks")
def _(i):
    new = i.table("conversations").select(F.col("conv_id").alias("version_id"), F.col("turn").alias("seq"))
    return catalog.append_chunks(i.chunk_places(), new, ["seq"])


@query("remove_derived_chunks", """
    WITH c AS (SELECT version_id, chunk_id, ordinal, body, ordinal % 2 = 1 AS ocr FROM chunks),
    gone AS (SELECT version_id, chunk_id FROM c WHERE ocr AND (version_id % 4 = 0 OR (version_id % 4 = 1 AND ordinal = 1)))
    SELECT v.version_id, md5(string_agg(c.body, chr(10) || chr(10) ORDER BY ordinal)) AS text_md5, count(c.chunk_id) AS kept
    FROM (SELECT DISTINCT version_id FROM c WHERE version_id % 4 < 2) v LEFT JOIN (SELECT * FROM c WHERE ocr AND chunk_id NOT IN (SELECT chunk_id FROM gone)) c USING (version_id)
    GROUP BY v.version_id""", "chunks")
def _(i):
    # Odd passages stand for recognised text; some versions lose all of it and some the first piece.
    chunks = i.chunks().select("version_id", "chunk_id", "ordinal", "body", (F.col("ordinal") % 2 == 1).alias("ocr"))
    v = F.col("version_id")
    removals = chunks.filter(v % 4 < 2).select("version_id", F.when(v % 4 == 1, v * 1000000 + 1).alias("chunk_id")).distinct()
    remaining, text = catalog.remove_derived_chunks(chunks, removals)
    kept = remaining.filter("ocr").groupBy("version_id").agg(F.count(F.lit(1)).alias("kept"))
    return text.join(kept, "version_id", "left").select("version_id", F.md5("recognised_text").alias("text_md5"), F.coalesce("kept", F.lit(0)).alias("kept"))


@query("ocr_confidence", """
    SELECT image_id, mode, round(avg(CASE WHEN word <> ' ' AND confidence >= 0 THEN confidence END), 6) AS confidence
    FROM (SELECT user_id AS image_id, event_id % 14 AS mode, CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END AS word, value - 20 AS confidence FROM events) GROUP BY ALL""")
def _(i):
    # Events as recognised words: users as images, the value as confidence.
    t = F.col("event_type")
    rows = i.table("events").select(F.col("user_id").alias("image_id"), (F.col("event_id") % 14).alias("mode"),
                                    F.when(t == "view", " ").otherwise(t).alias("word"), (F.col("value") - 20).alias("confidence"))
    return catalog.ocr_confidence(rows, ["image_id", "mode"])


@query("ocr_first_accepted", """
    WITH a AS (SELECT user_id AS image_id, event_id % 14 AS mode, CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END AS text,
                      CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS confidence FROM events),
    g AS (SELECT image_id, mode, max(coalesce(confidence, 1000)) AS c, CAST(count(*) AS BIGINT) AS n FROM a WHERE text <> ' ' GROUP BY ALL)
    SELECT image_id, mode, threshold, n FROM g, (SELECT unnest([55.0, 45.0, 35.0, 25.0]::DOUBLE[]) AS threshold) WHERE c >= threshold
    QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY threshold DESC, mode) = 1""")
def _(i):
    t, e = F.col("event_type"), F.col("event_id")
    rows = i.table("events").select(F.col("user_id").alias("image_id"), (e % 14).alias("mode"), F.when(t == "view", " ").otherwise(t).alias("text"),
                                    F.when(e % 97 == 0, 1000.0).otherwise(F.col("value")).alias("confidence"))
    best = rows.filter("text <> ' '").groupBy("image_id", "mode").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    attempts = best.select("image_id", "mode", F.when(F.col("confidence") < 1000, F.col("confidence")).alias("confidence"), F.col("n").cast("string").alias("text"))
    return catalog.ocr_first_accepted(attempts).select("image_id", "mode", "threshold", F.col("text").cast("bigint").alias("n"))


@query("watch_diff", """
    WITH src AS (SELECT doc_id, '/w/' || doc_id AS path, md5(text) AS stored, state, watch_paused FROM (SELECT *, source_id AS doc_id FROM library) WHERE doc_id % 7 <> 6),
    seen AS (SELECT '/w/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN md5(text || 'x') ELSE md5(text) END AS fp FROM documents WHERE doc_id % 8 <> 7),
    base AS (SELECT '/w/' || doc_id AS path, md5(text) AS fp0 FROM documents WHERE doc_id % 2 = 0)
    SELECT path, status FROM (
      SELECT path, CASE WHEN s.path IS NOT NULL AND fp IS NULL THEN CASE WHEN state <> 'missing' THEN 'missing' END
                        WHEN s.path IS NOT NULL THEN CASE WHEN state = 'missing' THEN 'reappeared' WHEN stored <> fp THEN 'changed' ELSE 'unchanged' END
                        WHEN fp0 IS NULL OR fp0 <> fp THEN 'new' END AS status
      FROM (SELECT * FROM src WHERE state <> 'deleted' AND NOT watch_paused) s FULL JOIN seen USING (path) LEFT JOIN base USING (path)) WHERE status IS NOT NULL""", "library")
def _(i):
    d = F.col("doc_id")
    texts = i.table("documents").select("doc_id", F.concat(F.lit("/w/"), d.cast("string")).alias("path"), F.md5("text").alias("same"), F.md5(F.concat("text", F.lit("x"))).alias("other"))
    states = i.sources().select(F.col("source_id").alias("doc_id"), "state", "watch_paused")
    stored = texts.filter(d % 7 != 6).join(states, "doc_id").select("path", F.col("same").alias("fingerprint"), "state", "watch_paused")
    listing = texts.filter(d % 8 != 7).select("path", F.when(d % 3 == 0, F.col("other")).otherwise(F.col("same")).alias("fingerprint"))
    baseline = texts.filter(d % 2 == 0).select("path", F.col("same").alias("fingerprint"))
    return catalog.watch_diff(stored, listing, baseline)


@query("source_state_update", f"""
    SELECT source_id, CASE action WHEN 'missing' THEN 'missing' WHEN 'delete' THEN 'deleted' ELSE state END AS state,
           CASE action WHEN 'pause' THEN true WHEN 'resume' THEN false ELSE watch_paused END AS watch_paused,
           epoch_us(CASE WHEN action IN ('missing', 'delete') THEN {NOW_SQL} ELSE last_checked_at END) AS checked_us, epoch_us({NOW_SQL}) AS updated_us
    FROM (SELECT *, (['missing', 'delete', 'pause', 'resume', 'other'])[source_id % 5 + 1] AS action FROM library)
    WHERE state <> 'deleted' AND action <> 'other' AND NOT (action = 'missing' AND state = 'missing')""", "library")
def _(i):
    actions = F.array(*[F.lit(a) for a in ("missing", "delete", "pause", "resume", "other")])
    updates = i.table("documents").select(F.col("doc_id").alias("source_id"), F.get(actions, (F.col("doc_id") % 5).cast("int")).alias("action"))
    changed = catalog.source_state_update(i.sources(), updates, now())
    return changed.select("source_id", "state", "watch_paused", F.unix_micros("last_checked_at").alias("checked_us"), F.unix_micros("updated_at").alias("updated_us"))


@query("sink_partitions", """
    SELECT lang, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks JOIN documents ON doc_id = version_id GROUP BY lang""", "chunks")
def _(i):
    # Write passages partitioned by language, replace the partitions of a second write, read back.
    path = os.path.join(scratch_dir(i.spark), "chunks")
    rows = i.chunks().join(i.table("documents").select(F.col("doc_id").alias("version_id"), "lang"), "version_id")
    rows = rows.select("chunk_id", "version_id", "token_count", "lang")
    write_table(rows, path, partition="lang")
    first = rows.agg(F.min("lang")).first()[0]
    write_table(rows.filter(F.col("lang") == first), path, partition="lang")
    return i.spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
