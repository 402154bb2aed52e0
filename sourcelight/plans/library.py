"""Registered queries: source and asset listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcelight.operators import catalog
from sourcelight.plans.registry import query

COUNTS = "(SELECT version_id, count(*) AS chunk_count FROM chunks GROUP BY version_id)"


@query("list_sources", f"""
    SELECT source_id, version_id, display_name, mime_type, byte_size, coalesce(chunk_count, 0) AS chunk_count, state, epoch_us(updated_at) AS updated_us
    FROM library LEFT JOIN {COUNTS} USING (version_id) WHERE kind = 'local_file' AND state <> 'deleted'""", "library", "chunks")
def _(i):
    rows = catalog.list_sources(i.sources(), i.versions().drop("source_id"), i.chunk_places())
    return rows.select("source_id", "version_id", "display_name", "mime_type", "byte_size", "chunk_count", "state", F.unix_micros("updated_at").alias("updated_us"))


def assets(i, **filters):
    return catalog.list_assets(i.sources(), i.versions().drop("source_id"), i.chunk_places(), **filters)


@query("list_assets", f"""
    SELECT source_id, display_name, kind, state, coalesce(chunk_count, 0) AS chunk_count, count(*) OVER () AS total
    FROM library LEFT JOIN {COUNTS} USING (version_id)
    WHERE state <> 'deleted' AND kind = 'local_file' AND state = 'active' AND (contains(lower(display_name), 'en-1') OR contains(lower(canonical_uri), 'en-1'))""", "library", "chunks")
def _(i):
    rows = assets(i, search="EN-1", kind="local_file", state="active")
    total = catalog.filter_assets(i.sources(), "EN-1", "local_file", "active").agg(F.count(F.lit(1))).scalar()
    return rows.select("source_id", "display_name", "kind", "state", "chunk_count", total.alias("total"))


PAGES = {
    "updated": ("updated_at DESC, source_id DESC", dict(updated_at="2024-03-01 00:00:00", source_id=500),
                "(updated_at < TIMESTAMP '2024-03-01' OR (updated_at = TIMESTAMP '2024-03-01' AND source_id < 500))"),
    "name": ("lower(display_name), source_id", dict(display_name="src1/EN-5.txt", source_id=5),
             "(lower(display_name) > 'src1/en-5.txt' OR (lower(display_name) = 'src1/en-5.txt' AND source_id > 5))"),
    "size": ("byte_size DESC, source_id", dict(byte_size=1200, source_id=100),
             "(byte_size < 1200 OR (byte_size = 1200 AND source_id > 100))"),
    "type": ("lower(mime_type), lower(display_name), source_id", dict(mime_type="text/markdown", display_name="src1", source_id=0),
             "(lower(mime_type) > 'text/markdown' OR (lower(mime_type) = 'text/markdown' AND (lower(display_name) > 'src1' OR (lower(display_name) = 'src1' AND source_id > 0))))"),
}


def _page(sort: str) -> None:
    order, after, where = PAGES[sort]

    @query(f"asset_page_{sort}", f"""
        SELECT source_id, position, display_name, byte_size, n > 40 AS has_more FROM (
          SELECT *, row_number() OVER (ORDER BY {order}) AS position, count(*) OVER () AS n FROM library WHERE state <> 'deleted' AND {where}) WHERE position <= 40""", "library")
    def _(i):
        rows = i.sources().filter("state <> 'deleted'").join(i.versions().drop("source_id"), F.col("current_version_id") == F.col("version_id"))
        cursor = {k: F.to_timestamp(F.lit(v)) if k == "updated_at" else v for k, v in after.items()}
        return catalog.asset_page(rows, sort, cursor).select("source_id", "position", "display_name", "byte_size", "has_more")


for _name in PAGES:
    _page(_name)


@query("asset_cursor", """
    SELECT source_id, rtrim(replace(replace(to_base64(encode('{"sort":"type","primary":"' || mime_type || '","secondary":"' || display_name || '","source_id":"' || source_id || '"}')), '+', '-'), '/', '_'), '=') AS cursor,
           mime_type AS primary_key, display_name AS secondary_key FROM library""", "library")
def _(i):
    rows = i.sources().join(i.versions(), "source_id")
    made = rows.select("source_id", catalog.encode_cursor("type", "mime_type", "display_name", "source_id").alias("cursor"))
    read = made.withColumn("d", catalog.decode_cursor("cursor"))
    return read.select("source_id", "cursor", F.col("d.primary").alias("primary_key"), F.col("d.secondary").alias("secondary_key"))


@query("current_chunks", "SELECT chunk_id, version_id, ordinal, display_name, md5(body) AS body_md5 FROM current", "current")
def _(i):
    return i.joined_current().select("chunk_id", "version_id", "ordinal", "display_name", F.md5("body").alias("body_md5"))
