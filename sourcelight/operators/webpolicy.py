"""Search requests, public-web URL rules and request budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcelight import constants as K
from sourcelight.functions.text import ascii_lower, col, strip_ws, truncate_utf8


def normalize_queries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean the queries of each request (request_id, position, query); returns (queries, rejected).

    The first of several spellings is kept, at most five remain, and one bad query rejects the request.
    Everything is an aggregate per (request, query), so a request of any size is handled in parts.
    """
    text = strip_ws("query")
    bad = (text == "") | (F.octet_length(text) > K.MAX_QUERY_BYTES)
    kept = df.select("request_id", "position", text.alias("query"), bad.alias("bad")).groupBy(
        "request_id", ascii_lower("query").alias("folded")
    ).agg(F.min(F.struct("position", "query")).alias("q"), F.bool_or("bad").alias("bad"))
    judged = kept.groupBy("request_id").agg(
        F.when(F.bool_or("bad"), "invalid_query").when(F.count(F.lit(1)) > K.MAX_QUERIES, "too_many_queries").alias("reason")
    )
    good = judged.filter("reason is null").select("request_id")
    order = Window.partitionBy("request_id").orderBy("q.position")  # five rows at most
    queries = kept.join(good, "request_id", "left_semi").select(
        "request_id", F.row_number().over(order).cast("bigint").alias("place"), F.col("q.query").alias("query")
    )
    return queries, judged.filter("reason is not null")


def url_parts(url) -> Column:
    """Scheme, credentials, host, port, path, query and whether a fragment is present."""
    url = col(url)
    scheme = ascii_lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(url, r"\A[^:]+:[/\\]*([^/\\?#]*)", 1)
    place = F.regexp_extract(authority, r"([^@]*)\z", 1)
    host = F.regexp_extract(place, r"\A(\[[^\]]*\]|[^:]*)", 1)
    return F.struct(
        scheme.alias("scheme"),
        F.regexp_extract(authority, r"\A(.*)@[^@]*\z", 1).alias("userinfo"),
        F.regexp_replace(ascii_lower(host), r"\A[\[\]]+|[\[\]]+\z|\.+\z", "").alias("host"),
        F.regexp_extract(place, r":(\d+)\z", 1).alias("port"),
        F.regexp_extract(url, r"\A[^:]+:[/\\]*[^/\\?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"\A[^?#]*(\?[^#]*)", 1).alias("query"),
        F.contains(url, F.lit("#")).alias("fragment"),
    )


def _ipv4(host: Column) -> Column:
    """Address value of a dotted, hexadecimal, octal or short IPv4 host; -1 when numeric but not valid."""
    parts = F.split(host, r"\.")
    value = lambda p: (
        F.when(p.rlike(r"\A0x[0-9a-f]{0,8}\z"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 8)), 16, 10))
        .when(p.rlike(r"\A0[0-7]{1,11}\z"), F.conv(p, 8, 10))
        .when(p.rlike(r"\A(0|[1-9][0-9]{0,10})\z"), p)
        .try_cast("bigint")
    )
    nums = F.transform(parts, value)
    n = F.size(parts)
    last = F.element_at(nums, -1)
    lead = F.slice(nums, F.lit(1), n - 1)
    upper = F.aggregate(lead, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)
    whole = upper * F.pow(F.lit(256), 5 - n).cast("bigint") + last
    ok = (n <= 4) & F.forall(nums, lambda x: x.isNotNull()) & F.forall(lead, lambda x: x < 256) & (last < F.pow(F.lit(256), 5 - n))
    numeric = F.element_at(parts, -1).rlike(r"\A(\d+|0x[0-9a-f]*)\z")
    return F.when(numeric, F.when(ok, whole).otherwise(-1))


# First address and prefix length of IPv4 ranges that are not public.
IPV4_RANGES = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("255.255.255.255", 32),
]


def _private_v4(address: Column) -> Column:
    hit = F.lit(False)
    for first, prefix in IPV4_RANGES:
        a, b, c, d = (int(x) for x in first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        hit = hit | address.between(low, low + 2 ** (32 - prefix) - 1)
    return hit


def _private_v6(host: Column) -> Column:
    return host.rlike(r"\A[0:]+\z|\A[0:]*:0*1\z|\Af[cd][0-9a-f]{2}:|\Afe[89ab][0-9a-f]:|\Aff[0-9a-f]{2}:")


def url_policy(df: DataFrame, url: str = "url", blocked: DataFrame | None = None) -> DataFrame:
    """Add host, normalised URL and the first rule that the URL breaks.

    ``blocked``: domain; the domain and all its subdomains are refused. Hosts meet the list by an equi-join
    on their suffixes, one row per distinct host.
    """
    rows = df.withColumn("__p", url_parts(url)).withColumn("host", F.col("__p.host"))
    host = F.col("host")
    listed = F.lit(False)
    if blocked is not None:
        labels = F.split("host", r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        names = blocked.select(F.regexp_replace(ascii_lower(strip_ws("domain")), r"\A[\[\]]+|[\[\]]+\z|\.+\z", "").alias("suffix"))
        hit = (
            rows.select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
            .join(names.filter("suffix <> ''").distinct(), "suffix").select("host").distinct().withColumn("__hit", F.lit(True))
        )
        rows = rows.join(hit, "host", "left")
        listed = F.coalesce("__hit", F.lit(False))
    local = host == "localhost"
    for suffix in K.BLOCKED_SUFFIXES:
        local = local | host.endswith(suffix)
    v4 = _ipv4(host)
    bad_host = (host == "") | host.rlike(r"[\s/<>^|%]") | F.coalesce(v4 == -1, F.lit(False))
    scheme = F.col("__p.scheme")
    web = scheme.isin("http", "https")
    reason = (
        F.when(F.col(url).rlike(r"(?U)\s"), "invalid_url")
        .when((scheme == "") | (web & bad_host), "invalid_url")
        .when(~web, "unsupported_scheme")
        .when((F.col("__p.userinfo") != "") | F.col("__p.fragment"), "unsafe_url_metadata")
        .when(local | listed, "blocked_domain")
        .when(F.when(host.contains(":"), _private_v6(host)).otherwise(F.coalesce(_private_v4(v4), F.lit(False))), "non_public_address")
    )
    default_port = ((scheme == "http") & (F.col("__p.port") == "80")) | ((scheme == "https") & (F.col("__p.port") == "443"))
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    normal = F.concat(
        scheme, F.lit("://"), shown,
        F.when((F.col("__p.port") == "") | default_port, "").otherwise(F.concat(F.lit(":"), F.col("__p.port"))),
        F.when(F.col("__p.path") == "", "/").otherwise(F.col("__p.path")), F.col("__p.query"),
    )
    return rows.select(*df.columns, "host", F.when(reason.isNull(), normal).alias("normal_url"), reason.alias("reason"))


def dedup_results(results: DataFrame, blocked: DataFrame | None = None, limit: int = K.MAX_RESULTS) -> DataFrame:
    """Search results per request (request_id, query_place, result_place, url, title, snippet, engine).

    Results with a refused URL go, the first of each normalised URL stays, and the first 50 are kept.
    """
    allowed = url_policy(results, "url", blocked).filter("reason is null")
    rest = [c for c in results.columns if c not in ("request_id", "url")]
    first = allowed.groupBy("request_id", "normal_url").agg(
        F.min_by(F.struct(*rest), F.struct("query_place", "result_place")).alias("r")
    ).select("request_id", "normal_url", "r.*")
    order = Window.partitionBy("request_id").orderBy("query_place", "result_place", "normal_url")
    cut = {c: truncate_utf8(c, K.MAX_RESULT_TEXT_BYTES) for c in ("title", "snippet")}
    return (
        first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
        .withColumn("place", F.col("place").cast("bigint")).withColumns(cut)
    )


def budget_check(df: DataFrame) -> DataFrame:
    """Add the first fault of each request budget: schema version, zero fields, fields over the limit."""
    reason = F.when(F.col("schema_version") != 1, "unsupported_schema")
    for name in K.BUDGET_NONZERO:
        reason = reason.when(F.col(name) == 0, f"invalid_budget:{name}")
    for name, limit in K.BUDGET_LIMITS.items():
        reason = reason.when(F.col(name) > limit, f"excessive_budget:{name}")
    return df.withColumn("reason", reason)
