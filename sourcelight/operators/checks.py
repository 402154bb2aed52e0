"""Scans and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelight import constants as K

def marker_scan(files: DataFrame, markers: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """First byte offset of each marker in each file, whatever the file's size.

    The short list of markers is part of the expression: files are read once and nothing is joined.
    """
    text = F.col(content).cast("string")
    wanted = F.array(*[F.lit(m) for m in markers])
    found = F.transform(wanted, lambda m: F.struct(
        m.alias("marker"),
        F.when(F.contains(text, m), F.octet_length(F.call_function("substring_index", text, m, F.lit(1)))).cast("bigint").alias("byte_offset"),
    ))
    rows = files.select(
        path, F.explode(F.filter(found, lambda x: x["byte_offset"].isNotNull())).alias("f")
    )
    return rows.select(path, "f.marker", "f.byte_offset")


# Fixed values. Table -> [(column, allowed values or (low, high))].
ENUMS = {
    "sources": [
        ("kind", ["local_file", "web_page", "search_result", "generated"]),
        ("authority_tier", (1, 4)),
        ("state", ["active", "missing", "blocked", "unsupported", "deleted"]),
    ],
    "claims": [
        ("status", ["supported", "disputed", "stale", "unverified"]),
        ("confidence", (0.0, 1.0)),
    ],
    "claim_evidence": [("relationship", ["supporting", "contradicting"])],
    "topics": [("coverage_score", (0.0, 100.0))],
    "schedule": [("state", ["scheduled", "claimed", "retry"])],
    "messages": [("role", ["user", "assistant"])],
}


def enum_constraints(df: DataFrame, table: str, key: str) -> DataFrame:
    """Rows that break a value rule of ``table``: table, key, column, value."""
    faults = []
    for name, rule in ENUMS[table]:
        if name not in df.columns:
            continue
        ok = F.col(name).isin(rule) if isinstance(rule, list) else F.col(name).between(*rule)
        faults.append(F.when(~ok, F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"))))
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.explode(F.filter(F.array(*faults), lambda f: f.isNotNull())).alias("f"))
    return rows.select(F.lit(table).alias("table_name"), "row_key", "f.column_name", "f.value")


def referential_check(relations: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Child rows without a parent: (name, child, child key, foreign key, parent, parent key) per relation.

    NULL foreign keys are allowed.
    """
    out = None
    for name, child, key, foreign, parent, parent_key in relations:
        keys = parent.select(F.col(parent_key).alias(foreign))
        lost = child.filter(F.col(foreign).isNotNull()).join(keys, foreign, "left_anti").select(
            F.lit(name).alias("relation"), F.col(key).cast("string").alias("row_key"), F.col(foreign).cast("string").alias("missing_key")
        )
        out = lost if out is None else out.unionByName(lost)
    return out
