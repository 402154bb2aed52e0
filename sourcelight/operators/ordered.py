"""Order-dependent columns over groups of any size.

A plain window puts a whole group into one task, so one hot key becomes one slow task. Here each group
is cut into slices at quantiles of the order column, windows run inside a slice, and a summary of one
row per (group, slice) carries counts and last values across slices. A slice holds about the same share
of the *table* however the rows are spread over keys, so no task grows with a hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_SLICE = "__os_slice"


def _position(df: DataFrame, name: str) -> Column:
    """The order column as a number that never decreases along the order."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):  # the leading six bytes, as strings are compared byte by byte
        lead = F.rpad(F.substring(F.hex(F.encode(name, "UTF-8")), 1, 12), 12, "0")
        return F.conv(lead, 16, 10).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.col(name).cast("timestamp").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    return F.col(name).cast("double")


def sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """Add the slices once for several scans in the same order; drop them with :func:`unsliced`."""
    return with_slice(df, order[0])


def unsliced(df: DataFrame) -> DataFrame:
    return df.drop(_SLICE)


def with_slice(df: DataFrame, order: str, fanout: int | None = None) -> DataFrame:
    """Add the slice number: two levels of ``fanout`` quantiles, read as a scalar subquery.

    Only ``fanout ** 2`` boundary values travel, and a row is compared with ``2 * fanout`` of them.
    """
    if fanout is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        fanout = max(4, min(64, math.ceil(math.sqrt(2 * partitions))))
    shares = [i / (fanout * fanout) for i in range(1, fanout * fanout)]
    value = _position(df, order)
    cuts = df.agg(F.percentile_approx(value, shares, 10_000).alias("c")).scalar()
    posts = F.array(*[F.lit(i * fanout - 1) for i in range(1, fanout)])
    cut_col = F.col("__os_cuts")
    coarse = fanout * F.size(F.filter(posts, lambda i: F.get(cut_col, i) < value))
    inner = F.slice(cut_col, F.col("__os_coarse") + 1, F.lit(fanout - 1))
    fine = F.col("__os_coarse") + F.size(F.filter(inner, lambda b: b < value))
    return (
        df.withColumn("__os_cuts", cuts)
        .withColumn("__os_coarse", coarse)
        .withColumn(_SLICE, F.coalesce(fine, F.lit(-1)))
        .drop("__os_cuts", "__os_coarse")
    )


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rank: str | None = None,
    lags: dict[str, str] | None = None,
    carried: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    fanout: int | None = None,
) -> DataFrame:
    """Add order-dependent columns within ``keys``, ordered by ``order`` (a total order).

    ``rank``: name of a 1-based row number. ``lags``: output name to column, the previous row's value.
    ``carried``: output name to column, the last non-null value strictly before the row.
    ``sums``: output name to column, the inclusive running sum.
    ``maxes``: output name to column, the largest value strictly before the row.
    """
    lags, carried, sums, maxes = lags or {}, carried or {}, sums or {}, maxes or {}
    base = df if _SLICE in df.columns else with_slice(df, order[0], fanout)
    within = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    position = F.struct(*[F.col(c) for c in order])

    parts = [F.count(F.lit(1)).alias("__os_n")]
    for name, c in lags.items():
        parts.append(F.max_by(F.struct(F.col(c).alias("v")), position).alias(f"__os_lag_{name}"))
    for name, c in carried.items():
        parts.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"__os_car_{name}"))
    for name, c in sums.items():
        parts.append(F.sum(c).alias(f"__os_sum_{name}"))
    for name, c in maxes.items():
        parts.append(F.max(c).alias(f"__os_max_{name}"))
    # One row per (group, slice): bounded by the number of slices for each group.
    summary = base.groupBy(*keys, _SLICE).agg(*parts)
    along = Window.partitionBy(*keys).orderBy(_SLICE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    heads = [F.coalesce(F.sum("__os_n").over(earlier), F.lit(0)).alias("__os_n0")]
    heads += [F.lag(f"__os_lag_{n}").over(along).alias(f"__os_lag_{n}") for n in lags]
    heads += [F.last(f"__os_car_{n}", ignorenulls=True).over(earlier).alias(f"__os_car_{n}") for n in carried]
    heads += [F.coalesce(F.sum(f"__os_sum_{n}").over(earlier), F.lit(0)).alias(f"__os_sum_{n}") for n in sums]
    heads += [F.max(f"__os_max_{n}").over(earlier).alias(f"__os_max_{n}") for n in maxes]
    k_alias = [F.col(k).alias(f"__os_k{i}") for i, k in enumerate(keys)]
    carry = summary.select(*k_alias, F.col(_SLICE).alias("__os_s"), *heads)

    local = [F.row_number().over(within).alias("__os_rn")]
    local += [F.lag(F.struct(F.col(c).alias("v"))).over(within).alias(f"__os_l_{n}") for n, c in lags.items()]
    local += [F.last(F.col(c), ignorenulls=True).over(before).alias(f"__os_c_{n}") for n, c in carried.items()]
    local += [F.sum(c).over(upto).alias(f"__os_s_{n}") for n, c in sums.items()]
    local += [F.max(c).over(before).alias(f"__os_m_{n}") for n, c in maxes.items()]
    rows = base.select("*", *local)
    same = F.col(_SLICE) == F.col("__os_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__os_k{i}"))
    joined = rows.join(carry, same)
    out = [F.col(c) for c in df.columns]
    if rank:
        out.append((F.col("__os_n0") + F.col("__os_rn")).cast("bigint").alias(rank))
    for n in lags:
        out.append(F.coalesce(F.col(f"__os_l_{n}"), F.col(f"__os_lag_{n}"))["v"].alias(n))
    for n in carried:
        out.append(F.coalesce(F.col(f"__os_c_{n}"), F.col(f"__os_car_{n}")).alias(n))
    for n in sums:
        out.append((F.col(f"__os_sum_{n}") + F.coalesce(F.col(f"__os_s_{n}"), F.lit(0))).alias(n))
    for n in maxes:
        out.append(F.greatest(F.col(f"__os_m_{n}"), F.col(f"__os_max_{n}")).alias(n))
    return joined.select(*out)
