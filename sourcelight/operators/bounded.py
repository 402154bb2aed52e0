"""Lists per key with a proven bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_list(df: DataFrame, key: str, index: str, item: list[str], limit: int, name: str) -> DataFrame:
    """Lists per key in ``index`` order (0-based): ``key``, ``name``, ``{name}_over``.

    A key with more than ``limit`` items, or an index beyond the limit, has no list (null) and ``{name}_over`` set, so
    that the caller can give a reason for it; other keys are not touched. Items beyond the limit are never gathered.
    """
    within = F.when(F.col(index) < limit, F.struct(index, *item))
    over = (F.count(F.lit(1)) > limit) | (F.max(index) >= limit)
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(within)).alias(name), over.alias(f"{name}_over"))
    return grouped.withColumn(name, F.when(~F.col(f"{name}_over"), F.col(name)))
