"""Vector column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcelight import constants as K
from sourcelight.functions.text import col, let


def squared_norm(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(v) -> Column:
    """Divide by the L2 norm; a zero vector is returned as it is."""
    v = col(v)
    norm = F.sqrt(squared_norm(v))
    return let(norm, lambda n: F.when(n == 0.0, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / n)
    ))


def vector_reason(v) -> Column:
    """Why one vector is unusable, or NULL."""
    v = col(v)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return (
        F.when(v.isNull() | (F.size(v) == 0), "empty")
        .when(bad, "not_finite")
        .when(squared_norm(v) <= K.F32_EPSILON, "zero_norm")
    )


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
