"""All registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sourcelight.plans.inputs import Inputs, sql


@dataclass(frozen=True)
class Query:
    run: Callable[[Inputs], DataFrame]
    oracle: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, body: str | None = None, *needs: str, recursive: bool = False):
    """Register a function over :class:`Inputs` with the SQL that must give the same rows."""
    def add(run: Callable[[Inputs], DataFrame]):
        REGISTRY[name] = Query(run, sql(body, *needs, recursive=recursive) if body else None)
        return run

    return add


def load() -> dict[str, Query]:
    from sourcelight.plans import answers, claims, events, ingest, library, retrieval, streams, web  # noqa: F401

    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, q=q: q.run(Inputs(spark, sf_dir))) for name, q in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle for name, q in load().items() if q.oracle is not None}
