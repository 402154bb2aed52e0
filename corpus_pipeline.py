"""A corpus pipeline over ``documents``: stages that are written and read again one after another.

Every stage works on all rows that its predecessor kept. The first four return the columns of ``documents``, the last
one adds ``copy``. A table without rows passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.llm import common, op2_ngram_join, op4_mix, op5_decontaminate, op6_language, op10_lines

LEAST_SCORE = 0.3


def _packed(docs: DataFrame, *more: str) -> tuple[DataFrame, str, list[str]]:
    """Rows as one struct column beside the columns that an operator reads."""
    row, names = common.fresh("row"), docs.columns
    return docs.select(F.struct(*[F.col(c) for c in names]).alias(row), *more), row, names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language is known and covers at least ``LEAST_SCORE`` of their letters.

    The model is learned from the rows' own ``lang``; texts without letters go.
    """
    model = op6_language.fit(docs)
    rows, row, names = _packed(docs, "text")
    found = op6_language.identify(rows, model, key=row, spans=False)
    kept = found.filter((F.col("lang_pred") != op6_language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(row)[c].alias(c) for c in names])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that repeat in five or more documents, but for the greatest ``doc_id`` that holds them.

    ``n_chars`` follows the new text where a line went; documents stay even if nothing is left of them.
    """
    rows, row, names = _packed(docs, "doc_id", "text")
    found = op10_lines.drop_lines(rows, op10_lines.build_state(docs), key=row)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col(row)["text"]),
           "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col(row)["n_chars"])}
    return found.select(*[new.get(c, F.col(row)[c]).alias(c) for c in names])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by 0.8 or more of their five-word shingles, keep the least ``doc_id``."""
    return op2_ngram_join.keep_first(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents that hold ten consecutive words of a benchmark item."""
    return op5_decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the target weights of their sources and shuffle."""
    return op4_mix.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", language),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mixture),
]

# The first stage is a learned model, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
