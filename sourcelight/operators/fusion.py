"""Fusing, reranking and choosing evidence for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcelight import constants as K
from sourcelight.functions.text import citation_uri, meaningful_terms, normalized_tokens, token_set

DIGITS = 6


def rrf_fuse(lexical: DataFrame, vector: DataFrame, limit: int = K.RERANK_INPUT) -> DataFrame:
    """Sum of 1 / (60 + rank) over both lists, at most three passages per version, then ``limit``.

    Inputs: query_id, chunk_id, version_id, score, rank (at most 50 rows per query each). One shuffle by
    query serves the merge and both rank windows.
    """
    cols = ["query_id", "chunk_id", "version_id"]
    lex = lexical.select(*cols, "rank", F.col("score").alias("lexical_score"), F.lit(None).cast("double").alias("vector_score"))
    vec = vector.select(*cols, "rank", F.lit(None).cast("double").alias("lexical_score"), F.col("score").alias("vector_score"))
    both = lex.unionByName(vec).repartition("query_id")
    fused = both.groupBy("query_id", "chunk_id").agg(
        F.first("version_id").alias("version_id"),
        F.max("lexical_score").alias("lexical_score"),
        F.max("vector_score").alias("vector_score"),
        F.round(F.sum(1.0 / (K.RRF_K + F.col("rank"))), DIGITS).alias("fused_score"),
    )
    order = [F.desc("fused_score"), F.col("chunk_id")]
    in_version = Window.partitionBy("query_id", "version_id").orderBy(*order)
    in_query = Window.partitionBy("query_id").orderBy(*order)
    return (
        fused.withColumn("__v", F.row_number().over(in_version))
        .filter(F.col("__v") <= K.FUSION_CHUNKS_PER_VERSION)
        .withColumn("rank", F.row_number().over(in_query).cast("bigint"))
        .filter(F.col("rank") <= limit)
        .drop("__v")
    )


def searchable_text() -> Column:
    return F.concat_ws(" ", "display_name", "heading", "passage")


def rerank(hits: DataFrame, limit: int = K.RERANK_OUTPUT, scheme: str = "evidence") -> DataFrame:
    """Rerank hits (query_id, query, score, rank, and the passage columns); at most 30 in and 12 out.

    The output ``score`` is 0.55 fused + 0.35 coverage + 0.10 phrase, each within 0..1.
    """
    if limit > K.RERANK_OUTPUT:
        raise ValueError(f"limit is over {K.RERANK_OUTPUT}")
    per_query = Window.partitionBy("query_id")
    text_tokens, query_tokens = token_set("__text"), token_set("query")
    coverage = F.when(
        F.size(query_tokens) > 0,
        F.size(F.array_intersect(query_tokens, text_tokens)) / F.size(query_tokens),
    ).otherwise(0.0)
    wanted = normalized_tokens("query")
    phrase = F.when((wanted != "") & F.contains(normalized_tokens("__text"), wanted), 1.0).otherwise(0.0)
    fused = F.when(
        F.col("__max") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / F.col("__max")))
    ).otherwise(0.0)
    score = K.WEIGHT_FUSED * fused + K.WEIGHT_COVERAGE * coverage + K.WEIGHT_PHRASE * phrase
    bounded = (
        hits.filter(F.col("rank") <= K.RERANK_INPUT)
        .withColumn("__text", searchable_text())
        .withColumn("__max", F.greatest(F.max("score").over(per_query), F.lit(0.0)))
        .withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), DIGITS))
        .withColumn("citation_uri", citation_uri("source_id", "version_id", "ordinal", scheme))
    )
    order = per_query.orderBy(F.desc("score"), F.col("citation_uri"))
    return (
        bounded.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("rank") <= limit)
        .drop("__text", "__max")
    )


def merge_hybrid(
    queries: DataFrame, lexical: DataFrame, vector: DataFrame, chunks: DataFrame, limit: int = K.RERANK_OUTPUT
) -> DataFrame:
    """Fuse both lists, drop passages that are no longer current, rerank.

    Passages that are not current still use up fusion places, as they are dropped afterwards.
    """
    fused = rrf_fuse(lexical, vector).withColumnRenamed("fused_score", "score")
    hits = fused.drop("version_id").join(chunks, "chunk_id").join(queries.select("query_id", "query"), "query_id")
    return rerank(hits.withColumnRenamed("body", "passage"), limit)


def relevance_gate(hits: DataFrame) -> DataFrame:
    """Keep hits that share a meaningful word with the question.

    A question without any such word keeps hits scored above the confidence floor.
    """
    terms = meaningful_terms("query")
    return hits.filter(
        F.when(F.size(terms) > 0, F.arrays_overlap(terms, token_set("passage")))
        .otherwise(F.col("score") > K.RERANK_CONFIDENCE_FLOOR)
    )


EVIDENCE_FIELDS = [
    "citation_uri", "source_id", "version_id", "chunk_id", "ordinal", "display_name", "heading",
    "coordinates", "retrieved_at", "passage",
]


def evidence_json() -> Column:
    """The evidence record as JSON, nulls written out; its byte length is what counts as its size."""
    return F.to_json(F.struct(*EVIDENCE_FIELDS), {"ignoreNullFields": "false"})


def evidence_tokens() -> Column:
    return F.ceil(F.octet_length(evidence_json()) / 4).cast("bigint")


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, rank, chunk, version, tokens) in the order of query and rank: the ranks that are chosen."""
    query, seen, versions, taken, tokens = None, set(), {}, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for q, rank, chunk, version, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if q != query:
                query, seen, versions, taken, tokens = q, set(), {}, 0, 0
            if taken >= K.EVIDENCE_CHUNKS or chunk in seen:
                continue
            seen.add(chunk)
            if versions.get(version, 0) < K.EVIDENCE_CHUNKS_PER_VERSION and tokens + size <= K.EVIDENCE_TOKENS:
                out.append((q, rank, taken))
                versions[version] = versions.get(version, 0) + 1
                taken, tokens = taken + 1, tokens + size
        columns = list(zip(*out, strict=True)) or [()] * 3
        kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "rank", "idx"])


def select_evidence(hits: DataFrame) -> DataFrame:
    """Choose evidence per query in rank order: at most 12, three per version, 1500 approximate tokens.

    A hit that does not fit is skipped and later, smaller ones may still enter. Any number of hits may come: light
    (rank, chunk, version, tokens) rows stream through in rank order, and passages are joined back.
    """
    light = hits.filter("query_id is not null").select("query_id", "rank", "chunk_id", "version_id", evidence_tokens().alias("tokens"))
    placed = light.repartition("query_id").sortWithinPartitions("query_id", "rank")
    kind = hits.schema["query_id"].dataType.simpleString()
    chosen = placed.mapInArrow(_chosen, f"query_id {kind}, rank {hits.schema['rank'].dataType.simpleString()}, idx bigint")
    return hits.withColumn("tokens", evidence_tokens()).join(chosen, ["query_id", "rank"])
