"""Time the headline queries on the given tables and print one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1). BENCH_CPUS: local cores (default 8). Every query is run
once on the smallest tables to warm the JVM and then timed once, written out in full to a null sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sourcelight.operators import lexical  # noqa: E402
from sourcelight.operators.segments import SearchIndex  # noqa: E402
from sourcelight.plans import registry  # noqa: E402
from sourcelight.plans.inputs import Inputs  # noqa: E402
from sourcelight.session import local_session, scratch_dir  # noqa: E402
from sourcelight.sources.files import read_index, read_lengths, write_index  # noqa: E402

HEADLINE = [
    "chunk_text", "content_objects", "version_chain", "lexical_search", "vector_topk", "rrf_fuse", "rerank", "hybrid_search",
    "select_evidence", "assess_claims", "direct_match", "score_dossier", "claim_reviews", "decode_answers", "validate_answers",
    "latest_event", "task_event_log", "sequence_violations", "stable_changes", "url_policy", "marker_scan",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def made_passages(spark, n: int):
    """Passages that all hold the same words, as a search gate."""
    i = F.col("id")
    return spark.range(0, n, 1, 32).select(
        i.alias("chunk_id"), F.lit(1).cast("bigint").alias("version_id"), F.format_string("source-%d.md", i).alias("display_name"),
        F.lit("search gate").alias("heading"), F.format_string("Passage number %d holds a stable searchable token.", i).alias("body"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    queries = registry.queries()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = small if os.path.isdir(small) else sf_dir

    times: dict[str, float] = {}
    for name in HEADLINE:
        drain(queries[name](spark, warm))
        times[name] = timed(lambda: drain(queries[name](spark, sf_dir)))

    # A stored index, searched by all queries in one job, and by single queries one after another.
    inputs = Inputs(spark, sf_dir)
    folder = scratch_dir(spark)
    chunks = inputs.current()
    times["index_build"] = timed(lambda: write_index(lexical.build_index(chunks), folder, files=int(cpus)))
    index, lengths = read_index(spark, folder), read_lengths(spark, folder)
    asked = inputs.queries()
    times["index_search_batch"] = timed(lambda: drain(lexical.lexical_scores(asked, index, 50, lengths=lengths)))
    singles = [timed(lambda q=q: drain(lexical.lexical_scores(asked.filter(F.col("query_id") == q), index, 50, lengths=lengths))) for q in range(10)]
    times["index_search_single_p50"] = round(statistics.median(singles), 3)

    # The same over a stored index of segments, and single searches of three words that every one of many passages holds.
    segments = None

    def build() -> None:
        nonlocal segments
        segments = SearchIndex.create(chunks, scratch_dir(spark))

    times["segments_build"] = timed(build)
    times["segments_search_batch"] = timed(lambda: drain(segments.search(asked, 50)))
    web = chunks.filter("version_id % 1000 = 8")
    times["segments_replace"] = timed(lambda: segments.replace_versions(web))
    many = int(os.environ.get("BENCH_GATE", "1000000"))
    gate = SearchIndex.create(made_passages(spark, many), scratch_dir(spark))
    query = spark.createDataFrame([(1, "stable searchable token")], "query_id bigint, query string")
    runs = sorted(timed(lambda: gate.search(query, 50).collect()) for _ in range(20))
    times["gate_single_p50"], times["gate_single_p95"] = runs[9], runs[18]

    n_chunks, n_queries = chunks.count(), asked.count()
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "gate_passages": many, "passages": n_chunks, "search_queries": n_queries,
        "passages_per_sec_chunk_text": round(n_chunks / times["chunk_text"], 1),
        "queries_per_sec_index_search": round(n_queries / times["index_search_batch"], 1),
        "queries_per_sec_hybrid_search": round(n_queries / times["hybrid_search"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
