"""Lexical retrieval: postings, corpus statistics and BM25 ranking for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcelight import constants as K
from sourcelight.functions.text import index_tokens, is_blank, token_list
from sourcelight.session import scratch_dir, stored

FIELDS = ["display_name", "heading", "body"]
SCORE_DIGITS = 4
LENGTH_TERM = ""  # the row that carries a field's length; no word is empty
BROADCAST_TERMS = 500_000  # query words handed to every task: some 30 MB
PUSHED_TERMS = 200  # so few distinct words are pushed down to the scan of a stored index
TASK_PAIRS = 2_000_000  # pairs of query word and posting scored by one task
COLUMNS = ["term", "field", "chunk_id", "version_id", "tf", "len"]


def _runs(tokens: Column) -> Column:
    """Equal words of a sorted list as runs: ``"a a b "`` gives ``["a a ", "b "]``.

    Counting words this way needs neither a shuffle nor a nested loop over the words of a passage.
    """
    joined = F.concat(F.array_join(F.sort_array(tokens), " "), F.lit(" "))
    found = F.regexp_extract_all(joined, F.lit(r"([^ ]++ )\1*+"), F.lit(0))
    return F.when(F.size(tokens) > 0, found).otherwise(F.array().cast("array<string>"))


def build_index(chunks: DataFrame) -> DataFrame:
    """The index: one row per (passage, field, word), and one per (passage, field) for the field's length.

    A map over passages: nothing is shuffled, and one pass yields postings and corpus statistics. Runs are rows before words
    and counts are taken from them, as a function over the runs of a passage would not be compiled.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), index_tokens(f).alias("tokens")) for f in FIELDS])
    by_field = chunks.select("chunk_id", "version_id", F.explode(fields).alias("f"))
    size = F.size("f.tokens").cast("bigint")
    found = by_field.select(
        "chunk_id", "version_id", F.col("f.field").alias("field"), size.alias("len"),
        F.explode(F.concat(F.array(F.lit(LENGTH_TERM)), _runs(F.col("f.tokens")))).alias("run"),
    )
    word = F.substring_index("run", " ", 1)
    tf = F.when(F.col("run") == LENGTH_TERM, F.col("len")).otherwise(F.floor(F.char_length("run") / (F.char_length(word) + 1)))
    return found.select(word.alias("term"), "field", "chunk_id", "version_id", tf.alias("tf"), "len")


def postings(index: DataFrame) -> DataFrame:
    return index.filter(F.col("term") != LENGTH_TERM)


def field_lengths(index: DataFrame) -> DataFrame:
    """Number of passages and mean length of each field: a three-row table."""
    return index.filter(F.col("term") == LENGTH_TERM).groupBy("field").agg(
        F.count(F.lit(1)).alias("chunks"), F.avg("len").alias("avg_len")
    )


def replace_versions(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Drop the entries of every version in ``chunks`` and add its new ones."""
    kept = index.join(chunks.select("version_id").distinct(), "version_id", "left_anti")
    return kept.select(*COLUMNS).unionByName(build_index(chunks))


def index_freshness(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Indexed against expected passages; they differ when the index needs a rebuild."""
    held = (F.col("term") == LENGTH_TERM) & (F.col("field") == FIELDS[-1])
    indexed = index.filter(held).agg(F.count(F.lit(1)).alias("indexed"))
    expected = chunks.agg(F.count(F.lit(1)).alias("expected"))
    both = indexed.select("indexed", expected.scalar().alias("expected"))
    return both.withColumn("stale", F.col("indexed") != F.col("expected"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Words of each query with how often they occur."""
    tokens = index_tokens("query")
    return (
        queries.filter(~is_blank("query"))
        .select("query_id", F.explode(tokens).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


@dataclass(frozen=True)
class _Matched:
    rows: DataFrame  # postings of the query words
    small: bool  # the query words fit every task
    apart: bool  # hardly any word is shared by several queries


def _matched(index: DataFrame, terms: DataFrame) -> _Matched:
    """Postings of the query words. A short list of words is pushed down to the scan of a stored index."""
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(PUSHED_TERMS + 1).collect()
    if len(few) <= PUSHED_TERMS:
        total, most = sum(r["n"] for r in few), max((r["n"] for r in few), default=0)
        return _Matched(index.filter(F.col("term").isin([r["term"] for r in few])), total <= BROADCAST_TERMS, most <= 2)
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    wanted = counts.select("term")
    return _Matched(postings(index).join(F.broadcast(wanted) if small else wanted, "term", "left_semi"), small, False)


def _weights(terms: DataFrame, matched: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per (query, word, field): document frequency, mean field length and the factor in front of BM25's
    term-frequency part. As many rows as the queries have words, times three."""
    df = matched.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    n, d = F.col("chunks"), F.col("df")
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
    stats = df.join(F.broadcast(lengths), "field").select(  # one row per field
        "term", "field", "df", "avg_len", (idf * (1 + K.BM25_K1)).alias("idf_weight")
    )
    return terms.join(stats, "term").withColumn("weight", F.col("qtf") * F.col("idf_weight"))


def _impact() -> Column:
    norm = K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("len") / F.col("avg_len"))
    return F.col("weight") * F.col("tf") / (F.col("tf") + norm)


def _score(weights: DataFrame, matched: DataFrame) -> DataFrame:
    joined = matched.join(weights, ["term", "field"])
    return joined.groupBy("query_id", "chunk_id").agg(
        F.first("version_id").alias("version_id"), F.sum(_impact()).alias("score")
    )


def top_per_query(scored: DataFrame, k: int, score: str = "score", id_col: str = "chunk_id") -> DataFrame:
    """Best ``k`` rows per query by rounded score, ties by id.

    The rank filter is applied before the shuffle too (window group limit), so a query with any number of
    candidates sends at most ``k`` rows per task.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.col(id_col))
    return (
        scored.withColumn(score, F.round(score, SCORE_DIGITS))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def _scoring_tasks(weights: DataFrame) -> int:
    """So many tasks that none scores more than about ``TASK_PAIRS`` pairs.

    Postings are small where they are sent and become a row for each query that asks for their word, so tasks of equal
    bytes, as adaptive execution would make them, can hold any number of pairs. The number is known before: a word adds its
    document frequency for each query that has it.
    """
    pairs = weights.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return max(int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))


def lexical_scores(
    queries: DataFrame, index: DataFrame, k: int, hot_postings: int | None = None, lengths: DataFrame | None = None
) -> DataFrame:
    """Top ``k`` passages per query: query_id, chunk_id, version_id, score, rank.

    ``lengths`` are the stored field lengths of the index; without them they are summed from it.

    With ``hot_postings`` set, words with more postings than that do not open candidates by themselves:

    1. score with the remaining (rare) words and take each query's k-th best score as a floor;
    2. where all hot words together cannot lift an unseen passage to the floor, add their share only to
       the candidates that can still reach it (an equi-join on word and passage, even for a hot word);
    3. all other queries are scored in full.

    The answer is the same, because a hot word adds at least 0 and less than its weight.
    """
    terms = query_terms(queries)
    found = _matched(index, terms)
    weights = _weights(terms, found.rows, field_lengths(index) if lengths is None else lengths)
    # With all words of a passage in one partition, scoring needs no further shuffle: a word that occurs in a
    # third of all passages is spread over all tasks, and (query, passage) pairs are never sent. Where queries
    # share no words there are no more pairs than postings, and partial sums are smaller than both.
    weights = weights if found.apart and hot_postings is None else stored(weights)  # read again by every step below
    if hot_postings is None:
        return top_per_query(_scored_by_passage(found, weights), k)

    hot = F.col("df") > hot_postings
    held = lambda w: F.broadcast(w) if found.small else w
    # Rare words have few postings however large the corpus is, so only those are sent, and what they score is written.
    rare = stored(_score(held(weights.filter(~hot)), found.rows))
    bound = weights.groupBy("query_id").agg(F.sum(F.when(hot, F.col("weight")).otherwise(0.0)).alias("hot_bound"))
    floor = (
        top_per_query(rare.select("query_id", "chunk_id", "score"), k)
        .filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    )
    slack = 10.0 ** (1 - SCORE_DIGITS)
    safe = stored(bound.join(floor, "query_id").filter(F.col("hot_bound") + slack < F.col("floor")))  # at most a row per query
    full = lambda w: _scored_by_passage(found, w)
    if safe.isEmpty():
        return top_per_query(full(weights), k)
    survivors = rare.join(safe, "query_id").filter(F.col("score") + F.col("hot_bound") + slack >= F.col("floor"))
    survivors = survivors.select("query_id", "chunk_id", "version_id", "score")
    wanted = stored(survivors.select("query_id", "chunk_id").join(weights.filter(hot), "query_id"))
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    extra = (
        found.rows.drop("version_id").join(F.broadcast(wanted) if few else wanted, ["term", "field", "chunk_id"])
        .groupBy("query_id", "chunk_id").agg(F.sum(_impact()).alias("extra"))
    )
    pruned = survivors.join(extra, ["query_id", "chunk_id"], "left").select(
        "query_id", "chunk_id", "version_id", (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score")
    )
    others = stored(weights.join(safe, "query_id", "left_anti"))
    return top_per_query(pruned if others.isEmpty() else pruned.unionByName(full(others)), k)


def _scored_by_passage(found: _Matched, weights: DataFrame) -> DataFrame:
    rows = found.rows if found.apart else found.rows.repartition(_scoring_tasks(weights), "chunk_id")
    return _score(F.broadcast(weights) if found.small else weights, rows)


def lexical_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = K.RERANK_OUTPUT,
    index: DataFrame | None = None,
    hot_postings: int | None = None,
) -> DataFrame:
    """Top ``k`` current passages per query with their text.

    ``chunks`` are the searchable passages (see ``current_chunks``); statistics are taken over them. Without
    a stored ``index`` the words that the queries use are indexed on the way, in one durable pass.
    """
    if index is None:
        index = index_for(queries, chunks)
    hits = lexical_scores(queries, index, k, hot_postings)
    return hits.join(chunks.drop("version_id"), "chunk_id")


def index_for(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Index of the words in ``queries`` only, written once, as a search reads it more than once."""
    terms = query_terms(queries)
    marker = terms.limit(1).select(F.lit(LENGTH_TERM).alias("term"))
    words = terms.select("term").distinct().unionByName(marker)
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return stored(build_index(chunks).join(F.broadcast(words) if small else words, "term", "left_semi").select(*COLUMNS))


def phrase_search(phrases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages whose name, heading or body holds the words of ``phrase`` one after another: phrase_id, chunk_id, field.

    The passages are indexed for the words of the phrases, with positions; see :meth:`SearchIndex.phrases`, which a stored
    index answers without this step.
    """
    from sourcelight.operators.segments import SearchIndex

    words = phrases.select(F.explode(token_list("phrase")).alias("term"))
    return SearchIndex.create(chunks, scratch_dir(chunks.sparkSession), words).phrases(phrases)
