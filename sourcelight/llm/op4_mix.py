"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: what its target weight asks for over what it holds. A row's number of copies
is the inverse of the Poisson distribution of that mean at a uniform number drawn from a hash of seed and key, so the
same row gets the same number on every run and every machine. Rows are exploded into their copies and shuffled by a
hash of key and copy number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.llm import common

SEED = "mix-1"
POWER = 0.5


def _hashed(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary"))


def uniform(seed: str, key: Column) -> Column:
    """A number inside (0, 1) with 52 bits from the hash of seed and key."""
    return (F.conv(F.substring(_hashed(seed, key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... up to twelve deviations and forty beyond the mean."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    step = lambda acc, k: F.struct(
        (acc["logp"] + F.log(rate / k)).alias("logp"), (acc["sum"] + F.exp(acc["logp"] + F.log(rate / k))).alias("sum"),
        F.concat(acc["cdf"], F.array(acc["sum"] + F.exp(acc["logp"] + F.log(rate / k)))).alias("cdf"),
    )
    first = F.struct((-rate).alias("logp"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), top), first, step)["cdf"]


def rates(df: DataFrame, source_col: str, text_col: str, weights: DataFrame | None = None, power: float = POWER, total: Column | None = None) -> DataFrame:
    """Mean repetition rate of each source: ``source``, ``mass`` (bytes of text), ``rate``.

    ``weights`` (columns ``source`` and ``weight``) are the target shares; without it a source's share goes with its
    mass to the ``power``. The mixture has as many bytes in the mean as the table, or ``total``. A source without
    bytes keeps rate 1, one without a weight gets rate 0. Null is a source of its own.
    """
    mass = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        mass = mass.withColumn("weight", F.pow("mass", F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("__s")).agg(F.sum("weight").cast("double").alias("weight"))
        mass = mass.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    mass = common.stored(mass)
    sums = mass.agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mass"), F.coalesce(F.sum(F.when(F.col("mass") > 0, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
    wanted = F.lit(sums["mass"]) if total is None else total
    rate = F.when(F.col("mass") == 0, 1.0).when(F.col("weight") <= 0, 0.0).otherwise(wanted * F.col("weight") / F.lit(sums["weight"]) / F.col("mass"))
    return mass.select("source", "mass", rate.alias("rate"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: DataFrame | None = None,
        power: float = POWER, seed: str = SEED) -> DataFrame:
    """All columns of ``df`` and ``copy`` (1, 2, ...), in shuffled order.

    A row with a Poisson number of 0 is left out. Rows that share a key get the same number of copies; a null key is
    a key of its own, null and empty texts are rows like others. An empty table gives an empty mixture.
    """
    names = df.columns
    source, cdf, key = common.fresh("source"), common.fresh("cdf"), common.fresh("order")
    found = common.stored(rates(df, source_col, text_col, weights, power))
    tables = found.select(F.col("source").alias(source), F.when(F.col("rate") > 0, poisson_cdf(F.when(F.col("rate") > 0, F.col("rate")).otherwise(1.0))).alias(cdf))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = uniform(seed, name)
    count = F.coalesce(F.size(F.filter(F.col(cdf), lambda c: c < u)), F.lit(0))
    joined = df.join(tables, F.col(source_col).eqNullSafe(F.col(source)), "left")
    counted = joined.withColumn(key, count).filter(F.col(key) > 0)
    copies = counted.select(*names, F.explode(F.sequence(F.lit(1), F.col(key))).alias("copy"))
    placed = copies.withColumn(key, _hashed(seed, name, F.col("copy").cast("string")))
    return placed.repartition(key).sortWithinPartitions(key).drop(key)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents", columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """SQL twin of :func:`mix` with default settings over a table or common table expression."""
    return f"""
mix_mass AS (SELECT source, CAST(sum(coalesce(octet_length(encode(text)), 0)) AS DOUBLE) AS mass FROM {documents} GROUP BY source),
mix_rate AS (SELECT source, CASE WHEN mass = 0 THEN 1.0 ELSE sum(mass) OVER () * pow(mass, {POWER}) / sum(CASE WHEN mass > 0 THEN pow(mass, {POWER}) END) OVER () / mass END AS rate FROM mix_mass),
mix_cdf AS (
  SELECT source, rate, 0 AS k, -rate AS logp, exp(-rate) AS c FROM mix_rate WHERE rate > 0
  UNION ALL
  SELECT source, rate, k + 1, logp + ln(rate / (k + 1)), c + exp(logp + ln(rate / (k + 1))) FROM mix_cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
),
mix_u AS (SELECT *, (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)!r} AS u FROM {documents}),
mix_n AS (
  SELECT d.*, coalesce((SELECT count(*) FROM mix_cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c < d.u), 0) AS n FROM mix_u d
)
SELECT {columns}, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM mix_n WHERE n > 0
"""
