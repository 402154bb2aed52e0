"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words, weighted by how often they occur. For each term and each of ``samples`` draws, a hash
of term and draw gives r and c from Gamma(2, 1) and b from (0, 1); with t = floor(ln w / r + b) the draw keeps the
term and level t with the least ln c - r (t - b + 1). Two texts keep the same (term, t) with a chance equal to the
generalised Jaccard similarity of their weights. The gamma numbers are read from tables of quantiles that are
computed from the distribution, so that a draw costs a hash, two look-ups and a few sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcelight.llm import common

SAMPLES = 32
NO_ID = -(1 << 63)
_BLANKS = r"[\x20\x09-\x0D]+"


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """A number inside (0, 1) from some bits of a hash."""
    part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return (part + 0.5) / float(1 << bits)


def _draw(term: Column, log_weight: Column, number: int) -> Column:
    """One draw for one weighted term: order in the upper bits, 32 bits that name (term, t) in the lower ones.

    A Gamma(2, 1) number is the sum of two exponential ones. A term that occurs once has t = 0, without a division.
    """
    h, g = F.xxhash64(term, F.lit(2 * number)), F.xxhash64(term, F.lit(2 * number + 1))
    r = -F.log(_uniform(h, 0, 20) * _uniform(h, 20, 20))
    c = -F.log(_uniform(g, 0, 31) * _uniform(g, 31, 31))
    b = _uniform(h, 40, 24)
    t = F.when(log_weight > 0, F.floor(log_weight / r + b)).otherwise(F.lit(0).cast("long"))
    order = ((F.log(c) - r * (t - b + 1) + 100) * float(1 << 24)).cast("long")
    name = term.bitwiseXOR(t * F.lit(0x9E3779B1).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.shiftleft(order, 32) + name


def signatures(df: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``signature`` (array of ``samples`` numbers) of every key's words; keys without words are left out.

    If the rows are already placed by some of the keys, nothing is shuffled.
    """
    words = df.select(*keys, F.explode(F.split(text_col, _BLANKS)).alias("word")).filter("word <> ''")
    counts = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).alias("w"))
    weighted = counts.select(*keys, "term", F.log(F.col("w").cast("double")).alias("lw"))
    draws = [F.min(_draw(F.col("term"), F.col("lw"), j)).alias(f"d{j}") for j in range(samples)]
    least = weighted.groupBy(*keys).agg(*draws)
    return least.select(*keys, F.array(*[F.col(f"d{j}").bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int") for j in range(samples)]).alias("signature"))


def written(signature: Column) -> Column:
    """A signature as text, four hexadecimal digits per draw; "" for none."""
    return F.coalesce(F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 4, "0")), "")), F.lit(""))


def likeness(left: Column, right: Column, samples: int = SAMPLES) -> Column:
    """Share of equal draws. Two texts without words are alike (1), one without and one with words are not (0)."""
    equal = F.aggregate(F.zip_with(left, right, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    both = left.isNotNull() & right.isNotNull()
    return F.when(both, equal / F.lit(float(samples))).otherwise((left.isNull() & right.isNull()).cast("double"))


def successors(ids: DataFrame, id_col: str) -> DataFrame:
    """``id`` and ``next`` for each distinct id: the next greater one, after the greatest the least.

    Ids are ranged over the cluster; only each range's ends meet in one place, one row per range.
    """
    ranged = ids.select(F.col(id_col).alias("id")).distinct()
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = common.stored(ranged.repartitionByRange(n, "id").withColumn("range", F.spark_partition_id()))
    inside = placed.withColumn("next", F.lead("id").over(Window.partitionBy("range").orderBy("id")))
    ends = placed.groupBy("range").agg(F.min("id").alias("first"))
    order = Window.orderBy("range")  # one row per range
    starts = ends.select("range", F.lead("first").over(order).alias("following"), F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("least"))
    joined = inside.join(F.broadcast(starts), "range")
    return joined.select("id", F.coalesce("next", "following", "least").alias("next"))


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id``, ``hash``, ``copies``, ``text``, ``edited``) placed by id: each distinct text of an id with its edited text.

    The edited text has its last floor(n / 2) characters replaced by the first as many of the next id's text. Rows
    that repeat both id and text are one row with their number in ``copies``; of several texts of the next id the
    least is taken. Ids are whole numbers, and null is ``NO_ID`` here: a column that is never null lets both uses of
    the texts share one shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    sizes = common.stored(rows.groupBy("id").agg(F.max(F.length("text")).alias("n")))
    after = common.stored(successors(sizes.filter(F.col("id") != NO_ID), "id").join(sizes, "id").select(F.col("next"), F.col("id").alias("of"), F.floor(F.col("n") / 2).cast("int").alias("half")))
    placed = rows.repartition("id")
    texts = placed.withColumn("hash", F.xxhash64("text")).groupBy("id", "hash").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    heads = placed.join(after, placed["id"] == after["next"]).select("of", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"))
    heads = heads.groupBy("of").agg(F.min("head").alias("head"))
    joined = texts.join(heads, texts["id"] == heads["of"], "left").drop("of")
    length = F.length("text")
    half = F.floor(length / 2).cast("int")
    change = F.concat(F.substring(F.col("text"), F.lit(1), length - half), F.substring(F.coalesce("head", F.lit("")), F.lit(1), half))
    return joined.select("id", "hash", "copies", "text", change.alias("edited"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (see :func:`edited`).

    Columns: ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``. One row per input row. Null texts are empty; texts without words have the fingerprint "" and are
    alike with each other only. A null id has no next document: its edited text is its first half, ``near_next`` 0
    unless it has no words. The next of the only id is itself.
    """
    rows = edited(df, id_col, text_col)
    facts = rows.select("id", "hash", "copies", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = rows.select("id", "hash", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v"))
    signed = signatures(both.select("id", "hash", "v.which", "v.t"), ["id", "hash", "which"], "t", samples)
    pivoted = signed.groupBy("id", "hash").agg(F.first(F.when(F.col("which") == 0, F.col("signature")), True).alias("own"), F.first(F.when(F.col("which") == 1, F.col("signature")), True).alias("changed"))
    facts = facts.withColumnRenamed("id", "fid").withColumnRenamed("hash", "fhash")
    joined = facts.join(pivoted, (F.col("fid") == F.col("id")) & (F.col("fhash") == F.col("hash")), "left").select(F.col("fid").alias("id"), F.col("fhash").alias("hash"), "copies", "n_chars", "edited_sha256", "own", "changed")
    signed = common.stored(joined)
    links = successors(signed.select("id").filter(F.col("id") != NO_ID), "id")
    least = signed.groupBy("id").agg(F.min("hash").alias("h"))
    following = signed.select(F.col("id").alias("nid"), F.col("hash").alias("nhash"), F.col("own").alias("next_own")).join(least.select(F.col("id").alias("nid"), F.col("h").alias("nhash")), ["nid", "nhash"])
    found = signed.join(links, "id", "left").join(following.drop("nhash"), F.col("next") == F.col("nid"), "left")
    out = found.select(
        F.when(F.col("id") != NO_ID, F.col("id")).cast(df.schema[id_col].dataType).alias(id_col), "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), samples).alias("near_edited"), likeness(F.col("own"), F.col("next_own"), samples).alias("near_next"), "copies",
    )
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
