"""New files to versions and passages: one read of each file, one commit for each batch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourcelight import constants as K
from sourcelight.functions.text import file_uri, mime_type, normalize_text
from sourcelight.operators.catalog import current_versions, extraction_state
from sourcelight.operators.chunking import chunk_text
from sourcelight.sources.files import BINARY_FILE, local_path


LIST_IN_TASKS = "spark.sql.sources.parallelPartitionDiscovery.threshold"  # so many paths are listed by a job
OPEN_COST = "spark.sql.files.openCostInBytes"  # what opening a file counts as when files are dealt out to tasks
OPENED = 64 << 10


def file_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files below ``root`` as a listing: paths, times and lengths, no contents."""
    found = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger).load(root)
    )
    return found.select("path", "modificationTime", "length")


def open_files(spark: SparkSession, paths: list[str], most: int = K.MAX_TEXT_BYTES) -> DataFrame:
    """The listed files with their bytes; of a file longer than ``most`` only the listing, its bytes are never read.

    Paths are taken as they are written, whatever characters they hold.
    """
    if not paths:
        return spark.createDataFrame([], BINARY_FILE)
    plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]  # not as patterns
    files = spark.read.format("binaryFile").schema(BINARY_FILE).load(plain)  # listed once for both
    short = files.filter(F.col("length") <= most)  # pushed down to the reader
    long = files.filter(F.col("length") > most).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return short.select(*[f.name for f in BINARY_FILE]).unionByName(long)


def extracted(files: DataFrame) -> DataFrame:
    """A version with its text for each file (path, modificationTime, length, content).

    Ids follow from path and content, so a repeated batch gives the same rows. A file without readable text has a version
    with a reason and no text.
    """
    named = files.withColumn("path", local_path("path")).withColumn("sha256", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    typed = extraction_state(named.withColumn("mime_type", mime_type("path", "content")), size="length")
    known = F.when(F.col("content").isNotNull(), F.col("sha256"))
    return typed.select(
        F.sha2("path", 256).alias("source_id"),
        F.sha2(F.concat_ws(":", "path", F.coalesce(known, F.concat_ws("-", "length", F.col("modificationTime").cast("long")))), 256).alias("version_id"),
        F.substring_index("path", "/", -1).alias("display_name"),
        file_uri("path").alias("canonical_uri"),
        known.alias("original_sha256"), "mime_type", F.col("length").alias("byte_size"),
        "state", "processing_state", "reason", F.col("modificationTime").alias("retrieved_at"),
        F.when(F.col("state") == "active", normalize_text(F.col("content").cast("string"))).alias("text"),
    )


def passages(texts: DataFrame) -> DataFrame:
    """Passages of versions with their text."""
    chunks = chunk_text(texts.filter("text is not null").select("source_id", "version_id", "display_name", "text"), headings=True)
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws(":", "version_id", "ordinal"), 256))


def ingest_batch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions and passages of a batch of files, without writing anything."""
    versions = extracted(files)
    return versions.drop("text"), passages(versions)


def ingest_files(spark: SparkSession, paths: list[str], out: str, number: int) -> None:
    """Ingest the listed files as batch ``number``: texts are extracted and written once, passages are cut from what was
    written, and a manifest row that names both is written last.

    A batch that is tried again overwrites its own folders; until its manifest row is there, nothing of it is read.
    """
    texts = _counted(extracted(open_files(spark, paths)), f"{out}/versions/batch={number}")
    chunks = _counted(passages(texts[0]), f"{out}/chunks/batch={number}")
    counts = [(number, texts[1], chunks[1])]
    spark.createDataFrame(counts, "number bigint, versions bigint, chunks bigint").coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")


def _counted(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Write a table and read it back with the number of its rows, counted on the way."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), seen.get["n"]


def ingest_stream(spark: SparkSession, root: str, out: str, checkpoint: str, once: bool = True, files_per_trigger: int = 1000) -> StreamingQuery:
    """Follow ``root``: each batch of at most ``files_per_trigger`` new files is one :func:`ingest_files`."""
    def store(batch: DataFrame, number: int) -> None:
        # The stream has a session of its own. A few hundred paths are listed in less time than tasks for them start, and
        # counted as 4 MB each, as by default, they would be dealt out to far more tasks than there are cores.
        batch.sparkSession.conf.set(LIST_IN_TASKS, max(files_per_trigger, 32))
        batch.sparkSession.conf.set(OPEN_COST, OPENED)
        paths = [r["path"] for r in batch.select("path").collect()]  # bounded by the trigger
        ingest_files(batch.sparkSession, paths, out, number)

    writer = file_stream(spark, root, files_per_trigger).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def committed(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Versions (without their texts) and passages of the batches that the manifest names."""
    done = [r["number"] for r in spark.read.parquet(f"{out}/manifest").select("number").collect()]
    read = lambda kind: spark.read.option("basePath", f"{out}/{kind}").parquet(*[f"{out}/{kind}/batch={n}" for n in done]).drop("batch")
    return read("versions").drop("text"), read("chunks")


def current_library(versions: DataFrame) -> DataFrame:
    """Current version of each ingested source: the newest one that yielded text, else the first.

    A file that could not be read again keeps the version it had.
    """
    return current_versions(versions.select(
        "source_id", "version_id", F.struct("retrieved_at", "version_id").alias("seq"), (F.col("state") == "active").alias("extraction_ok")
    ))
