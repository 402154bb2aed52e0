"""File listings and table sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight.functions.text import col, file_path

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def spread(df: DataFrame) -> DataFrame:
    """Shuffle a table that has fewer input splits than there are cores; leave any other as it is.

    A large table has many splits and is read in place. A small one in a single file would keep all work on
    its texts in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file below ``root`` with its bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.withColumn("path", local_path("path"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and modification time below ``root``. File contents are pruned from the read."""
    return read_files(spark, root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def local_path(uri) -> Column:
    """``file:/a%20b`` and ``file:///a%20b`` as ``/a b``; other schemes stay as they are."""
    uri = col(uri)
    full = F.regexp_replace(uri, r"\Afile:/+", "file:///")
    return F.coalesce(file_path(full), uri)


def path_in_root(df: DataFrame, root, path: str = "path") -> DataFrame:
    """Mark files outside the approved root, compared by whole path components.

    Paths are compared as they are written, so one with a ``.`` or ``..`` component counts as outside.
    """
    base = F.regexp_replace(F.lit(root) if isinstance(root, str) else root, r"(?<=.)/+\z", "")
    prefix = F.when(base == "/", base).otherwise(F.concat(base, F.lit("/")))
    dotted = F.col(path).rlike(r"(?:\A|/)\.\.?(?:/|\z)")
    inside = ~dotted & ((F.col(path) == base) | F.col(path).startswith(prefix))
    return df.withColumn("reason", F.when(~inside, "outside_root"))


def write_text_files(df: DataFrame, root: str) -> None:
    """A file with a text and a line feed for each row: ``path`` (below ``root``, not repeated), ``text``.

    Where ``root`` is on a file system that tasks can open, they write the files themselves: Hadoop's local file system
    would start a process for the rights of each folder, file and checksum. A file gets its name when it is whole, so a
    task that is tried again leaves the same files. Any other store is written by Spark, in a folder for each file.
    """
    place = urlsplit(root)
    if place.scheme not in ("", "file"):
        df.select("path", F.col("text").alias("value")).write.partitionBy("path").text(root)
        return
    base = place.path if place.scheme else root

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                folder, name = os.path.split(f"{base}/{path}")
                os.makedirs(folder, exist_ok=True)
                hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with open(hidden, "wb") as file:
                    file.write(content)
                os.replace(hidden, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    os.makedirs(base, exist_ok=True)
    rows = df.select("path", F.concat(F.col("text"), F.lit("\n")).cast("binary").alias("content"))
    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write Parquet. With ``partition`` only the partitions present in ``df`` are replaced."""
    writer = df.write.mode("overwrite")
    if partition is not None:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


INDEX_SCHEMA = "term string, field string, chunk_id {0}, version_id {1}, tf bigint, len bigint"


def write_index(index: DataFrame, path: str, files: int | None = None) -> None:
    """Store a search index for repeated use.

    Rows are placed by passage, so a frequent word fills no file of its own, and sorted by word inside each
    file, so a search for a few words skips most row groups by their minimum and maximum.
    """
    from sourcelight.operators.lexical import field_lengths

    placed = index.repartition("chunk_id") if files is None else index.repartition(files, "chunk_id")
    ordered = placed.sortWithinPartitions("term", "field")
    ordered.write.mode("overwrite").option("parquet.block.size", 16 * 1024 * 1024).parquet(f"{path}/rows")
    stored = index.sparkSession.read.schema(index.schema).parquet(f"{path}/rows")
    field_lengths(stored).coalesce(1).write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str, key: str = "bigint", version: str = "bigint") -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA.format(key, version)).parquet(f"{path}/rows")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Field lengths of a stored index: three rows."""
    return spark.read.schema("field string, chunks bigint, avg_len double").parquet(f"{path}/lengths")
