"""Helpers shared by the operators."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.session import scratch_dir

CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """Remainder of the CRC-32 of a key written as text; a null key belongs to no fold (null)."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later steps neither recompute it nor depend on
    executors that may be gone."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
        total, start = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def hex_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def fresh(name: str) -> str:
    """A column name that no caller uses."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"
