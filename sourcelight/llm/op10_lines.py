"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

State is three tables: ``postings`` (which rows hold a line), ``refs`` (per line: number of rows and the greatest row
id, by shard of the line's hash) and ``filters`` (per shard: one cuckoo filter over the lines that reached ``least``
rows). Inserting or deleting documents changes all three and returns a new state; a line that falls below ``least``
leaves its filter again. Applying the state reads each text line by line: the filters of a shard turn away lines
that repeat too rarely, what passes is looked up in the exact table, so filters never decide alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight.llm import common

LEAST_CHARS = 40
LEAST_DOCS = 5
SHARD_KEYS = 200_000
SALTS = 16
_BLANK = b" \t\n\x0b\x0c\r"


class Cuckoo:
    """A cuckoo filter of 64-bit keys: buckets of four 16-bit fingerprints, two places per fingerprint."""

    def __init__(self, table: np.ndarray):
        self.table = table  # [buckets, 4], a power of two buckets; 0 is free

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, math.ceil(math.log2(max(1, n) / 3.4))), 4), np.uint16))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = common.mixed(np.asarray(keys, np.int64).view(np.uint64))
        mask = np.uint64(len(self.table) - 1)
        print_ = np.maximum((keys >> np.uint64(48)), np.uint64(1))
        first = keys & mask
        return print_.astype(np.uint16), first.astype(np.int64), (first ^ (common.mixed(print_) & mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(keys)
        return ((self.table[first] == print_[:, None]) | (self.table[second] == print_[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Insert keys and return those that found no place (the filter is full)."""
        keys = np.asarray(keys, np.int64)
        prints, firsts, seconds = (a.tolist() for a in self._places(keys))
        mask = len(self.table) - 1
        jump = common.mixed(np.arange(1 << 16, dtype=np.uint64)).view(np.uint64)
        failed = []
        for i, (p, a, b) in enumerate(zip(prints, firsts, seconds, strict=True)):
            for place in (a, b):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = p
                    break
            else:
                place, path = b, []
                for turn in range(500):
                    slot = turn & 3
                    path.append((place, slot, int(self.table[place, slot])))
                    p, self.table[place, slot] = int(self.table[place, slot]), p
                    place ^= int(jump[p]) & mask
                    free = np.flatnonzero(self.table[place] == 0)
                    if len(free):
                        self.table[place, free[0]] = p
                        break
                else:  # put everything back as it was
                    for where, slot, old in reversed(path):
                        self.table[where, slot] = old
                    failed.append(i)
        return keys[failed]

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Delete keys that were inserted; returns for each key whether a fingerprint was there."""
        prints, firsts, seconds = (a.tolist() for a in self._places(keys))
        out = np.zeros(len(prints), bool)
        for i, (p, a, b) in enumerate(zip(prints, firsts, seconds, strict=True)):
            for place in (a, b):
                found = np.flatnonzero(self.table[place] == p)
                if len(found):
                    self.table[place, found[0]] = 0
                    out[i] = True
                    break
        return out


def probe(tables: list[bytes], keys: np.ndarray) -> np.ndarray:
    hit = np.zeros(len(keys), bool)
    for raw in tables:
        hit |= Cuckoo(np.frombuffer(raw, np.uint16).reshape(-1, 4)).contains(keys)
    return hit


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The folded line, or None where it is too short to count."""
    key = line.strip(_BLANK).lower()
    n = len(key)
    if n < least_chars or n < 4 * least_chars and len(key.decode("utf-8", "surrogatepass")) < least_chars:
        return None
    return key


def _digest(key: bytes) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(key)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _occurrences(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            lo, hi, rows = [], [], []
            for i, text in enumerate(common.texts(batch, "text")):
                keys = {k for k in (line_key(x, least_chars) for x in text.encode("utf-8", "surrogatepass").split(b"\n")) if k is not None}
                for key in sorted(keys):
                    a, b = _digest(key)
                    lo.append(a)
                    hi.append(b)
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64()))], ["lo", "hi", "id"])

    return run


def occurrences(df: DataFrame, id_col: str, text_col: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Distinct (``lo``, ``hi``, ``id``): which rows hold which lines. Rows without id are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    schema = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("id", df.schema[id_col].dataType)])
    return rows.mapInArrow(_occurrences(least_chars), schema)


@dataclass
class State:
    postings: DataFrame  # lo, hi, id
    refs: DataFrame  # lo, hi, n_docs, max_id
    filters: DataFrame  # shard, number, table
    shards: int
    least: int


def shard_of(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int")


def _update_filters(key: tuple, old: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
    """The filter of one shard, of whose lines all are given that reached ``least`` before (``was``) or do so now.

    A filter is one table, so what a line leaves behind in it is its own. One that overflows is built anew, larger,
    from the exact lines of the shard.
    """
    was, now = (np.unique(lines.loc[lines[c], "lo"].to_numpy(np.int64)) for c in ("was", "now"))
    tables = [Cuckoo(np.frombuffer(t, np.uint16).reshape(-1, 4).copy()) for t in old["table"]]
    rest = now
    if len(tables) == 1:
        tables[0].delete(np.setdiff1d(was, now, assume_unique=True))
        rest = tables[0].insert(np.setdiff1d(now, was, assume_unique=True))
    size = 2 * len(now)
    while len(rest):
        tables = [Cuckoo.sized(size)]
        rest, size = tables[0].insert(now), 2 * size
    return pd.DataFrame({"shard": [key[0]] * len(tables), "number": range(len(tables)), "table": [t.table.tobytes() for t in tables]}, columns=["shard", "number", "table"])


_FILTERS = "shard int, number int, table binary"


def _refreshed(state: State, before: DataFrame, after: DataFrame) -> DataFrame:
    """Filters after the counts of lines changed from ``before`` to ``after`` (lo, hi, n_docs of all lines)."""
    reached = lambda refs, name: refs.filter(F.col("n_docs") >= state.least).select("lo", "hi", F.lit(True).alias(name))
    both = reached(before, "was").join(reached(after, "now"), ["lo", "hi"], "full")
    lines = both.select(shard_of(state.shards).alias("shard"), "lo", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("was", "now")))
    return state.filters.groupBy("shard").cogroup(lines.groupBy("shard")).applyInPandas(_update_filters, _FILTERS)


def empty_state(spark: SparkSession, id_type: T.DataType, expected_lines: int, least: int = LEAST_DOCS) -> State:
    """A state without documents. ``expected_lines`` sets the number of shards, so that a shard holds a bounded part."""
    postings = spark.createDataFrame([], T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("id", id_type)]))
    refs = postings.select("lo", "hi", F.lit(0).cast("long").alias("n_docs"), F.col("id").alias("max_id"))
    return State(postings, refs, spark.createDataFrame([], _FILTERS), max(1, math.ceil(expected_lines / SHARD_KEYS)), least)


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("max_id"))


def build_state(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> State:
    """The state of a whole table: what inserting all its documents into an empty state gives, in one pass."""
    postings = common.stored(occurrences(df, id_col, text_col, least_chars).dropDuplicates(["lo", "hi", "id"]))
    refs = common.stored(_counted(postings))
    state = empty_state(df.sparkSession, postings.schema["id"].dataType, refs.filter(F.col("n_docs") >= least).count(), least)
    state.postings, state.refs = postings, refs
    state.filters = common.stored(_refreshed(state, refs.limit(0), refs))
    return state


def insert(state: State, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> State:
    """Add documents. A line that a row already holds is not counted twice, so inserting again changes nothing."""
    found = occurrences(df, id_col, text_col, least_chars).dropDuplicates(["lo", "hi", "id"])
    new = common.stored(found.join(state.postings, ["lo", "hi", "id"], "left_anti"))
    delta = _counted(new).select("lo", "hi", F.col("n_docs").alias("n"), F.col("max_id").alias("m"))
    joined = state.refs.join(delta, ["lo", "hi"], "full")
    refs = common.stored(joined.select("lo", "hi", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("max_id", "m").alias("max_id")))
    filters = _refreshed(state, state.refs, refs)
    return State(common.stored(state.postings.union(new)), refs, common.stored(filters), state.shards, state.least)


def delete(state: State, ids: DataFrame, id_col: str = "doc_id") -> State:
    """Take documents out again; ids that the state does not hold change nothing."""
    keys = ids.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    postings = common.stored(state.postings.join(keys, "id", "left_anti").select("lo", "hi", "id"))
    touched = common.stored(state.postings.join(keys, "id", "left_semi").select("lo", "hi").distinct())
    again = _counted(postings.join(touched, ["lo", "hi"], "left_semi"))
    refs = common.stored(state.refs.join(touched, ["lo", "hi"], "left_anti").select("lo", "hi", "n_docs", "max_id").union(again.select("lo", "hi", "n_docs", "max_id")))
    filters = _refreshed(state, state.refs, refs)
    return State(postings, refs, common.stored(filters), state.shards, state.least)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of shard and salt, each shard's filters before its lines: the lines that pass."""
    at: tuple[int, int] | None = None
    tables: list[bytes] = []
    for batch in batches:
        shard, salt = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("shard", "salt"))
        new = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if at != (shard[a], salt[a]):
                at, tables = (shard[a], salt[a]), []
            raw = part.column(part.schema.get_field_index("table"))
            tables += raw.drop_null().to_pylist()
            lines = part.filter(pc.is_null(raw))
            hit = probe(tables, lines.column(lines.schema.get_field_index("lo")).to_numpy()) if lines.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([lines.column(lines.schema.get_field_index(n)).filter(pa.array(hit)) for n in ("lo", "hi", "id")], ["lo", "hi", "id"])


def repeated(lines: DataFrame, state: State) -> DataFrame:
    """Of ``lines`` (lo, hi, id) those to drop: repeated at least ``least`` times and not held by the greatest id."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    filters = state.filters.select("shard", salts.alias("salt"), "number", "table", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast(lines.schema["id"].dataType).alias("id"))
    rows = lines.select(shard_of(state.shards).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("binary").alias("table"), "lo", "hi", "id")
    placed = filters.union(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("number").asc_nulls_last())
    schema = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), lines.schema["id"]])
    passed = placed.mapInArrow(_probe, schema)
    exact = state.refs.filter(F.col("n_docs") >= state.least).select("lo", "hi", "max_id")
    return passed.join(exact, ["lo", "hi"]).filter(F.col("id") != F.col("max_id")).select("lo", "hi", "id")


def _dropped(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            raw = batch.column(batch.schema.get_field_index("drop"))
            drops = raw.to_pylist()
            kept, n_lines, n_dropped, digests = [], [], [], []
            for text, drop in zip(common.texts(batch, "text"), drops, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                lines = data.split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    out = {(d["lo"], d["hi"]) for d in drop}
                    keys = (line_key(x, least_chars) for x in lines)
                    lines = [x for x, k in zip(lines, keys, strict=True) if k is None or _digest(k) not in out]
                    data = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(data.decode("utf-8", "surrogatepass"))
                digests.append(common.hex_sha256(data))
            arrays = [batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "kept_text", "n_lines", "n_dropped", "kept_sha256"])

    return run


def drop_lines(df: DataFrame, state: State, key: str = "doc_id", id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """Every row with its repeated lines taken out: ``key``, ``kept_text``, ``n_lines`` (before), ``n_dropped``, ``kept_sha256``.

    A null or empty text is one empty line. Rows that share an id share their fate line by line; rows without id
    count for nothing and keep all lines. A text of which nothing is left is empty. ``key`` may be a struct column
    that carries a row. The list of dropped lines of a row is never longer than the row.
    """
    drops = repeated(occurrences(df, id_col, text_col, least_chars), state).distinct()
    lists = drops.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("drop"))
    rows = df.select(F.col(key).alias("key"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    joined = rows.join(lists, "id", "left").select("key", "text", "drop")
    fields = [T.StructField("key", rows.schema["key"].dataType), T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return joined.mapInArrow(_dropped(least_chars), T.StructType(fields)).withColumnRenamed("key", key)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return drop_lines(docs, build_state(docs)).drop("kept_text")
