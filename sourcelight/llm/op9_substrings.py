"""Removal of repeated byte strings by column-wise construction over many texts.

Every string of ``length`` bytes has one anchor, the least hashed short gram in it, at a place that its content alone
decides. Equal strings therefore lie around equal anchors at equal offsets, and only the surroundings of anchors
that occur more than once are looked at. In each group of equal anchors the surroundings are rows of one collection,
aligned at the anchor, and the collection's order is built column by column from the right: every round inserts one
symbol per row, sorts the rows stably by it (so they stay in the order of the suffixes that start in this column) and
updates the common prefixes of neighbours from the column before. Where a row shares ``length`` bytes or more with
a neighbour, the string that starts there occurs elsewhere.

The rounds are bounded by twice the string's length and not by the longest text; the sequential files of the method
are Spark's shuffle files sorted by anchor, which tasks read once from start to end. Groups of more than ``hot`` rows
are not gathered: their strings are hashed and counted one by one with partial sums instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.llm import common

LENGTH = 400
HOT = 50_000
SEGMENT = 1 << 20
BLOCK = 8 << 20
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse))


class Anchors:
    """Anchors of texts: the least hashed gram of every string of ``length`` bytes (the leftmost of equal ones)."""

    def __init__(self, length: int):
        self.length, self.gram = length, max(1, length // 8)
        self.span = length - self.gram + 1
        self.powers, self.inverse = _powers(4096)

    def _least(self, keys: np.ndarray) -> np.ndarray:
        """Least key of every run of ``span`` keys, from running minima of blocks in both directions."""
        w = self.span
        n = -(-len(keys) // w) * w
        padded = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        padded[:len(keys)] = keys
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(keys) - w + 1
        return np.minimum(behind[:count], ahead[w - 1:w - 1 + count])

    def segment(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(data)
        if n + 1 > len(self.powers):
            self.powers, self.inverse = _powers(2 * n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n])])
            grams = (sums[self.gram:] - sums[:-self.gram]) * self.inverse[:n - self.gram + 1]
        names = common.mixed(grams)
        low = np.uint64((1 << 22) - 1)
        place = (self._least((names & ~low) | np.arange(len(names), dtype=np.uint64)) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        at = place[first]
        return names[at].view(np.int64), at, first, last

    def of(self, text: bytes) -> tuple[np.ndarray, ...]:
        """Hash, place, and first and last start of the strings that have this anchor."""
        n = len(text) - self.length + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 4
        data = np.frombuffer(text, np.uint8)
        found = []
        for a in range(0, n, SEGMENT):
            names, *places = self.segment(data[a:min(n, a + SEGMENT) - 1 + self.length])
            found.append((names, *(p + a for p in places)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Once per task and text: its anchors' hashes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        seen: set[bytes] = set()
        for batch in common.chunks(batches, "text"):
            hashes, places = [], []
            for name, text in zip(batch.column(0).to_pylist(), common.texts(batch, "text"), strict=True):
                if name in seen:
                    hashes.append(None)
                    places.append(None)
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                h, at, _, _ = anchors.of(text.encode("utf-8", "surrogatepass"))
                hashes.append(h)
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], ["name", "hashes", "places"])

    return run


_SURROUNDINGS = "anchor long, hot boolean, name binary, place long, first long, last long, bytes binary"


def _cut(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (name, text, wanted: places of repeated anchors, hot ones): their surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in common.chunks(batches, "text", 1 << 20):
            rows: list[tuple] = []
            size = 0
            for name, text, wanted in zip(batch.column(0).to_pylist(), common.texts(batch, "text"), batch.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                hot = {w["place"]: w["hot"] for w in wanted}
                for h, at, first, last in zip(*(x.tolist() for x in anchors.of(data)), strict=True):
                    if at in hot:
                        rows.append((h, hot[at], name, at, first, last, data[first:last + length]))
                        size += last - first + length
                        if size > 4 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
            yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "hot", "name", "place", "first", "last", "bytes"])

    return run


def repeated_starts(group: np.ndarray, left: np.ndarray, rows: list[bytes], starts: np.ndarray, length: int) -> np.ndarray:
    """Which strings of which rows occur in another row of the same group at the same offset from the anchor.

    ``group`` numbers the rows' groups, equal ones together; ``left`` is the number of bytes before the anchor and
    ``starts`` the number of strings of each row, of which the first starts with the row. The result has a row for each
    row and a column for each offset, the last column being a start at the anchor itself.
    """
    n = len(rows)
    right = np.array([len(r) for r in rows], np.int64) - left
    before, after = int(left.max()), int(right.max())
    symbols = np.full((before + after, n), -1, np.int16)  # one sequential column per offset
    for i, row in enumerate(rows):
        symbols[before - left[i]:before + right[i], i] = np.frombuffer(row, np.uint8)
    found = np.zeros((n, before + 1), bool)
    order = np.arange(n)
    shared = np.zeros(n + 1, np.int32)  # common prefix of a row in the order and the one before it
    same_group = np.concatenate([[False], group[1:] == group[:-1]])
    number = np.cumsum(~same_group) - 1
    firsts = np.flatnonzero(~same_group)
    for column in range(before + after - 1, -1, -1):
        s = symbols[column][order]
        equal = same_group & (s >= 0)
        equal[1:] &= s[1:] == s[:-1]
        mixed = np.logical_or.reduceat(same_group & ~equal, firsts)
        plain = ~mixed[number]
        shared[:-1] = np.where(equal & plain, shared[:-1] + 1, np.where(plain, 0, shared[:-1]))
        if mixed.any():
            at = np.flatnonzero(~plain)
            key = number[at] * 512 + s[at] + 1
            moved = at[np.argsort(key, kind="stable")]
            p, q = moved[:-1], moved[1:]
            joined = (number[p] == number[q]) & (s[p] == s[q]) & (s[q] >= 0)
            least = np.zeros(len(moved), np.int32)
            a, b = p[joined] + 1, q[joined] + 1
            if len(a):
                bounds = np.stack([a, b], axis=1).ravel()
                least[1:][joined] = np.minimum.reduceat(shared, bounds)[::2] + 1
            order[at] = order[moved]
            shared[at] = least
        if column <= before:
            long = shared[:-1] >= length
            hit = long.copy()
            hit[:-1] |= long[1:]
            i = order[hit]
            offset = column - before + left[i]  # from the row's first byte
            ok = (offset >= 0) & (offset < starts[i])
            found[i[ok], column] = True
    return found


def _runs(name: bytes, first: int, left: int, before: int, flags: np.ndarray, length: int) -> list[tuple[bytes, int, int]]:
    columns = np.flatnonzero(flags)
    if not len(columns):
        return []
    cut = np.flatnonzero(np.diff(columns) > 1) + 1
    return [(name, first + int(part[0]) - before + left, first + int(part[-1]) - before + left + length) for part in np.split(columns, cut)]


def _spans(found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.int64(), pa.int64()], strict=True)], ["name", "start", "end"])


def _compare(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Surroundings in the order of their anchors: the spans of texts that occur elsewhere."""

    def solve(rows: list[tuple]) -> list[tuple[bytes, int, int]]:
        sizes: dict[int, int] = {}
        for r in rows:
            sizes[r[0]] = sizes.get(r[0], 0) + 1
        rows = [r for r in rows if sizes[r[0]] > 1]
        if not rows:
            return []
        group = np.array([r[0] for r in rows], np.int64)
        place, first, last = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
        found = repeated_starts(group, place - first, [r[5] for r in rows], last - first + 1, length)
        before = found.shape[1] - 1
        return [s for i in np.flatnonzero(found.any(axis=1)).tolist() for s in _runs(rows[i][1], rows[i][3], rows[i][2] - rows[i][3], before, found[i], length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            out: list[tuple[bytes, int, int]] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if size > BLOCK and row[0] != held[-1][0]:
                    out += solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) + 200
            yield _spans(out)
        yield _spans(solve(held))

    return run


def _windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every string of hot surroundings by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, last, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                hashes = [xxhash.xxh3_128_digest(data[i:i + length]) for i in range(last - first + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(hashes), pa.binary()), pa.array(range(first, last + 1), pa.int64()), pa.array(hashes, pa.binary())], ["name", "start", "window"])

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Spans (``name``, ``start``, ``end``) of bytes that belong to strings which start elsewhere too.

    ``texts`` has ``name`` (binary, one per distinct text) and ``text``; repeated rows of one name are one text here.
    """
    found = texts.mapInArrow(_anchors(length), "name binary, hashes array<long>, places array<int>").filter("hashes is not null")
    once = common.stored(found.groupBy("name").agg(F.min(F.struct("hashes", "places")).alias("a")).select("name", F.explode(F.arrays_zip("a.hashes", "a.places")).alias("a")).select("name", F.col("a.hashes").alias("anchor"), F.col("a.places").alias("place")))
    counts = once.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("anchor"), (F.col("n") > hot).alias("hot"))
    wanted = once.join(counts, "anchor").groupBy("name").agg(F.collect_list(F.struct("place", "hot")).alias("wanted"))  # no more than a text has anchors
    distinct = texts.groupBy("name").agg(F.first("text").alias("text"))
    around = distinct.join(wanted, "name").select("name", "text", "wanted").mapInArrow(_cut(length), _SURROUNDINGS)
    around = common.stored(around)
    near = around.filter("not hot").repartition("anchor").sortWithinPartitions("anchor", "name", "place")
    spans = near.select("anchor", "name", "place", "first", "last", "bytes").mapInArrow(_compare(length), "name binary, start long, end long")
    windows = around.filter("hot").select("name", "first", "last", "bytes").mapInArrow(_windows(length), "name binary, start long, window binary")
    common_ones = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    many = windows.join(common_ones, "window").select("name", "start", (F.col("start") + length).alias("end"))
    return spans.union(many)


def _removed(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, text, whole, spans) to what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            out = []
            for text, whole, spans in zip(common.texts(batch, "text"), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                if whole and len(data) >= length:
                    merged = [[0, len(data)]]
                at, parts = 0, []
                for a, b in merged:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                out.append((len(data), len(data) - len(kept), len(merged), kept, common.hex_sha256(kept)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def remove_repeated(df: DataFrame, key: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Every row without the bytes of strings of ``length`` bytes that also start anywhere else, in the same text too.

    Columns: ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (bytes; a cut may fall
    inside a character), ``kept_sha256``. All strings are judged on the input. Null texts are empty; texts shorter than
    ``length`` stay; rows that repeat a text of that length or more lose all of it. One row per input row; ``key``
    may be null, repeated, or a struct that carries a row.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = rows.withColumn("name", F.unhex(F.md5(F.col("text").cast("binary"))))
    long = named.filter(F.octet_length("text") >= length).select("name", "text")
    spans = repeated_spans(long, length, hot).groupBy("name").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # no more than a text has strings
    copies = long.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("whole")).filter("whole")
    facts = common.stored(spans.join(copies, "name", "full").select("name", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole").isNull(), F.col("spans")).alias("spans")))
    joined = named.join(facts, "name", "left").select("key", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    kind = rows.schema["key"].dataType.simpleString()
    out = joined.mapInArrow(_removed(length), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("key", key)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(common.table(spark, sf_dir, "documents")).drop("kept")
