"""A stored search index of segments: blocks of postings with positions and bounds, replaced by delta, merged on read.

Passages are numbered in the order of their ids and cut into blocks. A row of a segment is one (word, field, block) with its
postings (passage, version, count, field length, word positions) and, beside them, what bounds their scores: the greatest
count, the least length and the smallest id. Replacing or removing versions writes a new segment with their passages and
the short list of passages that are dead in older ones; nothing older is rewritten until :meth:`SearchIndex.compact`.

Everything is committed by one manifest row, which is written last. A manifest has a row per segment and a row per
segment that lost passages, so it is short; statistics are sums over it.

A search works on blocks before postings: each block's bound is the sum of what its words can add, the blocks with the
highest bounds give a k-th score, and only blocks that can still beat it (or tie with a smaller id) are opened.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcelight import constants as K
from sourcelight.functions.text import WORD, normalized_tokens
from sourcelight.operators.lexical import FIELDS, PUSHED_TERMS, SCORE_DIGITS, query_terms, top_per_query
from sourcelight.session import stored

BLOCK_BITS = 7  # 128 passages to a block
TASK_BLOCKS = 8  # blocks whose words are gathered at once when a segment is written
SEEDS = 8  # blocks per query that are scored first
PUSHED_BLOCKS = 2000  # so few blocks are pushed down to the scan
DEAD_SENT = 1_000_000  # so many ids of dead passages are sent to all tasks
SENT_WORDS = 100_000  # so many words of queries are sent to all tasks
OPEN_QUERIES = 256  # queries of a block that are looked at at once
_TINY = 1e-9


_MARK = "\x01"
_ROW = "block bigint, term string, field string, n int, max_tf int, min_len int, first_id bigint, entries array<struct<chunk_id:bigint,version_id:bigint,tf:int,len:int,positions:array<int>>>"
_ENTRY = pa.struct([("chunk_id", pa.int64()), ("version_id", pa.int64()), ("tf", pa.int32()), ("len", pa.int32()), ("positions", pa.list_(pa.int32()))])


def _field_words(field: str) -> Column:
    """The words of a field in order, lower-cased. Words of one character carry a mark, as they have no position."""
    found = F.regexp_extract_all(F.coalesce(F.col(field), F.lit("")), F.lit(WORD + "++"), F.lit(0))
    return F.transform(found, lambda t: F.when(F.char_length(t) > 1, F.lower(t)).otherwise(F.concat(F.lit(_MARK), F.lower(t))))


def _entries(batch: pa.RecordBatch, field: str) -> pa.RecordBatch | None:
    """Rows of a segment for one field of whole blocks of passages, which come in the order of their ids.

    Positions count words of two characters or more, which are the words of a phrase; shorter words have none.
    """
    lists = batch.column(field)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = lists.flatten().dictionary_encode()
    if len(tokens) == 0:
        return None
    raw = tokens.dictionary
    short = pc.starts_with(raw, _MARK).to_numpy(zero_copy_only=False)
    words = pc.replace_substring(raw, _MARK, "").dictionary_encode()
    code = words.indices.to_numpy()[tokens.indices.to_numpy()]
    row = np.repeat(np.arange(len(size)), size)
    counted = ~short[tokens.indices.to_numpy()]
    upto = np.concatenate([[0], np.cumsum(counted)])
    starts = np.cumsum(size) - size
    position = upto[:-1] - np.repeat(upto[starts], size)
    order = np.lexsort((row, code))  # stable, so positions stay in order; rows are ordered by block, then id
    code, row, counted, position = code[order], row[order], counted[order], position[order]
    entry = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
    at = row[entry]
    tf = np.diff(np.append(entry, len(code))).astype(np.int32)
    placed = np.concatenate([[0], np.cumsum(counted)])[np.append(entry, len(code))].astype(np.int32)
    block, ids = batch.column("block").to_numpy(), batch.column("chunk_id").to_numpy()
    length, first = size[at].astype(np.int32), code[entry]
    group = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (block[at][1:] != block[at][:-1])]))
    positions = pa.ListArray.from_arrays(pa.array(placed), pa.array(position[counted].astype(np.int32)))
    taken = pa.array(at)
    held = pa.StructArray.from_arrays([batch.column("chunk_id").take(taken), batch.column("version_id").take(taken), pa.array(tf), pa.array(length), positions], fields=list(_ENTRY))
    ends = np.append(group, len(entry)).astype(np.int32)
    columns = [
        pa.array(block[at][group]), words.dictionary.take(pa.array(first[group])), pa.array([field] * len(group)), pa.array(np.diff(ends)),
        pa.array(np.maximum.reduceat(tf, group)), pa.array(np.minimum.reduceat(length, group)), pa.array(np.minimum.reduceat(ids[at], group)),
        pa.ListArray.from_arrays(pa.array(ends), held)]
    return pa.RecordBatch.from_arrays(columns, ["block", "term", "field", "n", "max_tf", "min_len", "first_id", "entries"])


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages in the order of their blocks to the rows of those blocks; a block that is not whole waits for the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest, batch]).combine_chunks()
        if table.num_rows == 0:
            continue
        block = table.column("block").to_numpy()
        whole = int(np.searchsorted(block, block[-1]))
        rest = table.slice(whole).to_batches()
        yield from _rows_of(table.slice(0, whole))
    if rest is not None:
        yield from _rows_of(pa.Table.from_batches(rest))


def _rows_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Some blocks at a time, so that what is held does not go with the size of a batch."""
    block = table.column("block").to_numpy()
    cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))[::TASK_BLOCKS].tolist() if len(block) else []
    for start, end in zip(cuts, [*cuts[1:], len(block)]):
        for batch in table.slice(start, end - start).combine_chunks().to_batches():
            for field in FIELDS:
                if (made := _entries(batch, field)) is not None:
                    yield made


def _length(field: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(field), F.lit("")), F.lit(WORD + "++"), F.lit(0))).cast("bigint")


def _range_starts(chunks: DataFrame, parts: int) -> list:
    """First passage of each of at most ``parts`` ranges of about the same size."""
    ranged = chunks.select("chunk_id").repartitionByRange(parts, "chunk_id").groupBy(F.spark_partition_id()).agg(F.min("chunk_id").alias("first"))
    return sorted(r["first"] for r in ranged.collect())


def _blocked(rows: DataFrame, cuts: list, parts: int) -> DataFrame:
    """Rows with their range (``part``) and block, numbered within the range: the same for the same passages in any job."""
    step = max(1, math.isqrt(len(cuts)))
    starts = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array(F.lit(None))
    coarse = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[::step]]) if cuts else starts, lambda c: c <= F.col("chunk_id")))
    first = F.greatest((coarse - 1) * step, F.lit(0))
    part = first + F.size(F.filter(F.slice(starts, first + 1, F.lit(step)), lambda c: c <= F.col("chunk_id")))
    placed = rows.withColumn("part", part.cast("bigint")).repartition(parts, "part")
    at = F.row_number().over(Window.partitionBy("part").orderBy("chunk_id", "version_id")) - 1
    return placed.withColumn("block", F.shiftleft("part", 33 - BLOCK_BITS) + F.shiftright(at, BLOCK_BITS))


def _gone(dead: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The ids of dead passages of each block, which has a bounded number; few of them go to every task."""
    gone = dead.groupBy(*keys).agg(F.collect_set("chunk_id").alias("gone"))
    return F.broadcast(gone) if count <= DEAD_SENT else gone


@dataclass
class SearchIndex:
    """A stored index below ``folder``, which every executor can reach."""

    spark: SparkSession
    folder: str

    # --- storage ----------------------------------------------------------------

    @classmethod
    def create(cls, chunks: DataFrame, folder: str, only: DataFrame | None = None) -> SearchIndex:
        """A new index of ``chunks`` (chunk_id, version_id, display_name, heading, body).

        ``only`` (term): the words that will ever be asked for; an index for one table of queries holds no others.
        """
        index = cls(chunks.sparkSession, folder)
        index._commit([("add", *index._segment(chunks, only))])
        return index

    def _path(self, kind: str, segment: str) -> str:
        return f"{self.folder}/{kind}/segment={segment}"

    def _segment(self, chunks: DataFrame, only: DataFrame | None = None) -> tuple:
        """Write one segment; its manifest figures."""
        name = f"s{uuid.uuid4().hex}"
        parts = 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Both tables of a segment number the same passages in separate jobs, so the ranges are cut once: what each job would
        # cut for itself rests on a sample of its own, and the two tables would not mean the same blocks.
        # Passages are made once and written for the three jobs that read them.
        chunks = stored(chunks.select("chunk_id", "version_id", *FIELDS))
        cuts = _range_starts(chunks, parts)
        lengths = chunks.select("chunk_id", "version_id", *[_length(f).alias(f"len_{f}") for f in FIELDS])
        _blocked(lengths, cuts, parts).drop("part").write.parquet(self._path("passages", name))
        blocked = _blocked(chunks, cuts, parts)
        # A part is a run of neighbouring blocks; its passages are in one task since they were numbered, in the order of their
        # ids, so postings are gathered block by block without a shuffle or a sort of all words, and lie in one file.
        grouped = blocked.select("block", "chunk_id", "version_id", *[_field_words(f).alias(f) for f in FIELDS]).mapInArrow(_segment_rows, _ROW)
        grouped = grouped if only is None else grouped.join(only.select("term").distinct(), "term", "left_semi")
        grouped.sortWithinPartitions("term", "field", "block").write.option("parquet.block.size", 16 << 20).parquet(self._path("rows", name))
        rows = self.spark.read.parquet(self._path("rows", name))
        rows.groupBy("term", "field").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(self._path("terms", name))
        held = self.spark.read.parquet(self._path("passages", name))
        return name, *self._figures(held)

    def _figures(self, passages: DataFrame) -> tuple[int, ...]:
        sums = passages.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f"len_{f}"), F.lit(0)) for f in FIELDS]).first()
        return tuple(sums)

    def _commit(self, rows: list[tuple], number: int | None = None) -> None:
        number = self._last() + 1 if number is None else number
        schema = f"number bigint, kind string, segment string, passages bigint, {', '.join(f'len_{f} bigint' for f in FIELDS)}"
        self.spark.createDataFrame([(number, *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self._read = None

    def manifest(self) -> list:
        """Rows since the last compaction: ``add`` for a segment, ``dead`` for what a later change took from one.

        ``number`` orders the changes; a ``dead`` row's own list is named by number and segment.
        """
        if getattr(self, "_read", None) is None:
            rows = sorted(self.spark.read.parquet(f"{self.folder}/manifest").collect(), key=lambda r: r.number)
            start = max((r.number for r in rows if r.kind == "compacted"), default=0)
            self._read = [r for r in rows if r.number >= start]
        return self._read

    def _last(self) -> int:
        try:
            return max(r.number for r in self.manifest())
        except Exception as error:  # a new index has no manifest yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return 0

    def _live(self) -> list[str]:
        return [r.segment for r in self.manifest() if r.kind in ("add", "compacted")]

    def _dead(self) -> list[str]:
        return [f"{r.number}-{r.segment}" for r in self.manifest() if r.kind == "dead"]

    def _table(self, kind: str, segments: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(*[self._path(kind, s) for s in segments])

    # --- changes ----------------------------------------------------------------

    def replace_versions(self, chunks: DataFrame, removed: DataFrame | None = None) -> None:
        """Add ``chunks``; their versions, and those in ``removed`` (version_id), lose all earlier passages.

        Reads the short passage lists of the older segments and the files of those that hold such versions, writes the
        new passages and the lists of dead ones. A failed change leaves no manifest row and so no trace in searches.
        """
        gone = chunks.select("version_id") if removed is None else chunks.select("version_id").unionByName(removed.select("version_id"))
        gone = gone.distinct()
        number, rows = self._last() + 1, []
        before = self._dead_passages()
        for segment in self._live():
            passages = self.spark.read.parquet(self._path("passages", segment)).join(gone, "version_id", "left_semi")
            if before is not None:
                passages = passages.join(before.filter(F.col("in_segment") == segment).select("chunk_id"), "chunk_id", "left_anti")
            name = f"{number}-{segment}"
            passages.withColumn("in_segment", F.lit(segment)).write.parquet(self._path("dead", name))
            lost = self.spark.read.parquet(self._path("dead", name))
            figures = self._figures(lost)
            if figures[0] == 0:
                continue
            blocks = lost.agg(F.min("block"), F.max("block")).first()
            held = self.spark.read.parquet(self._path("rows", segment)).filter(F.col("block").between(*blocks))
            met = held.select("block", "term", "field", F.col("entries.chunk_id").alias("ids")).join(_gone(lost, ["block"], figures[0]), "block")
            met = met.select("term", "field", F.size(F.array_intersect("ids", "gone")).alias("n")).filter("n > 0")
            met.groupBy("term", "field").agg(F.sum("n").alias("df")).write.parquet(self._path("lost", name))
            rows.append(("dead", segment, *figures))
        rows.append(("add", *self._segment(chunks)))
        self._commit(rows, number)

    def compact(self) -> None:
        """Merge all segments into one without dead passages. Readers of the old ones are not disturbed; nothing is deleted.

        Blocks keep their postings, less those of dead passages, and are written by the tasks that read them: nothing is sent
        but the ids of dead passages.
        """
        number, name = self._last() + 1, f"s{uuid.uuid4().hex}"
        rows = self._table("rows", self._live())
        numbers = self._block_numbers()
        gone = self._gone_of_blocks()
        if gone is None:
            kept = rows
        else:
            left = F.when(F.col("gone").isNull(), F.col("entries")).otherwise(F.filter("entries", lambda e: ~F.array_contains("gone", e["chunk_id"])))
            alive = rows.join(gone, ["segment", "block"], "left").withColumn("entries", left).filter(F.size("entries") > 0)
            kept = alive.select("segment", "block", "term", "field", F.size("entries").alias("n"), F.array_max("entries.tf").alias("max_tf"),
                                F.array_min("entries.len").alias("min_len"), F.array_min("entries.chunk_id").alias("first_id"), "entries")
        renamed = kept.withColumn("block", numbers).drop("segment")
        renamed.sortWithinPartitions("term", "field", "block").write.option("parquet.block.size", 16 << 20).parquet(self._path("rows", name))
        stored = self.spark.read.parquet(self._path("rows", name))
        stored.groupBy("term", "field").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(self._path("terms", name))
        self._passages().withColumn("block", numbers).drop("segment").write.parquet(self._path("passages", name))
        self._commit([("compacted", name, *self._figures(self.spark.read.parquet(self._path("passages", name))))], number)

    def _block_numbers(self) -> Column:
        """Block numbers of all segments side by side: the segment's place in the high bits."""
        place = F.lit(None).cast("bigint")
        for i, segment in enumerate(self._live()):
            place = F.when(F.col("segment") == segment, F.lit(i)).otherwise(place)
        return F.shiftleft(place, 56) + F.col("block")

    # --- what it holds ------------------------------------------------------------

    def _dead_passages(self) -> DataFrame | None:
        names = self._dead()
        return self._table("dead", names).drop("segment") if names else None

    def _gone_of_blocks(self) -> DataFrame | None:
        """segment, block and the ids of the block's dead passages (``gone``)."""
        dead = self._dead_passages()
        count = sum(r.passages for r in self.manifest() if r.kind == "dead")
        return None if dead is None else _gone(dead.withColumnRenamed("in_segment", "segment"), ["segment", "block"], count)

    def _passages(self) -> DataFrame:
        held, dead = self._table("passages", self._live()), self._dead_passages()
        return held if dead is None else held.join(dead.select(F.col("in_segment").alias("segment"), "chunk_id"), ["segment", "chunk_id"], "left_anti")

    def figures(self) -> dict[str, int]:
        """Live passages and the sum of each field's lengths, from the manifest alone."""
        names = ["passages", *(f"len_{f}" for f in FIELDS)]
        return {n: sum(r[n] * (-1 if r.kind == "dead" else 1) for r in self.manifest()) for n in names}

    def freshness(self, chunks: DataFrame) -> DataFrame:
        """Indexed against expected passages; they differ when the index needs a rebuild. Only ``chunks`` are counted."""
        held = self.figures()["passages"]
        return chunks.agg(F.count(F.lit(1)).alias("expected")).select(F.lit(held).cast("bigint").alias("indexed"), "expected", (F.col("expected") != held).alias("stale"))

    def postings(self) -> DataFrame:
        """Live postings: term, field, chunk_id, version_id, tf, len."""
        rows = self._table("rows", self._live()).select("segment", "term", "field", F.explode("entries").alias("e"))
        flat = self._without_dead(rows.select("segment", "term", "field", "e.chunk_id", "e.version_id", F.col("e.tf").cast("bigint").alias("tf"), F.col("e.len").cast("bigint").alias("len")))
        return flat.drop("segment")

    def _without_dead(self, rows: DataFrame) -> DataFrame:
        dead = self._dead_passages()
        return rows if dead is None else rows.join(dead.select(F.col("in_segment").alias("segment"), "chunk_id"), ["segment", "chunk_id"], "left_anti")

    # --- search -------------------------------------------------------------------

    def _words(self, terms: DataFrame, few: list[str] | None = None) -> tuple[DataFrame, list[str] | None]:
        """(term, field, df) of the words of ``terms``, and the words themselves where they are few enough for a scan filter."""
        if few is None:
            few = [r["term"] for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        few = few if len(few) <= PUSHED_TERMS else None
        counts = self._table("terms", self._live()).select("term", "field", "df")
        if (dead := self._dead()):
            counts = counts.unionByName(self._table("lost", dead).select("term", "field", (-F.col("df")).alias("df")))
        counts = counts.filter(F.col("term").isin(few)) if few is not None else counts.join(terms.select("term").distinct(), "term", "left_semi")
        return counts.groupBy("term", "field").agg(F.sum("df").alias("df")).filter("df > 0"), few

    def _rows(self, few: list[str] | None) -> DataFrame:
        rows = self._table("rows", self._live())
        return rows if few is None else rows.filter(F.col("term").isin(few))

    def _impact(self, tf: Column, length: Column) -> Column:
        held = self.figures()
        mean = F.lit(1.0)
        for f in FIELDS:
            mean = F.when(F.col("field") == f, held[f"len_{f}"] / max(1, held["passages"])).otherwise(mean)
        return F.col("weight") * tf / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * length / mean))

    def search(self, queries: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
        """Top ``k`` passages per query: query_id, chunk_id, version_id, score, rank.

        The same rows as scoring every posting: a block stays closed only where the sum of its words' bounds, rounded
        like a score, is below the k-th score of the blocks opened first, or equal to it with no smaller id.
        """
        terms, short = self._held(query_terms(queries))
        few = sorted(set(short.column("term").to_pylist())) if short is not None else None
        counts, few = self._words(terms, few)
        if few is not None:
            counts = self._held(counts)[0]
        n, d = F.lit(self.figures()["passages"]), F.col("df")
        weight = F.col("qtf") * F.log(1 + (n - d + 0.5) / (d + 0.5)) * (1 + K.BM25_K1)
        weights = terms.join(counts, "term").select("query_id", "term", "field", weight.alias("weight"))
        rows = self._rows(few)
        if few is None:  # rows of words that nobody asks for are left where they are
            words = terms.select("term").distinct()
            if words.count() <= SENT_WORDS:
                rows = rows.join(F.broadcast(words), "term", "left_semi")
        heads = rows.select("segment", "block", "term", "field", "max_tf", "min_len", "first_id").join(weights, ["term", "field"])
        bounds = heads.groupBy("query_id", "segment", "block").agg(F.sum(self._impact(F.col("max_tf"), F.col("min_len"))).alias("bound"), F.min("first_id").alias("first_id"))
        bounds = bounds.withColumn("bound", F.round(F.col("bound") + _TINY, SCORE_DIGITS))
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "first_id", "segment", "block")
        first = bounds.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= seeds).select("query_id", "segment", "block")
        floor = top_per_query(self._scored(first, weights, rows, few is not None), k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"), F.col("chunk_id").alias("floor_id"))
        if few is not None:
            floor = self._held(floor)[0]
        open_ = bounds.join(floor, "query_id", "left").filter(
            F.col("floor").isNull() | (F.col("bound") > F.col("floor")) | (F.col("bound") == F.col("floor")) & (F.col("first_id") <= F.col("floor_id")))
        return top_per_query(self._scored(open_.select("query_id", "segment", "block"), weights, rows, few is not None), k)

    def _held(self, df: DataFrame, most: int = PUSHED_BLOCKS) -> tuple[DataFrame, pa.Table | None]:
        """A table of at most ``most`` rows as a constant of the plan, so that it is not computed again; a longer one as it is."""
        found = df.limit(most + 1).toArrow()
        return (self.spark.createDataFrame(found, df.schema), found) if found.num_rows <= most else (df, None)

    def _scored(self, blocks: DataFrame, weights: DataFrame, rows: DataFrame, few: bool) -> DataFrame:
        """Scores of all passages in the given blocks of each query. For few words, few blocks are a filter of the scan."""
        if few:
            blocks, short = self._held(blocks)
            if short is not None:
                rows = rows.filter(F.col("block").isin(sorted(set(short.column("block").to_pylist()))))
        # Queries are dealt into slices of bounded size: a word's row is sent once for each slice that asks for it, to the task of
        # its block, and a passage's score is summed there. Neither pairs of query and block nor postings are sent for each word.
        slices = max(1, -(-weights.select("query_id").distinct().count() // OPEN_QUERIES))
        part = F.pmod(F.xxhash64("query_id"), F.lit(slices)).alias("part")
        opened = blocks.select("segment", "block", part, "query_id").groupBy("segment", "block", "part").agg(F.collect_set("query_id").alias("open"))
        if (gone := self._gone_of_blocks()) is not None:
            opened = opened.join(gone, ["segment", "block"], "left")
        else:
            opened = opened.withColumn("gone", F.lit(None).cast("array<bigint>"))
        asking = weights.select("term", "field", part, F.struct("query_id", "weight").alias("q")).groupBy("term", "field", "part").agg(F.collect_list("q").alias("asking"))
        # Positions are not read; postings of other words are left behind before anything is sent.
        scored = F.arrays_zip(*[F.col(f"entries.{c}").alias(c) for c in ("chunk_id", "version_id", "tf", "len")]).alias("entries")
        asked = rows.select("segment", "block", "term", "field", scored).join(weights.select("term").distinct(), "term", "left_semi")
        met = asked.join(asking, ["term", "field"]).join(opened, ["segment", "block", "part"])
        met = met.withColumn("asking", F.filter("asking", lambda q: F.array_contains("open", q["query_id"]))).filter(F.size("asking") > 0)
        alive = F.when(F.col("gone").isNull(), F.col("entries")).otherwise(F.filter("entries", lambda e: ~F.array_contains("gone", e["chunk_id"])))
        flat = met.select("segment", "block", "part", "field", "asking", F.explode(alive).alias("e"))
        flat = flat.select("segment", "block", "part", "field", "e", F.explode("asking").alias("q"))
        flat = flat.select("segment", "block", "part", "q.query_id", "q.weight", "field", "e.chunk_id", "e.version_id", "e.tf", "e.len")
        sums = flat.groupBy("segment", "block", "part", "query_id", "chunk_id").agg(F.first("version_id").alias("version_id"), F.sum(self._impact(F.col("tf"), F.col("len"))).alias("score"))
        return sums.select("query_id", "chunk_id", "version_id", "score")

    def phrases(self, phrases: DataFrame) -> DataFrame:
        """Passages whose name, heading or body holds the words of ``phrase`` one after another: phrase_id, chunk_id, field.

        The phrase's rarest word opens the candidates: its positions give the places where the phrase would start. The
        other words are looked up in the candidates' blocks only, and a place stays if every word stands where it has to.
        A phrase without words of two characters matches nothing; phrases without id are left out.
        """
        listed = phrases.filter("phrase_id is not null").select("phrase_id", normalized_tokens("phrase").alias("words")).filter("words <> ''")
        words = listed.select("phrase_id", F.posexplode(F.split("words", " ")).alias("offset", "term"))
        many = words.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("many"))
        counts, few = self._words(words)
        rows = self._rows(few)
        # In each field a phrase starts from its rarest word there; a field that lacks one of its words has no place for it.
        placed = words.join(counts, "term").groupBy("phrase_id", "field").agg(
            F.min(F.struct("df", "term", "offset")).alias("rare"), F.count(F.lit(1)).alias("known"))
        starts = placed.join(many, "phrase_id").filter("known = many").select("phrase_id", "field", "many", F.col("rare.term").alias("term"), F.col("rare.offset").alias("offset"))
        opened = rows.select("segment", "block", "term", "field", "entries").join(starts, ["term", "field"])
        found = opened.select("phrase_id", "field", "many", "segment", "block", "offset", F.explode("entries").alias("e"))
        places = F.filter(F.transform("e.positions", lambda p: p - F.col("offset")), lambda p: p >= 0)
        found = self._without_dead(found.select("phrase_id", "field", "many", "segment", "block", F.col("e.chunk_id").alias("chunk_id"), places.alias("places"))).filter(F.size("places") > 0)
        per_block = found.groupBy("phrase_id", "field", "many", "segment", "block").agg(F.collect_list(F.struct("chunk_id", "places")).alias("held"))  # at most one block of passages
        asked = per_block.join(words, "phrase_id")
        met = rows.select("segment", "block", "term", "field", "entries").join(asked, ["segment", "block", "term", "field"])

        def matching(held: Column, e: Column, offset: Column) -> Column:
            return F.array_intersect(F.transform(e["positions"], lambda p: p - offset), held["places"])

        pairs = F.transform("held", lambda h: F.struct(h["chunk_id"].alias("chunk_id"), F.flatten(F.transform(
            F.filter("entries", lambda e: e["chunk_id"] == h["chunk_id"]), lambda e: matching(h, e, F.col("offset")))).alias("places")))
        hits = met.select("phrase_id", "field", "many", "offset", F.explode(pairs).alias("h")).select("phrase_id", "field", "many", "offset", "h.chunk_id", F.explode("h.places").alias("place"))
        full = hits.groupBy("phrase_id", "field", "chunk_id", "place", "many").agg(F.count(F.lit(1)).alias("met")).filter("met = many")
        return full.select("phrase_id", "chunk_id", "field").distinct()
