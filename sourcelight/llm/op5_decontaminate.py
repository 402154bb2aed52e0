"""Benchmark decontamination with suffix arrays over the training words.

The training texts are cut into shards of bounded size (slices of Arrow batches). In each shard the words become
numbers, the suffixes that can start like a benchmark item are sorted into a suffix array, and every suffix of every
item is binary-searched in it, one word deeper each time. What is left after ``window`` words (all words of a shorter
item) are exact occurrences; neighbours on one diagonal join to the longest verbatim matches with their places.
The item words are sent to the tasks in blocks of at most ``block_words`` words, one pass over the same rows each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight.llm import common

WINDOW = 10
BLOCK_WORDS = 2_000_000

_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_MATCH = T.ArrayType(T.StructType([
    T.StructField("item", T.StringType()), T.StructField("item_start", T.IntegerType()),
    T.StructField("doc_start", T.IntegerType()), T.StructField("n_words", T.IntegerType()),
]))


def words(text: str) -> list[bytes]:
    """Runs of letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split()


class Items:
    """The words of a block of items as numbers, and all their suffixes cut to the window."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in rows]
        self.vocab: dict[bytes, int] = {}
        self.window = window
        starts, owners, places, lengths, flat = [], [], [], [], []
        for number, (_, text) in enumerate(rows):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            if not ids:
                continue
            span = min(window, len(ids))
            for p in range(len(ids) - span + 1):
                starts.append(len(flat) + p)
                owners.append(number)
                places.append(p)
                lengths.append(span)
            flat.extend(ids)
        self.flat = np.array(flat + [0] * window, np.int64)
        self.starts, self.owners = np.array(starts, np.int64), np.array(owners, np.int64)
        self.places, self.lengths = np.array(places, np.int64), np.array(lengths, np.int64)
        base = len(self.vocab) + 2
        first = self.flat[self.starts] if len(starts) else np.zeros(0, np.int64)
        self.singles = np.unique(first[self.lengths == 1])
        long = self.lengths > 1
        self.pairs = np.unique(first[long] * base + self.flat[self.starts[long] + 1])
        self.base = base


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def suffix_array(sequence: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """The given positions in the order of the ``depth`` words from there on."""
    return positions[np.lexsort([sequence[positions + d] for d in range(depth - 1, -1, -1)])]


def _bound(column: np.ndarray, suffixes: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all queries at once, each in its own range of the suffix array."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        seen = column[suffixes[np.minimum(mid, len(suffixes) - 1)] + depth]
        up = open_ & ((seen <= wanted) if right else (seen < wanted))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def occurrences(sequence: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item window, position) of all exact occurrences in a padded sequence of word numbers."""
    none = np.zeros(0, np.int64)
    if not len(items.starts):
        return none, none
    n = len(sequence) - items.window
    head = sequence[:n]
    can = _member(head, items.singles) | _member(head * items.base + sequence[1:n + 1], items.pairs) & (head > 0) & (sequence[1:n + 1] > 0)
    positions = np.flatnonzero(can)
    if not len(positions):
        return none, none
    suffixes = suffix_array(sequence, positions, items.window)
    query = np.arange(len(items.starts))
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(suffixes), np.int64)
    found_query, found_at = [], []
    for depth in range(items.window):
        wanted = items.flat[items.starts[query] + depth]
        lo, hi = _bound(sequence, suffixes, depth, lo, hi, wanted, False), _bound(sequence, suffixes, depth, lo, hi, wanted, True)
        live = lo < hi
        query, lo, hi = query[live], lo[live], hi[live]
        done = items.lengths[query] == depth + 1
        if done.any():
            counts = (hi - lo)[done]
            offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            found_query.append(np.repeat(query[done], counts))
            found_at.append(suffixes[np.repeat(lo[done], counts) + offsets])
            query, lo, hi = query[~done], lo[~done], hi[~done]
        if not len(query):
            break
    if not found_query:
        return none, none
    return np.concatenate(found_query), np.concatenate(found_at)


def longest(items: Items, query: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Join windows of one item that follow each other on one diagonal: rows (item, item start, position, words)."""
    owner, place = items.owners[query], items.places[query]
    order = np.lexsort([at, at - place, owner])
    owner, place, at, span = owner[order], place[order], at[order], items.lengths[query][order]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | ((at - place)[1:] != (at - place)[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return np.stack([owner[first], place[first], at[first], at[last] - at[first] + span[last]], axis=1) if len(at) else np.zeros((0, 4), np.int64)


def _search(items: Items, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    match_type = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = items.vocab.get
        for batch in common.chunks(batches, "text"):
            lists = [words(t) for t in common.texts(batch, "text")]
            counts = np.array([len(x) for x in lists], np.int64)
            starts = np.concatenate([[0], np.cumsum(counts + 1)])  # a separator after each text
            sequence = np.full(starts[-1] + items.window, -1, np.int64)
            for s, x in zip(starts.tolist(), lists, strict=False):
                sequence[s:s + len(x)] = np.fromiter(map(get, x, repeat(0)), np.int64, len(x))
            matches = longest(items, *occurrences(sequence, items))
            owner = np.searchsorted(starts, matches[:, 2], side="right") - 1
            per: dict[int, list] = {}
            for d, (item, place, at, n) in zip(owner.tolist(), matches.tolist(), strict=True):
                per.setdefault(d, []).append({"item": items.names[item], "item_start": place, "doc_start": at - int(starts[d]), "n_words": n})
            column = batch.schema.get_field_index("matches")
            before = batch.column(column).to_pylist() if column >= 0 else [[]] * batch.num_rows
            merged = pa.array([old + per.get(i, []) for i, old in enumerate(before)], match_type)
            arrays, names = [batch.column(0), pa.array(counts), merged], ["key", "n_words", "matches"]
            if not last:
                arrays, names = [*arrays, batch.column(batch.schema.get_field_index("text"))], [*names, "text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks, each small enough for one broadcast; items without id or text are left out."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    block: list[tuple[str, str]] = []
    held = 0
    for row in rows.toLocalIterator():
        n = row.t.count(" ") + 1
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += n
    yield block


def benchmark_matches(df: DataFrame, benchmark: DataFrame, key: str | T.StructType = "doc_id", text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row's longest verbatim matches: ``key``, ``n_words``, ``matches`` (item, item_start, doc_start, n_words).

    A match has ``window`` words or more, or is a whole shorter item. ``key`` names the column that is kept; pass a
    struct column to keep a whole row. Rows keep their number: null and empty texts have no words and no match,
    repeated rows are searched one by one, items without words match nothing.
    """
    out = df.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    kind = out.schema["key"].dataType
    fields = [T.StructField("key", kind), T.StructField("n_words", T.LongType()), T.StructField("matches", _MATCH)]
    blocks = list(item_blocks(benchmark, item_id, item_text, block_words))
    for number, block in enumerate(blocks):
        last = number == len(blocks) - 1
        schema = T.StructType(fields if last else [*fields, T.StructField("text", T.StringType())])
        out = out.mapInArrow(_search(Items(block, window), last), schema)
    return out.withColumnRenamed("key", key)


def covered(matches: F.Column) -> F.Column:
    """Number of words inside any match."""
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("s"), (m["doc_start"] + m["n_words"]).alias("e"))))
    step = lambda acc, m: F.struct(
        (acc["n"] + F.greatest(F.lit(0), m["e"] - F.greatest(m["s"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], m["e"]).alias("end")
    )
    return F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step)["n"]


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``df`` without the rows that hold a window of a benchmark item, all columns as they were."""
    row, names = common.fresh("row"), df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias(row), F.col(text_col).alias("text"))
    kept = benchmark_matches(packed, benchmark, key=row, **options).filter(F.size("matches") == 0)
    return kept.select(*[F.col(row)[f"c{i}"].alias(c) for i, c in enumerate(names)])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    n_hit = covered(F.col("matches"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
