"""Hard-negative mining: threshold joins of anchors with all rows, by an inverted index with norm bounds.

Two joins run over the same shards. The first finds the best rows of an anchor's own label (its positives), the second
fills, for each positive, a window of rows of other labels whose score lies between two shares of the positive's.

A shard holds a bounded number of components. Its dimensions are put in the order of their energy, greatest first, and for
a threshold ``t`` the index of a row leaves out the trailing dimensions whose norm, times the anchor's, cannot reach ``t``.
Blocks of anchors walk the lists dimension by dimension and add up partial scores; a pair is dropped as soon as its partial
score plus the product of the two remaining norms stays below ``t``. What is left is scored in whole numbers. Thresholds
start high and are lowered only for anchors whose windows are not full yet, down to the window's own bound.

Rows are placed once, by hash of their id, and anchors go to every shard; shards are as large as memory allows, so that
anchors are copied to few of them. A shard sends at most the best ``k`` rows of each window, and a second step keeps the
best of all shards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcelight.llm import common

SHARD_CELLS = 4_000_000  # components in a shard, and (anchor, row) pairs that are looked at together
ANCHORS = 64  # anchors that walk the index together
STEP = 8  # dimensions between two rounds of pruning
MOST = 1 << 25  # greatest whole component; larger ones have no exact score in 64 bits
STARTS = (0.9, 0.7, 0.5, 0.3, 0.15)  # thresholds of the first join, as shares of the greatest score a shard allows
_SLACK = 1e-9


def scaled(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """Rows that take part: ``id``, ``label``, ``vec`` (each component as ``floor(scale * x)``) and ``rid``, which names the
    row's content. Rows with a null id, label or vector, or with a component that is null, not finite or not below
    ``MOST`` after scaling, take no part."""
    at_most = F.lit(float(MOST) / scale)
    usable = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < at_most))
    rows = df.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(usable)
    whole = rows.select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vec"))
    return whole.select(F.xxhash64("id", "label", "vec").alias("rid"), "id", "label", "vec")


class Index:
    """The rows of one shard, their dimensions by falling energy."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.argsort(-np.square(vectors.astype(np.float64)).sum(axis=0), kind="stable")
        self.rows = vectors[:, self.order]
        self.rest = rest_norms(self.rows)

    def search(self, anchors: np.ndarray, least: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs (anchor, row) among the allowed ones with a score of at least ``least`` of the anchor, and their scores.

        ``anchors`` hold their dimensions in the index's order; ``least`` may be minus infinity.
        """
        left = rest_norms(anchors)
        whole = exact(anchors, self.rows)
        at_most = np.divide(least, left[:, 0], out=np.full(len(least), -np.inf), where=left[:, 0] > 0)
        reach = at_most.min(initial=np.inf)
        if not reach > 0:  # nothing can be left out
            scores = anchors.astype(whole) @ self.rows.astype(whole).T
            a, r = np.nonzero(allowed & (scores >= least[:, None]))
            return a, r, scores[a, r].astype(np.int64)
        held = (self.rest >= reach * (1 - _SLACK)).sum(axis=1)  # leading dimensions that the index keeps of each row
        by = np.argsort(-held, kind="stable")
        held = held[by]
        listed = int(np.searchsorted(-held, 0))  # rows that no anchor can reach are in no list
        by, held = by[:listed], held[:listed]
        rows, rest, open_ = self.rows[by].astype(whole), self.rest[by], allowed[:, by].copy()
        partial = np.zeros(open_.shape, whole)
        for start in range(0, int(held[0]) if listed else 0, STEP):
            m = int(np.searchsorted(-held, -start))  # lists of these dimensions hold the first m rows
            end = np.minimum(held[:m], start + STEP)
            lists = rows[:m, start:start + STEP] * (np.arange(start, start + rows[:m, start:start + STEP].shape[1]) < end[:, None])
            partial[:, :m] += anchors[:, start:start + STEP].astype(whole) @ lists.T
            bound = left[:, end] * rest[np.arange(m), end] * (1 + _SLACK) + partial[:, :m]
            open_[:, :m] &= bound >= least[:, None] - _SLACK * np.abs(least[:, None])
            if np.count_nonzero(open_) * 64 < open_.size:
                break
        a, r = np.nonzero(open_)
        scores = np.empty(len(a), np.int64)
        step = max(1, SHARD_CELLS // max(1, rows.shape[1]))
        for k in range(0, len(a), step):
            scores[k:k + step] = np.einsum("ij,ij->i", anchors[a[k:k + step]].astype(whole), rows[r[k:k + step]])
        keep = scores >= least[a]
        return a[keep], by[r[keep]], scores[keep]


def rest_norms(vectors: np.ndarray) -> np.ndarray:
    """Norm of each row from every dimension to the last one; zero after the last."""
    squares = np.square(vectors.astype(np.float64))
    out = np.zeros((len(vectors), vectors.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
    return out


def exact(a: np.ndarray, b: np.ndarray) -> type:
    """The number type in which sums of products of the two tables are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if most < 2**53 else np.int64


def first_of(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each group: higher scores first, then smaller ids, then the row's name."""
    by = np.lexsort((rids, ids, -scores, groups))
    g = groups[by]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return by[rank < k]


@dataclass
class Part:
    """Rows of a batch as arrays."""
    rid: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vec: np.ndarray
    wanted: list | None  # per anchor the scores of its positives

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], width: int) -> Part:
        table = pa.Table.from_batches(batches).combine_chunks()
        lists = table.column("vec").combine_chunks()
        vec = np.zeros((table.num_rows, width), np.int64)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        vec[np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
        return cls(table.column("rid").to_numpy(), table.column("id").to_numpy(), np.asarray(table.column("label").to_pylist(), object), vec, table.column("wanted").to_pylist())


class Shard:
    def __init__(self, rows: Part):
        _, first = np.unique(rows.rid, return_index=True)  # wholly repeated rows count once
        self.rid, self.id = rows.rid[first], rows.id[first]
        self.names, self.label = np.unique(rows.label[first].astype(str), return_inverse=True)
        self.index = Index(rows.vec[first])
        self.longest = float(self.index.rest[:, 0].max(initial=0))
        self.block = max(1, min(ANCHORS, SHARD_CELLS // max(1, len(first))))

    def codes(self, labels: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, labels.astype(str)).clip(0, len(self.names) - 1)
        return np.where(self.names[at] == labels.astype(str), at, -1)

    def positives(self, anchors: Part, k: int) -> pa.RecordBatch:
        """The first ``k`` other rows of the anchor's label."""
        vec, code = anchors.vec[:, self.index.order], self.codes(anchors.label)
        allowed = (self.label[None, :] == code[:, None]) & (self.id[None, :] != anchors.id[:, None])
        top = rest_norms(vec)[:, 0] * self.longest
        out, todo = [], np.flatnonzero(allowed.any(axis=1))
        for share in (*STARTS, -np.inf):
            if not len(todo):
                break
            a, r, s = self.index.search(vec[todo], np.where(top[todo] > 0, top[todo] * share, -np.inf), allowed[todo])
            full = np.bincount(a, minlength=len(todo)) >= (k if share > -np.inf else 0)
            keep = full[a]
            best = first_of(todo[a[keep]], s[keep], self.id[r[keep]], self.rid[r[keep]], k)
            out.append((todo[a[keep]][best], r[keep][best], s[keep][best]))
            todo = todo[~full]
        a, r, s = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.rid[a], self.id[r], s, self.rid[r])], ["rid", "id", "score", "other"])

    def negatives(self, anchors: Part, k: int, low: int, high: int) -> pa.RecordBatch:
        """For each positive the first ``k`` rows of other labels with a score from ``low`` to ``high`` percent of its."""
        vec, code = anchors.vec[:, self.index.order], self.codes(anchors.label)
        allowed = self.label[None, :] != code[:, None]
        owner = np.repeat(np.arange(len(anchors.id)), [len(w) for w in anchors.wanted])
        goal = np.asarray([x for w in anchors.wanted for x in w], np.int64)
        place = np.concatenate([np.arange(len(w)) for w in anchors.wanted]) if len(goal) else np.zeros(0, np.int64)
        out, todo = [], np.flatnonzero(goal >= 0)  # below zero the lower bound is above the upper one
        for part in (0.75, 0.5, 0.25, 0.0):
            if not len(todo):
                break
            percent = low + (high - low) * part
            floor = goal[todo] * (percent / 100)
            used, at = np.unique(owner[todo], return_inverse=True)
            least = np.full(len(used), np.inf)
            np.minimum.at(least, at, floor)
            a, r, s = self.index.search(vec[used], least * (1 - _SLACK), allowed[used])
            # each found pair meets the windows of its anchor, of which there are at most as many as positives
            by = np.argsort(at, kind="stable")
            start = np.searchsorted(at[by], np.arange(len(used) + 1))
            many = (start[1:] - start[:-1])[a]
            pair = np.repeat(np.arange(len(a)), many)
            w = by[np.repeat(start[a] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            fits = (100 * s[pair] >= np.where(part > 0, np.ceil(floor[w] * 100), low * goal[todo][w])) & (100 * s[pair] <= high * goal[todo][w])
            pair, w = pair[fits], w[fits]
            full = np.bincount(w, minlength=len(todo)) >= (k if part > 0 else 0)
            keep = full[w]
            pair, w = pair[keep], w[keep]
            best = first_of(todo[w], s[pair], self.id[r[pair]], self.rid[r[pair]], k)
            out.append((todo[w][best], r[pair][best], s[pair][best]))
            todo = todo[~full]
        w, r, s = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.rid[owner[w]], place[w], self.id[r], s, self.rid[r])], ["rid", "place", "id", "score", "other"])


def _joined(width: int, task: Callable[[Shard, Part], pa.RecordBatch]):
    """Partitions in the order of shard and kind, the rows of a shard before its anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, shard, waiting, held = None, [], None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, rows, waiting, held
            if waiting and (rows or shard is not None):
                if shard is None:
                    shard, rows = Shard(Part.of(rows, width)), []
                anchors = pa.Table.from_batches(waiting).combine_chunks()
                for k in range(0, anchors.num_rows, shard.block):
                    yield task(shard, Part.of(anchors.slice(k, shard.block).to_batches(), width))
            waiting, held = [], 0

        for batch in batches:
            number, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("shard", "kind"))
            new = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if number[a] != at:
                    yield from flush()
                    at, rows, shard = number[a], [], None
                if kind[a] == 0:
                    rows.append(batch.slice(a, b - a))
                else:
                    waiting.append(batch.slice(a, b - a))
                    held += (b - a) * width
                    if held >= SHARD_CELLS:
                        yield from flush()
        yield from flush()

    return run


def _over_shards(rows: DataFrame, anchors: DataFrame, shards: int, width: int, task, schema: str) -> DataFrame:
    placed = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "rid", "id", "label", "vec", F.lit(None).cast("array<bigint>").alias("wanted"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "rid", "id", "label", "vec", "wanted")
    both = placed.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(_joined(width, task), schema)


def _first(df: DataFrame, k: int, *group: str) -> DataFrame:
    """The first ``k`` rows of each group over all shards."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id", "other")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, shards: int | None = None) -> DataFrame:
    """Hard negatives of ``anchors``, both tables as :func:`scaled` gives them.

    ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``: for each of an
    anchor's first ``n_positives`` other rows of its label, the first ``n_negatives`` rows of other labels with ``low *
    positive_score <= 100 * negative_score <= high * positive_score``. Scores are inner products in whole numbers, higher
    ones come first, ties go by the smaller id.

    Wholly repeated rows count once. Rows that share an id with other contents count as rows of their own, but never as
    positives of an anchor of that id. Missing components of a shorter vector count as zero. Anchors without another row
    of their label, and windows that no row fits, give no rows; a negative positive score fits none. An empty table gives
    no rows. ``shards`` changes where rows are placed, never the result; by default it follows from the number of
    components, and is no less than the session's number of shuffle partitions.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    width = size["width"] or 0
    if shards is None:
        shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size["n"] * max(1, width) / SHARD_CELLS))
    seeds = anchors.dropDuplicates(["rid"]).withColumn("wanted", F.lit(None).cast("array<bigint>"))
    found = _over_shards(rows, seeds, shards, width, lambda shard, part: shard.positives(part, n_positives), "rid bigint, id bigint, score bigint, other bigint")
    best = _first(found, n_positives, "rid").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # at most n_positives
    paired = common.stored(seeds.drop("wanted").join(best, "rid"))
    goals = paired.withColumn("wanted", F.transform("positives", lambda p: p["score"]))
    task = lambda shard, part: shard.negatives(part, n_negatives, low, high)
    hard = _first(_over_shards(rows, goals, shards, width, task, "rid bigint, place bigint, id bigint, score bigint, other bigint"), n_negatives, "rid", "place")
    named = paired.select("rid", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("place", "positive"))
    hard = hard.select("rid", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(named, ["rid", "place"]).select("anchor_id", F.col("positive.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("positive.score").alias("positive_score"), "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.table(spark, sf_dir, "embeddings")
    shifted = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = scaled(shifted)
    return mine(rows, rows.filter(F.col("id") % 100 == 0))
