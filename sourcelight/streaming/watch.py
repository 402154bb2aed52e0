"""Debounced file changes and retry cooldown, as streams and as their batch twins.

Time is the observation time in the data, so a replay gives the same result. A micro-batch is cut into slices of time that
hold about the same share of it however its rows are spread over keys; slices are looked at in parallel, and what one slice
leaves behind for a key is a short summary that is put together with those before it. So one busy key is no single task.
What a batch leaves behind for the next one (three fields for each key) is a keyed table in the stream's own folder.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sourcelight import constants as K
from sourcelight.operators.ordered import ordered_scan, sliced, unsliced, with_slice
from sourcelight.session import scratch_dir, stored
from sourcelight.sources.keyed import KeyedTable

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIRST = -(1 << 62)  # stands before every observation of a batch
_ORDER = ["observed_us", "observation_id"]
SLICE_SHARES = 8  # groups of a slice, by key


def use_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


# --- debounced changes ------------------------------------------------------------

def _islands(observations: DataFrame) -> DataFrame:
    """Every observation with the start of its island: the run of equal fingerprints of its file."""
    seen = ordered_scan(sliced(observations, _ORDER), ["path_key"], _ORDER, rank="__rn", lags={"__prev": "fingerprint"})
    starts = (F.col("__rn") == 1) | ~F.col("fingerprint").eqNullSafe(F.col("__prev"))
    marked = seen.withColumn("__start", F.when(starts, F.col("observed_us")))
    carried = ordered_scan(marked, ["path_key"], _ORDER, carried={"__open": "__start"})
    return unsliced(carried.withColumn("first_seen_us", F.coalesce("__start", "__open")))


def _ready(islands: DataFrame) -> DataFrame:
    late = (F.col("observed_us") - F.col("first_seen_us") >= K.STABLE_MICROS) & F.col("__start").isNull() & F.col("fingerprint").isNotNull()
    return islands.filter(late).groupBy("path_key", "fingerprint", "first_seen_us").agg(F.min("observed_us").alias("ready_us"))


def stable_changes(observations: DataFrame) -> DataFrame:
    """A file's fingerprint once it was seen twice and for 750 ms: islands of an unchanged fingerprint, and the first
    observation late enough in each. ``observations``: path_key, fingerprint (NULL when the file is gone), observed_us,
    observation_id."""
    return _ready(_islands(observations))


def stable_batch(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes that become ready in a batch, and what it leaves behind for its keys.

    ``carried`` (path_key, fingerprint, first_seen_us, emitted): the open island of each key. It enters the batch as one
    observation at the island's start. The second table has the same columns; a null fingerprint means nothing is open.
    """
    columns = ["path_key", "fingerprint", *_ORDER]
    mine = carried.join(batch.select("path_key").distinct(), "path_key", "left_semi")
    before = mine.select("path_key", "fingerprint", F.col("first_seen_us").alias("observed_us"), F.lit(_FIRST).alias("observation_id"))
    # Written once: both tables read it, and the second one is read several times when it is put into the state.
    islands = stored(_islands(batch.select(*columns).unionByName(before)))
    ready = _ready(islands).join(mine.filter("emitted").select("path_key", "fingerprint", "first_seen_us"), ["path_key", "fingerprint", "first_seen_us"], "left_anti")
    last = islands.groupBy("path_key").agg(F.max_by(F.struct("fingerprint", "first_seen_us"), F.struct(*_ORDER)).alias("s")).select("path_key", "s.*")
    known = ready.select("path_key", "first_seen_us", F.lit(True).alias("now")).unionByName(mine.filter("emitted").select("path_key", "first_seen_us", F.lit(True).alias("now")))
    left = last.join(known.distinct(), ["path_key", "first_seen_us"], "left")
    return ready, left.select("path_key", "fingerprint", "first_seen_us", F.coalesce("now", F.lit(False)).alias("emitted"))


# --- cooldown -----------------------------------------------------------------------

def _runs(frame: pd.DataFrame, order: list[str]) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """Rows by key and ``order``, and where each key's rows begin and end."""
    frame = frame.assign(__code=pd.factorize(frame["path_key"], use_na_sentinel=False)[0]).sort_values(["__code", *order], kind="stable")
    starts = np.flatnonzero(np.diff(frame.pop("__code").to_numpy(), prepend=-1)).tolist()
    return frame, list(zip(starts, [*starts[1:], len(frame)], strict=True))


def _next(at: list[int], ok: list[bool], runs: list[tuple[int, int]]) -> list[int]:
    """The attempt after each one that is made: the next one if it succeeds, the first one after its cooldown if it fails."""
    after = list(range(1, len(at) + 1))
    for start, stop in runs:
        j = start
        for i in range(start, stop):
            if not ok[i]:
                until = at[i] + K.COOLDOWN_MICROS
                while j < stop and at[j] < until:
                    j += 1
                after[i] = j
    return after


def _summary(frame: pd.DataFrame) -> pd.DataFrame:
    """What a slice does to a cooldown that comes in, for each of its keys: the attempts by the end they lead to.

    An attempt leads to the same ones whatever was before it, so a run is one walk from its end. A cooldown that comes in
    from an earlier slice ends at most 30 s after this slice's first attempt, so only attempts up to the first one after that
    can be made first; neighbours that lead to the same end are one.
    """
    frame, runs = _runs(frame, _ORDER)
    at, ok = frame["observed_us"].tolist(), frame["ok"].tolist()
    after, ends, rows = _next(at, ok, runs), [0] * len(at), []
    for start, stop in runs:
        for i in range(stop - 1, start - 1, -1):
            ends[i] = ends[after[i]] if after[i] < stop else _FIRST if ok[i] else at[i] + K.COOLDOWN_MICROS
        many = min(stop, bisect_left(at, at[start] + K.COOLDOWN_MICROS, start, stop) + 1)
        last = [i for i in range(start, many) if i == many - 1 or ends[i] != ends[i + 1]]
        rows.append((start, [at[i] for i in last], [ends[i] for i in last]))
    heads = frame.iloc[[r[0] for r in rows]]
    return pd.DataFrame({"path_key": heads["path_key"], "slice": heads["slice"], "upto": [r[1] for r in rows], "ends": [r[2] for r in rows]})


def _chain(frame: pd.DataFrame) -> pd.DataFrame:
    """The cooldown that comes into each slice of each key, from the summaries of its slices."""
    frame, runs = _runs(frame, ["slice"])
    every, enters, leaves = list(zip(frame["upto"], frame["ends"], strict=True)), [], []
    for start, stop in runs:
        until = _FIRST
        for upto, ends in every[start:stop]:
            enters.append(until)
            place = bisect_left(upto, until)
            if place < len(upto):
                until = int(ends[place])
        leaves += [until] * (stop - start)
    return pd.DataFrame({"path_key": frame["path_key"], "slice": frame["slice"], "enters": enters, "leaves": leaves})


def _made(frame: pd.DataFrame) -> pd.DataFrame:
    """Attempts of one slice that are made."""
    frame, runs = _runs(frame, _ORDER)
    at, made = frame["observed_us"].tolist(), []
    after, enters = _next(at, frame["ok"].tolist(), runs), frame["enters"].tolist()
    for start, stop in runs:
        i = bisect_left(at, enters[start], start, stop)
        while i < stop:
            made.append(i)
            i = after[i]
    return frame.iloc[made][["path_key", "observation_id", "observed_us", "ok"]]


def cooldown_batch(batch: DataFrame, carried: DataFrame, fanout: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Attempts that are made in a batch, and the cooldown it leaves behind for its keys (path_key, until; NULL: none).

    ``carried``: path_key, until. Slices are folded in parallel, each with all its keys in a few
    groups; only their summaries, a row for each key and slice, meet by key, many keys to a group.
    """
    kind = batch.schema["path_key"].dataType.simpleString()
    free = batch.join(carried.select("path_key", "until"), "path_key", "left").filter("until is null or observed_us >= until")  # the others are ignored
    rows = with_slice(free.select("path_key", "observation_id", "observed_us", "ok"), "observed_us", fanout).withColumnRenamed("__os_slice", "slice")
    # A group is a share of a slice: there are as many as slices, not as many as keys times slices.
    share = lambda n: F.pmod(F.xxhash64("path_key"), F.lit(n)).alias("share")
    summaries = rows.groupBy("slice", share(SLICE_SHARES)).applyInPandas(_summary, f"path_key {kind}, slice int, upto array<bigint>, ends array<bigint>")
    parts = 4 * int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    chained = summaries.groupBy(share(parts)).applyInPandas(_chain, f"path_key {kind}, slice int, enters bigint, leaves bigint")
    entered = rows.join(chained.select("path_key", "slice", "enters"), ["path_key", "slice"])
    made = entered.groupBy("slice", share(SLICE_SHARES)).applyInPandas(_made, f"path_key {kind}, observation_id bigint, observed_us bigint, ok boolean")
    left = chained.groupBy("path_key").agg(F.max("leaves").alias("until"))  # the same in all slices of a key
    return made, left.withColumn("until", F.when(F.col("until") > _FIRST, F.col("until")))


def retry_cooldown(attempts: DataFrame, fanout: int | None = None) -> DataFrame:
    """Attempts that are made: for 30 s after a failure the key is ignored.

    ``attempts``: path_key, observation_id, observed_us, ok.
    """
    return cooldown_batch(attempts, attempts.select("path_key", F.lit(None).cast("bigint").alias("until")).limit(0), fanout)[0]


# --- streams ------------------------------------------------------------------------

def _follow(stream: DataFrame, step: Callable, state: str, out: str, checkpoint: str, once: bool) -> StreamingQuery:
    """Run ``step(batch, carried)`` on each micro-batch; its rows go to ``out/rows``, what it leaves behind to ``out/state``.

    Rows of a batch are written before its state, and the state names the batch, so a batch that is tried again after a
    failure either finds its state written and is over, or starts from the same state and overwrites its own rows.
    """
    spark = stream.sparkSession
    kind = stream.schema["path_key"].dataType.simpleString()
    table = KeyedTable(spark, f"{out}/state", ["path_key"], T.StructType.fromDDL(f"path_key {kind}, {state}"))

    def store(batch: DataFrame, number: int) -> None:
        if table.tag() is not None and table.tag() >= number:
            return
        batch = batch.persist()  # read by several steps; lost parts are read from the source again
        rows, left = step(batch, table.read())
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        table.upsert(stored(left), tag=number)  # an upsert reads its rows several times
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def follow_stable_changes(observations: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Stream of debounced changes, see :func:`stable_changes`; set ``maxFilesPerTrigger`` on the source to bound a batch.

    Observations of a later batch are taken as later ones: the source has to bring them in the order of time.
    """
    return _follow(observations, stable_batch, "fingerprint string, first_seen_us bigint, emitted boolean", out, checkpoint, once)


def follow_retry_cooldown(attempts: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Stream of attempts that are made, see :func:`retry_cooldown`, with batches in the order of time."""
    return _follow(attempts, cooldown_batch, "until bigint", out, checkpoint, once)


def followed(follow: Callable, stream: DataFrame) -> DataFrame:
    """Run a stream of this module until its input is read and return what it wrote."""
    folder = scratch_dir(stream.sparkSession)
    follow(stream, folder, f"{folder}/checkpoint").awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows").drop("batch")

