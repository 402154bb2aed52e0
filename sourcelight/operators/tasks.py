"""Task events: ordered logs, latest states and derived rows.

``events``: task_id, sequence, timestamp, state, phase_name, and whatever else a caller carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight import constants as K
from sourcelight.operators.ordered import ordered_scan


def latest_event(events: DataFrame) -> DataFrame:
    """Last event per task; an aggregate with partial results, so a busy task is no hot spot."""
    rest = [c for c in events.columns if c != "task_id"]
    return events.groupBy("task_id").agg(F.max_by(F.struct(*rest), "sequence").alias("e")).select("task_id", "e.*")


def visible_tasks(events: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """All unfinished tasks plus the 20 finished ones with the newest events."""
    last = latest_event(events)
    if dismissed is not None:
        last = last.join(dismissed.select("task_id"), "task_id", "left_anti")
    done = F.col("state").isin(K.FINISHED_STATES)
    return last.filter(~done).unionByName(last.filter(done).orderBy(F.desc("sequence")).limit(K.VISIBLE_FINISHED))


def merge_events(current: DataFrame, incoming: DataFrame, keep: int = K.MERGED_EVENTS) -> DataFrame:
    """Union by sequence, incoming rows win, newest ``keep`` in ascending order."""
    rest = [c for c in current.columns if c != "sequence"]
    both = current.withColumn("__p", F.lit(0)).unionByName(incoming.withColumn("__p", F.lit(1)))
    merged = both.groupBy("sequence").agg(F.max_by(F.struct(*rest), "__p").alias("e")).select("sequence", "e.*")
    return merged.orderBy(F.desc("sequence")).limit(keep).orderBy("sequence")


def sequence_violations(events: DataFrame, arrival: list[str]) -> DataFrame:
    """Events whose sequence is not above the last accepted one of their task, in arrival order.

    A rejected event does not move the log, so the comparison is with the running maximum.
    """
    scanned = ordered_scan(events, ["task_id"], arrival, maxes={"previous_sequence": "sequence"})
    return scanned.filter(F.col("sequence") <= F.col("previous_sequence"))


def task_rows(events: DataFrame) -> DataFrame:
    """One row per task from its log: kind and creation from the first event, the rest from the last."""
    first = F.min_by(F.struct("phase_name", "timestamp"), "sequence").alias("f")
    last = F.max_by(F.struct("state", "phase_name", "progress", "error_code", "recoverable", "timestamp"), "sequence").alias("l")
    return events.groupBy("task_id").agg(first, last).select(
        "task_id", F.col("f.phase_name").alias("kind"), "l.state", F.col("l.phase_name").alias("phase"), "l.progress",
        F.col("l.state").isin("cancelling", "cancelled").alias("cancellation_requested"),
        "l.error_code", F.coalesce("l.recoverable", F.lit(False)).alias("recoverable"),
        F.col("f.timestamp").alias("created_at"), F.col("l.timestamp").alias("updated_at"),
    )


def task_event_log(events: DataFrame, segment: int = 1000) -> DataFrame:
    """Ordered nested event list per task, in segments of at most ``segment`` events.

    A log of any length stays spread over rows; the segments of one task read in order are its whole log.
    """
    rest = [c for c in events.columns if c not in ("task_id", "sequence")]
    ranked = ordered_scan(events, ["task_id"], ["sequence"], rank="__rn")
    part = F.floor((F.col("__rn") - 1) / segment).cast("bigint")
    return ranked.withColumn("segment", part).groupBy("task_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("sequence", *rest))).alias("events"),
        F.max("sequence").alias("last_sequence"),
    )


def maximum_sequence(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("sequence"), F.lit(0)).cast("bigint").alias("maximum_sequence"))


def log_consistency(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks whose row and log disagree on the state, or whose log is empty."""
    last = events.groupBy("task_id").agg(F.max_by("state", "sequence").alias("log_state"))
    joined = tasks.select("task_id", "state").join(last, "task_id", "left")
    return joined.filter(~F.col("state").eqNullSafe(F.col("log_state")))


def interrupted_tasks(events: DataFrame, now: Column) -> DataFrame:
    """A failed_interrupted event for every task whose log ends while running or cancelling.

    New sequences follow the largest one. Their order is by task id; the rank is taken in slices.
    """
    stopped = latest_event(events).filter(F.col("state").isin("running", "cancelling")).select("task_id", "phase_name")
    ranked = ordered_scan(stopped, [], ["task_id"], rank="__rn")
    top = events.agg(F.coalesce(F.max("sequence"), F.lit(0))).scalar()
    return ranked.select(
        "task_id", (top + F.col("__rn")).cast("bigint").alias("sequence"), now.alias("timestamp"),
        F.lit("failed_interrupted").alias("state"), "phase_name",
        F.lit("failed_interrupted").alias("error_code"), F.lit(True).alias("recoverable"),
    )


def status_rollup(tasks: DataFrame, group: list[str], listening: Column | None = None) -> DataFrame:
    """One status per group from its newest unfinished task, else from its newest task.

    ``tasks``: latest event per task with ``sequence``, ``state``, ``phase_name`` and the group columns.
    """
    listening = F.lit(False) if listening is None else listening
    active = F.col("state").isin(K.ACTIVE_STATES)
    newest = tasks.groupBy(*group).agg(
        F.max_by(F.struct("state", "phase_name"), F.when(active, F.col("sequence"))).alias("a"),
        F.max_by("state", "sequence").alias("last"),
    )
    state, phase = F.col("a.state"), F.col("a.phase_name")
    status = (
        F.when(state == "cancelling", "cancelling").when(state == "waiting_for_user", "waiting")
        .when(state.isNotNull() & phase.rlike("(?i)research|fetch|search"), "researching")
        .when(state.isNotNull() & phase.rlike("(?i)creat|generat|build|image"), "creating")
        .when(state.isNotNull(), "thinking")
        .when(F.col("last").isin("failed", "failed_interrupted"), "error")
        .when(F.col("last") == "completed", "completed")
        .when(listening, "listening").otherwise("idle")
    )
    return newest.select(*group, status.alias("status"))
