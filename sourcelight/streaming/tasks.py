"""Task events as a stream: latest state per task, and events out of sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def task_state_stream(events: DataFrame) -> DataFrame:
    """Latest event per task in update mode. Stale and repeated sequences cannot win.

    A built-in aggregate: state is one row per task, partial maxima are taken before the shuffle.
    """
    rest = [c for c in events.columns if c != "task_id"]
    return events.groupBy("task_id").agg(F.max_by(F.struct(*rest), "sequence").alias("e")).select("task_id", "e.*")


class _Violations(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "sequence bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self._last.get()[0] if self._last.exists() else None
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        seen = frame["sequence"].cummax().shift()
        if last is not None:
            seen = seen.fillna(last).clip(lower=last)
        late = frame["sequence"] <= seen
        self._last.update((int(max(frame["sequence"].max(), last if last is not None else frame["sequence"].max())),))
        out = frame.loc[late, ["sequence"]].assign(task_id=key[0], previous_sequence=seen[late].astype("int64"))
        yield out[["task_id", "sequence", "previous_sequence"]]

    def close(self) -> None:
        pass


def task_violation_stream(events: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Events whose sequence is not above the largest one seen for their task. ``arrival`` orders a batch."""
    return events.select("task_id", "sequence", "arrival").groupBy("task_id").transformWithStateInPandas(
        _Violations(), f"task_id {key_type}, sequence bigint, previous_sequence bigint", "Append", "None"
    )
