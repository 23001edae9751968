"""Job tracking over a stream of progress events, with keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.chart import STEPS

OUT = "run_id long, seq long, ord int, step_id string, status string, failed boolean"


def advance(state: dict | None, kind: str, step: str | None, monotone: bool) -> dict | None:
    """A job's state after one event: status of each step, and whether it failed.

    Monotone, steps never go back.  Otherwise the named step and those before it are
    complete and the next one is processing, whatever they were; an unknown step sets
    the first one to processing.
    """
    if kind == "start":
        return state if state and monotone else {"status": ["complete"] + ["waiting"] * (len(STEPS) - 1), "failed": False}
    if state is None:
        return None
    status = state["status"]
    if kind == "progress":
        at = STEPS.index(step) if step in STEPS else -1
        if at < 0 and monotone:
            return state
        for i in range(at + 1):
            status[i] = "complete"
        if at + 1 < len(STEPS) and not (monotone and status[at + 1] == "complete"):
            status[at + 1] = "processing"
    elif kind == "complete":
        status[:] = ["complete"] * len(STEPS)
    elif kind == "error":
        state["failed"] = True
    return state


def track(events: DataFrame, monotone: bool = True) -> DataFrame:
    """Steps of each job after each batch of its events (run_id, seq, type, step).

    Events of one batch are applied by seq.  Events of a job not yet started are ignored.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else None
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for r in rows.itertuples():
            state = advance(state, r.type, r.step, monotone)
        if state is not None:
            held.update((json.dumps(state),))
            n = len(STEPS)
            yield pd.DataFrame(
                {"run_id": [key[0]] * n, "seq": [int(rows.seq.max())] * n, "ord": range(n), "step_id": STEPS, "status": state["status"], "failed": [state["failed"]] * n}
            )

    return events.groupBy("run_id").applyInPandasWithState(update, OUT, "state string", "update", GroupStateTimeout.NoTimeout)


def track_attempts(events: DataFrame) -> DataFrame:
    """Steps of each job after each batch of its events (run_id, attempt, seq, type, step), and the attempt they belong to.

    The first event of a later attempt sets a started job back to its first step; events of an
    earlier attempt that come late change nothing.  Steps of one attempt never go back.  Events of
    one batch are applied by attempt and seq; those before a job's start only say which attempt is on.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        attempt, begin, state = json.loads(held.get[0]) if held.exists else (-1, None, None)
        rows = pd.concat(list(frames)).sort_values(["attempt", "seq"], kind="stable")
        starts = rows.seq[rows.type == "start"]
        if begin is None and len(starts):
            begin = int(starts.min())
        for r in rows.itertuples():
            if r.attempt > attempt:
                attempt, state = int(r.attempt), None
            if begin is not None and r.seq >= begin and r.attempt == attempt:
                state = advance(state or advance(None, "start", None, True), r.type, r.step, True)
        if begin is not None and state is None:
            state = advance(None, "start", None, True)
        held.update((json.dumps([attempt, begin, state]),))
        if state is not None:
            n = len(STEPS)
            yield pd.DataFrame(
                {"run_id": [key[0]] * n, "attempt": [attempt] * n, "seq": [int(rows.seq.max())] * n, "ord": range(n), "step_id": STEPS, "status": state["status"], "failed": [state["failed"]] * n}
            )

    out = OUT.replace("run_id long, ", "run_id long, attempt int, ")
    return events.groupBy("run_id").applyInPandasWithState(update, out, "state string", "update", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first event of each (run_id, step) within the watermark; ts must be a timestamp."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "step"])


def windowed_counts(events: DataFrame, size: str, delay: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return stamped.groupBy(F.window("ts", size), "type").count()


def classify_end(exit_code, success):
    """The final event of a run: error on a bad exit or a result that reports failure."""
    return F.when((exit_code != 0) | ~F.coalesce(success, F.lit(True)), F.lit("error")).otherwise(F.lit("complete"))


def steady(frames: DataFrame, key: str = "camera", need: int = 10) -> DataFrame:
    """(key, seq): a capture each time `need` detections in a row are positive; frames: (key, seq, found).

    A negative or missing detection starts the count anew, and so does a capture.  Frames of
    one batch are taken by seq; the count goes on in the next batch.
    """

    def update(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n = held.get[0] if held.exists else 0
        fired = []
        for r in pd.concat(list(parts)).sort_values("seq", kind="stable").itertuples():
            n = n + 1 if r.found is True or r.found == 1 else 0
            if n >= need:
                fired.append(int(r.seq))
                n = 0
        held.update((n,))
        yield pd.DataFrame({key: [k[0]] * len(fired), "seq": fired})

    kind = dict(frames.dtypes)[key]
    return frames.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, seq long", "n int", "append", GroupStateTimeout.NoTimeout)


def predictions(events: DataFrame) -> DataFrame:
    """(run_id, prediction): the last prediction that a complete or earlier event of a job carried."""
    last = F.max_by("prediction", F.when(F.col("prediction").isNotNull(), F.col("seq")))
    return events.groupBy("run_id").agg(last.alias("prediction"))


def each_batch(report):
    """A sink for writeStream.foreachBatch that tells `report` each finished batch's number and rows."""

    def run(batch: DataFrame, number: int) -> None:
        report(number, batch.count())

    return run
