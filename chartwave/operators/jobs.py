"""Progress of jobs: parsing of log lines, and the state of each job's steps (batch form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chart import STEPS

PREFIX = "PROGRESS:"
EVENT = "type string, step string, runId string, image string, error string, timestamp long"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Events of the lines with the prefix and readable JSON; other lines are dropped."""
    body = F.from_json(F.substr("line", F.lit(len(PREFIX) + 1)), EVENT)
    read = lines.where(F.startswith("line", F.lit(PREFIX))).withColumn("e", body)
    return read.where(F.col("e.type").isNotNull()).select(*[c for c in lines.columns if c != "line"], "e.*")


def first_of_each(events: DataFrame, *keys: str) -> DataFrame:
    """The earliest event of each key: an at-least-once source replays events."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    return events.withColumn("place", place).where("place = 1").drop("place")


def step_index(step="step"):
    return F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col(step)).cast("int") - 1


def job_steps(events: DataFrame) -> DataFrame:
    """Rows (run_id, ord, step_id, status, failed): each job's steps after all its events.

    A job begins at its first start event; what comes before is ignored.  Steps only
    advance: the furthest step reached and those before it are complete, the next one is
    processing, and complete finishes all.
    """
    begin = F.min(F.when(F.col("type") == "start", F.col("seq"))).over(Window.partitionBy("run_id"))
    own = events.withColumn("begin", begin).where(F.col("seq") >= F.col("begin"))
    state = own.groupBy("run_id").agg(
        F.max(F.when(F.col("type") == "progress", step_index())).alias("reached"),
        F.max((F.col("type") == "complete").cast("int")).alias("done"), F.max((F.col("type") == "error").cast("int")).alias("failed"),
    )
    steps = F.posexplode(F.array(*[F.lit(s) for s in STEPS])).alias("ord", "step_id")
    rows = state.select("*", steps).withColumn("reached", F.coalesce("reached", F.lit(-2)))
    status = (
        F.when((F.col("done") == 1) | (F.col("ord") <= F.col("reached")) , "complete")
        .when(F.col("ord") == F.col("reached") + 1, "processing").when(F.col("ord") == 0, "complete").otherwise("waiting")
    )
    return rows.select("run_id", "ord", "step_id", status.alias("status"), (F.col("failed") == 1).alias("failed"))


def last_attempt(events: DataFrame) -> DataFrame:
    """Events (run_id, attempt, seq, type, step) of each job's last attempt, and its start.

    A job whose attempt fails is tried anew, and the next attempt reports its steps again: what the
    failed one reported no longer counts.  A start event counts whichever attempt it came with.
    """
    last = F.max("attempt").over(Window.partitionBy("run_id"))
    return events.withColumn("last", last).where((F.col("attempt") == F.col("last")) | (F.col("type") == "start")).drop("last")


def newest_jobs(events: DataFrame, most: int = 5) -> DataFrame:
    """The jobs started last, newest first (a top-k report)."""
    starts = events.where("type = 'start'").groupBy("run_id").agg(F.max("seq").alias("started"))
    return starts.orderBy(F.desc("started"), "run_id").limit(most)
