"""Helpers shared by the text operators: tables, batches, cut lineage, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that Python tasks get: memory stays bounded
#: when texts are long.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20
#: Bytes of text that a task takes apart at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that this session sends to Python tasks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow for a function of one batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list:
    """The column's texts as UTF-8 bytes, None for null."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in that column have at most so many bytes, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes):
        yield batch.slice(start)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/chartwave-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, written as a table in the shared folder and read again.

    Unlike a cache this survives the loss of executors, and what reads it does
    not run the plan above it again.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a frame that cut() returned and nothing needs any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; label holds each position's smallest member, before and after."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != label[label]).any():
            label[:] = label[label]


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (src, dst), both long: rows (node, component).

    component is the smallest node reachable.  Nodes without a link to another
    node are absent.  Alternating large-star and small-star rounds: each replaces
    a node's links by links to the smallest neighbour, so the number of links
    never grows, and after a few rounds every component is one star.  Each round
    is written to the shared folder, and the loop ends when a round changes
    nothing.  No node, link or component is sent to the driver.
    """

    def canonical(e: DataFrame) -> DataFrame:
        lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
        return e.select(hi.alias("src"), lo.alias("dst")).where("src <> dst").distinct()

    edges = cut(canonical(links))
    state = None
    while True:
        # Each table is written before the join that reads it: both sides of a join are then
        # plain, and a node with very many links can be split over tasks.
        both = edges.union(edges.select("dst", "src")).toDF("u", "v")
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        down = cut(canonical(large).toDF("u", "v"))
        lower = cut(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(lower, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        after = cut(canonical(small.union(lower.toDF("src", "dst"))))
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        for spent in (edges, least, down, lower):
            drop_table(spent)
        edges = after
        if now == state or not now[0]:
            break
        state = now
    roots = edges.select(F.col("dst").alias("node")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
