"""Views of the driver's tables as signals, rasters, boxes, texts and progress events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chart import STEPS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, *keys: str):
    return F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id")) - 1


def sig_user(spark: SparkSession, sf_dir: str, every_null: int = 0) -> DataFrame:
    """(run_id, lead, idx, v): each user's values in time order; with every_null some are null."""
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % every_null != 0, F.col("value")) if every_null else F.col("value")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("lead"), numbered(e, "user_id").alias("idx"), v.alias("v"))


def sig_type(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("run_id"), numbered(e, "user_id").alias("idx"), F.col("value").alias("v"))


def sig_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, idx, ref, est): a user's click and view values, zipped to the shorter."""
    ref, est = (sig_type(spark, sf_dir, k).withColumnRenamed("v", n) for k, n in (("click", "ref"), ("view", "est")))
    return ref.join(est, ["run_id", "idx"])


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, gray): each vector as an image of 8 x 8."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    low, high = F.array_min("e"), F.array_max("e")
    cells = e.select("vec_id", low.alias("lo"), high.alias("hi"), F.posexplode("e").alias("pos", "p"))
    gray = F.floor((F.col("p") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 255).cast("int")
    return cells.select(F.col("vec_id").alias("image_id"), F.expr("CAST(pos div 8 AS INT)").alias("y"), (F.col("pos") % 8).alias("x"), gray.alias("gray"))


def raster_bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, b, g, r): three vectors in a row are the channels of an image."""
    cells = raster(spark, sf_dir).withColumn("channel", F.col("image_id") % 3).withColumn("image_id", F.expr("image_id div 3"))
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("gray")))
    return cells.groupBy("image_id", "y", "x").agg(pick(0).alias("b"), pick(1).alias("g"), pick(2).alias("r")).where("r IS NOT NULL")


def mask_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(image_id, y, x) of true pixels: even vectors as traces, odd ones as projections."""
    on = raster(spark, sf_dir).where("gray >= 128")
    own = lambda side: on.where(F.col("image_id") % 2 == side).select(F.expr("image_id div 2").alias("image_id"), "y", "x")
    return own(0), own(1)


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("image_id"), ((F.col("turn") % 4) * 90).alias("angle"), F.col("turn").alias("variant"), "text")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token): marks as a reader finds them on a chart, made from line numbers and quantities."""
    pick = lambda xs, at: F.get(F.array(*[F.lit(x) for x in xs]), at.cast("int"))
    head = pick(("V", "a V ", "|", "v ", "x"), F.col("l_linenumber") % 5)
    tail = pick(("1", "R", "I", "II", "6", "L", "f"), F.col("l_quantity").cast("long") % 7)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(head, tail).alias("token"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-corner boxes on images of 200 x 200; returned lines are the wanted label."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("shape"),
        F.when(F.col("l_returnflag") == "R", F.lit("ecg")).otherwise(F.lit("other")).alias("label"),
        F.col("l_quantity").alias("xa"), (F.col("l_extendedprice") / 1000).alias("ya"),
        (F.col("l_discount") * 500).alias("xb"), (F.col("l_tax") * 500).alias("yb"),
        F.lit(200).alias("width"), F.lit(200).alias("height"),
    )


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shape_id, i, x, y): the first four lines of each order that has them."""
    w = Window.partitionBy("l_orderkey")
    order = w.orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("shape_id"), F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(w).alias("n"),
        F.col("l_quantity").alias("x"), (F.col("l_discount") * 1000).alias("y"),
    )
    return p.where("n >= 4 AND i <= 4").drop("n")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, seq, type, step): events as the progress of jobs."""
    k = F.get_json_object("props", "$.k").cast("int") % 8
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'progress' END")
    step = F.get(F.array(*[F.lit(s) for s in STEPS]), k)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("type"), step.alias("step"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, attempt, seq, type, step): progress of jobs that are tried anew after each error."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    tries = F.coalesce(F.sum((F.col("type") == "error").cast("int")).over(w), F.lit(0))
    return progress(spark, sf_dir).withColumn("attempt", tries.cast("int"))


def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, line): progress events as a job prints them, among other lines and broken ones."""
    p = progress(spark, sf_dir)
    good = F.concat(F.lit("PROGRESS:"), F.to_json(F.struct("type", "step", F.col("run_id").cast("string").alias("runId"))))
    line = F.when(F.col("seq") % 10 == 3, F.lit("PROGRESS:{bad")).when(F.col("seq") % 10 == 7, F.lit("hello")).otherwise(good)
    return p.select("seq", line.alias("line"))


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("label")).agg(F.sum("value").alias("s"))
    return e.select("run_id", "label", (F.col("s") / F.sum("s").over(Window.partitionBy("run_id"))).alias("p"))


#: Plates that one task draws, and sheets or charts that it hands over at once.
IMAGES, AT_ONCE = 500, 16


def dealt(keys: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each image, dealt out by image_id, `most` (IMAGES) to a partition: their table is small, what is drawn from it is not."""
    parts = max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // (most or IMAGES)))
    return keys.repartition(parts, "image_id")


def drawn(keys: DataFrame, picture) -> DataFrame:
    """(image_id, width, height, px): picture(rest of a row of keys) of each, AT_ONCE to a batch."""

    def draw(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                made = [picture(*row).tobytes() for row in zip(*[c.to_pylist() for c in part.columns])]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(made, pa.binary())], names=["image_id", "width", "height", "px"])

    # A sheet or chart has many times the pixels of a plate.
    return dealt(keys, max(1, IMAGES // 5)).mapInArrow(draw, "image_id int, width int, height int, px binary")


def plate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height) of a plate for each supplier."""
    k = F.col("s_suppkey").cast("int")
    return table(spark, sf_dir, "supplier").select(k.alias("image_id"), (20 + (k * 7) % 45).alias("width"), (16 + (k * 11) % 37).alias("height"))


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, y, x, gray, b, g, r): one image of its own size for each supplier."""
    sizes = dealt(plate_sizes(spark, sf_dir))
    rows = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    i, y, x = F.col("image_id"), F.col("y"), F.col("x")
    gray = (x * x * 3 + y * 7 * (i % 13 + 1) + x * y) % 256
    # Made once for each pixel: Spark would otherwise write the arithmetic into every place of a filter that names a colour.
    made = F.inline(F.array(F.struct(gray.alias("gray"), gray.alias("b"), ((x * 5 + y * 3 + i) % 256).alias("g"), ((x * y + i * 11) % 256).alias("r"))))
    return rows.select("*", made)


def plate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, px): the plates as whole images, three bytes (b, g, r) for each pixel."""
    colour = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in ("b", "g", "r")])
    rows = plates(spark, sf_dir).withColumn("at", F.col("y") * F.col("width") + F.col("x"))
    held = rows.groupBy("image_id", "width", "height").agg(F.sort_array(F.collect_list(F.struct("at", colour.alias("c")))).alias("all"))
    return held.select("image_id", "width", "height", F.unhex(F.array_join("all.c", "")).alias("px"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, px): for each supplier a drawn sheet on a dark table, turned; every other has red corner marks."""
    k = F.col("s_suppkey").cast("int")
    keys = table(spark, sf_dir, "supplier").select(k.alias("image_id"), (240 + (k * 7) % 45).alias("width"), (190 + (k * 11) % 37).alias("height"), ((k * 5) % 13 - 6).cast("double").alias("angle"), (k % 2 == 0).alias("marks"))

    def sheet(_, width, height, angle, marks):
        y, x = np.indices((height, width)) + 0.0
        c, s = np.cos(np.deg2rad(angle)), np.sin(np.deg2rad(angle))
        v = np.rint(-s * (x - width // 2) + c * (y - height // 2) + height // 2).astype(int)
        u = np.rint(c * (x - width // 2) + s * (y - height // 2) + width // 2).astype(int)
        inside = (v >= 28) & (v < height - 28) & (u >= 28) & (u < width - 28)
        grid = inside & (((v - 28) % 18 < 2) | ((u - 28) % 18 < 2))
        corner = marks & inside & (np.minimum(np.abs(v - 38), np.abs(v - height + 38)) < 6) & (np.minimum(np.abs(u - 38), np.abs(u - width + 38)) < 6)
        px = np.full((height, width, 3), 30, dtype=np.uint8)
        for where, colour in ((inside, (235, 235, 235)), (grid, (170, 175, 235)), (corner, (20, 20, 220))):
            px[where] = colour
        return px

    return drawn(keys, sheet)


def chart_shape(key: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Baselines of the four rows of a drawn chart, and how far its trace lies above them at each column."""
    x = np.arange(width)
    wave = (7 + key % 4) * np.sin(2 * np.pi * x / (36 + key % 9)) + 4 * np.sin(2 * np.pi * (x + key) / 90)
    return (np.array([0.14, 0.38, 0.62, 0.86]) * height).astype(int) + key % 5 - 2, wave


def chart_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height) of a chart for each supplier."""
    k = F.col("s_suppkey").cast("int")
    return table(spark, sf_dir, "supplier").select(k.alias("image_id"), (360 + (k * 37) % 120).alias("width"), (260 + (k * 23) % 60).alias("height"))


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, px): those charts drawn, bright on black: three rows of leads and a rhythm strip."""

    def chart(key, width, height):
        px = np.zeros((height, width, 3), dtype=np.uint8)
        rows, wave = chart_shape(key, width, height)
        for row in rows:
            for thick in (-1, 0, 1):
                px[np.rint(row - wave).astype(int) + thick, np.arange(width)] = 255
        return px

    return drawn(chart_sizes(spark, sf_dir), chart)


def chart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x): places of the labels read on every other of those charts, a little beside the columns' middles."""
    own = chart_sizes(spark, sf_dir).where("image_id % 2 = 0")
    middle = F.expr("CAST((2 * i + 1) * width / 8 AS INT) + 2 * (image_id % 7) - 6")
    return own.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("image_id", middle.alias("x"))


def chart_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, row_idx, y): baselines given for every third of those charts."""
    own = chart_sizes(spark, sf_dir).where("image_id % 3 = 0")
    shares = F.posexplode(F.array(*[F.lit(s) for s in (0.14, 0.38, 0.62, 0.86)])).alias("row_idx", "share")
    return own.select("*", shares).select("image_id", "row_idx", F.expr("CAST(floor(share * height) AS INT) + image_id % 5 - 2").alias("y"))
