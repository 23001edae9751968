"""What is drawn from a small table is dealt out, and never broadcast."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartwave.operators import strokes, tiles
from chartwave.plans import catalog
from chartwave.sources import adapters

from .conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("source", ["plates", "sheets", "charts"])
def test_images_are_dealt_out(spark, monkeypatch, source):
    """all images of a small table were drawn by one task."""
    monkeypatch.setattr(adapters, "IMAGES", 5)
    made = getattr(adapters, source)(spark, f"{DATA}/sf0.001")
    keys = adapters.plate_sizes(spark, f"{DATA}/sf0.001").count()
    assert made.rdd.getNumPartitions() >= max(8, keys // 5)


def test_a_drawn_batch_is_bounded(spark):
    """a batch held as many images as the table has, up to 10,000."""
    made = adapters.sheets(spark, f"{DATA}/sf0.01")
    most = made.select("image_id").mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
    assert most.agg(F.sum("n")).first()[0] == made.count()


@pytest.mark.parametrize("name", ["paper_band", "mask_without_lines", "resample_linear", "plate_contrast"])
def test_pixels_are_not_broadcast(spark, name):
    """Spark took rows made from a small table for small and broadcast them."""
    assert "BroadcastHashJoin" not in plan(catalog.QUERIES[name](spark, f"{DATA}/sf0.01"))


def test_groups_over_batches(spark):
    """Groups that reach over the ends of batches are whole, structs as keys too."""
    rows = spark.range(5000).select((F.col("id") % 7).alias("a"), F.struct((F.col("id") % 3).alias("b")).alias("k"), "id")

    def add(part: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part["a"][0].as_py()]), pa.array([part["k"][0].as_py()["b"]]), pa.array([int(np.sum(part["id"].to_numpy()))])], names=["a", "b", "s"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        found = {(r.a, r.b): r.s for r in tiles.by_groups(rows, ["a", "k"], add, "a long, b long, s long").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {(a, b): sum(i for i in range(5000) if i % 7 == a and i % 3 == b) for a in range(7) for b in range(3)}


def test_votes_travel_side_by_side(spark):
    """one row for each line of each tile was shuffled; now one for each piece of a tile."""
    mask = tiles.from_pixels(adapters.plates(spark, f"{DATA}/sf0.001").withColumn("gray", F.when(F.col("gray") >= 240, 255).otherwise(0)), 32)
    votes = strokes.line_votes(mask)
    many = votes.where("votes > 6")
    assert strokes.line_votes(mask, 6).exceptAll(many).isEmpty() and many.exceptAll(strokes.line_votes(mask, 6)).isEmpty()


def test_lines_go_in_one_step(spark):
    """a mask less its lines equals the mask less its two openings, over tile borders and at image borders."""
    made = tiles.from_pixels(adapters.plates(spark, f"{DATA}/sf0.001").withColumn("gray", F.when(F.col("gray") > 60, 255).otherwise(0)), 16)
    key = ["image_id", "y", "x"]
    sides = [tiles.to_pixels(tiles.opened(made, h, w, 16)).withColumnRenamed("gray", n) for h, w, n in ((5, 1, "v"), (1, 5, "h"))]
    wanted = tiles.to_pixels(made).join(sides[0], key).join(sides[1], key).select(*key, F.greatest(F.col("gray") - F.col("v") - F.col("h"), F.lit(0)).alias("gray"))
    found = tiles.to_pixels(tiles.without_lines(made, 5, 16))
    assert wanted.exceptAll(found).isEmpty() and found.count() == wanted.count()
