"""Raster operators on pixel rows (image_id, y, x, ...), JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .regions import distances_at


def gray_of(b="b", g="g", r="r") -> Column:
    return F.floor(0.114 * F.col(b) + 0.587 * F.col(g) + 0.299 * F.col(r) + 0.5).cast("int")


def saturation() -> Column:
    return F.greatest("b", "g", "r") - F.least("b", "g", "r")


def trace_ink(pixels: DataFrame, width: int, height: int, label_skip: float, border: int = 2) -> DataFrame:
    """Bright pixels of low saturation, outside the label strip and the frame."""
    p = pixels.withColumn("gray", gray_of()).withColumn("sat", saturation())
    ink = ((F.col("gray") >= 135) & (F.col("sat") <= 75)) | ((F.col("gray") >= 115) & (F.col("sat") <= 30))
    inside = (F.col("x") >= max(int(label_skip * width), border)) & (F.col("x") < width - border)
    return p.where(ink & inside & (F.col("y") >= border) & (F.col("y") < height - border))


def coloured_grid(pixels: DataFrame) -> DataFrame:
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    return pixels.where(((r > 70) & (r > 1.3 * g) & (r > 1.3 * b)) | ((g > 45) & (g > 1.2 * r) & (g > 1.2 * b)))


def column_profile(mask: DataFrame, height: int) -> DataFrame:
    """Count, extent and fill of each column, and whether it looks like a separator line."""
    cols = mask.groupBy("image_id", "x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    span = F.col("bottom") - F.col("top") + 1
    cols = cols.withColumn("span", span).withColumn("fill", F.col("n") / F.greatest(F.col("span"), F.lit(1)))
    bad = (F.col("span") > 0.46 * height) & (F.col("n") > 0.28 * height) & (F.col("fill") > 0.55)
    return cols.withColumn("separator", bad)


def without_separators(mask: DataFrame, height: int) -> DataFrame:
    bad = column_profile(mask, height).where("separator").select("image_id", "x")
    return mask.join(bad, ["image_id", "x"], "left_anti")


def bounding_box(images: DataFrame, mask: DataFrame, width: int, height: int, pad: int) -> DataFrame:
    """Padded box of the true pixels; the whole image where there is none."""
    box = mask.groupBy("image_id").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    return images.join(box, "image_id", "left").select(
        "image_id", F.coalesce(F.greatest(F.col("x1") - pad, F.lit(0)), F.lit(0)).alias("x1"),
        F.coalesce(F.greatest(F.col("y1") - pad, F.lit(0)), F.lit(0)).alias("y1"),
        F.coalesce(F.least(F.col("x2") + 1 + pad, F.lit(width)), F.lit(width)).alias("x2"),
        F.coalesce(F.least(F.col("y2") + 1 + pad, F.lit(height)), F.lit(height)).alias("y2"),
    )


def weighted_centroid(mask: DataFrame, floor: int = 80) -> DataFrame:
    """Intensity-weighted row of each column; the plain mean where all weights are zero."""
    w = F.greatest(F.col("gray") - floor, F.lit(0))
    sums = mask.groupBy("image_id", "x").agg(F.sum(F.col("y") * w).alias("yw"), F.sum(w).alias("w"), F.avg("y").alias("mean"))
    return sums.select("image_id", "x", F.coalesce(F.col("yw") / F.nullif("w", F.lit(0)), F.col("mean")).alias("y"))


def gamma_curve(pixels: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Adaptive gamma map of each image: (image_id, gray, out) from its cumulative histogram."""
    bins = pixels.groupBy("image_id", "gray").count()
    upto = Window.partitionBy("image_id").orderBy("gray")
    cdf = F.sum("count").over(upto) / F.sum("count").over(Window.partitionBy("image_id"))
    gamma = F.least(F.greatest(1 - F.pow(cdf, F.lit(alpha)), F.lit(0.01)), F.lit(10.0))
    out = F.floor(F.round(255 * F.pow(F.col("gray") / 255.0, gamma), 6)).cast("int")
    return bins.select("image_id", "gray", out.alias("out"))


def otsu(pixels: DataFrame) -> DataFrame:
    """The threshold of the largest variance between classes (the least wins ties), and the mean."""
    return otsu_of(pixels.groupBy("image_id", "gray").count())


def otsu_of(bins: DataFrame) -> DataFrame:
    """The same of histograms (image_id, gray, count)."""
    upto, all_ = Window.partitionBy("image_id").orderBy("gray"), Window.partitionBy("image_id")
    s = F.col("gray") * F.col("count")
    bins = bins.select("image_id", "gray", F.sum("count").over(upto).alias("n0"), F.sum(s).over(upto).alias("s0"), F.sum("count").over(all_).alias("n"), F.sum(s).over(all_).alias("s"))
    n1, s1 = F.col("n") - F.col("n0"), F.col("s") - F.col("s0")
    gap = F.col("s0") / F.col("n0") - s1 / F.nullif(n1, F.lit(0))
    bins = bins.withColumn("between", F.round(F.coalesce(F.col("n0") * n1 * gap * gap, F.lit(0.0)), 4))
    return bins.groupBy("image_id").agg(F.max_by("gray", F.struct("between", -F.col("gray"))).alias("threshold"), F.first(F.col("s") / F.col("n")).alias("mean"))


def neighbours(mask: DataFrame, reach: int, width: int, height: int) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])
    moved = mask.select("image_id", "y", "x", F.explode(steps).alias("s"))
    moved = moved.select("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def dilate(mask: DataFrame, reach: int, width: int, height: int) -> DataFrame:
    return neighbours(mask, reach, width, height).distinct()


def erode(mask: DataFrame, reach: int, width: int, height: int) -> DataFrame:
    """True where all neighbours inside the image are true."""
    counts = neighbours(mask, reach, width, height).groupBy("image_id", "y", "x").count()
    side = lambda c, n: F.least(F.col(c) + reach, F.lit(n - 1)) - F.greatest(F.col(c) - reach, F.lit(0)) + 1
    return counts.where(F.col("count") == side("y", height) * side("x", width)).drop("count")


def overlap(trace: DataFrame, projected: DataFrame) -> DataFrame:
    """Dice, IoU and coverage (in %) of two masks."""
    a, b = trace.withColumn("a", F.lit(1)), projected.withColumn("b", F.lit(1))
    both = a.join(b, ["image_id", "y", "x"], "full_outer").groupBy("image_id").agg(
        F.count("a").alias("na"), F.count("b").alias("nb"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("hit"), F.count(F.lit(1)).alias("any")
    )
    one = F.lit(1)
    return both.select(
        "image_id", (2 * F.col("hit") / F.greatest(one, F.col("na") + F.col("nb"))).alias("dice"),
        (F.col("hit") / F.greatest(one, F.col("any"))).alias("iou"), (100 * F.col("hit") / F.greatest(one, F.col("na"))).alias("coverage_pct"),
    )


def hausdorff(trace: DataFrame, projected: DataFrame) -> DataFrame:
    go = distances_at(trace, projected).groupBy("image_id").agg(
        F.sqrt(F.avg(F.col("dist") * F.col("dist"))).alias("pixel_rmse"), F.avg("dist").alias("mean_distance"), F.max("dist").alias("max_deviation")
    )
    back = distances_at(projected, trace).groupBy("image_id").agg(F.max("dist").alias("back"))
    return go.join(back, "image_id").select("*", F.greatest("max_deviation", "back").alias("hausdorff")).drop("back")


def minmax(pixels: DataFrame) -> DataFrame:
    """Levels stretched to 0..255; a constant image becomes 0."""
    w = Window.partitionBy("image_id")
    lo, hi = F.min("gray").over(w), F.max("gray").over(w)
    return pixels.withColumn("gray", F.coalesce(F.floor((F.col("gray") - lo) * 255 / F.nullif(hi - lo, F.lit(0))), F.lit(0)).cast("int"))


def rotate(pixels: DataFrame, angle: int, width: int, height: int) -> DataFrame:
    """Rotation by 90, 180 or 270 degrees clockwise."""
    y, x = F.col("y"), F.col("x")
    new = {0: (y, x), 90: (x, height - 1 - y), 180: (height - 1 - y, width - 1 - x), 270: (width - 1 - x, y)}[angle]
    return pixels.withColumns({"y": new[0], "x": new[1]})


def crop(pixels: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    inside = (F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2)
    return pixels.where(inside).withColumns({"x": F.col("x") - x1, "y": F.col("y") - y1})


def mean_row_carried(mask: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, x, y): mean row of the ink of each column; an empty one takes the column before, zero at first."""
    means = mask.groupBy("image_id", "x").agg(F.avg("y").alias("y"))
    spine = images.select("image_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    w = Window.partitionBy("image_id").orderBy("x")
    return spine.join(means, ["image_id", "x"], "left").withColumn("y", F.coalesce(F.last("y", True).over(w), F.lit(0.0)))


def densest_row(mask: DataFrame, images: DataFrame, taps: int = 9) -> DataFrame:
    """(image_id, row): the row of most ink after a moving sum over taps; the first wins ties."""
    counts = mask.groupBy("image_id", "y").agg(F.count(F.lit(1)).alias("n"))
    spine = images.select("image_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    w = Window.partitionBy("image_id").orderBy("y").rowsBetween(-(taps // 2), taps // 2)
    sums = spine.join(counts, ["image_id", "y"], "left").withColumn("s", F.sum(F.coalesce("n", F.lit(0))).over(w))
    return sums.groupBy("image_id").agg(F.max_by("y", F.struct("s", -F.col("y"))).alias("row"))


def spike_tips(mask: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, x, y): tips of tall and sparse columns, the end farther from the densest row; ties go to the top."""
    cols = mask.groupBy("image_id", "x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    tall = cols.join(images, "image_id").where((F.col("bottom") - F.col("top") > 0.12 * F.col("height")) & (F.col("n") / (F.col("bottom") - F.col("top") + 1) < 0.55))
    own = tall.join(densest_row(mask, images), "image_id")
    return own.withColumn("y", F.when(F.abs(F.col("top") - F.col("row")) >= F.abs(F.col("bottom") - F.col("row")), F.col("top")).otherwise(F.col("bottom")))


def separator_columns(mask: DataFrame, edge: float = 0.18) -> DataFrame:
    """Columns of (image_id, width, height, y, x) with their count and whether they are separator lines.

    A line is long, dense and full; in the outer parts of the image less is enough.
    """
    cols = mask.groupBy("image_id", "width", "height", "x").agg(F.count(F.lit(1)).alias("n"), (F.max("y") - F.min("y") + 1).alias("span"))
    n, fill, h = F.col("n"), F.col("n") / F.col("span"), F.col("height")
    outer = (F.col("x") < F.floor(edge * F.col("width"))) | (F.col("x") >= F.col("width") - F.floor(edge * F.col("width")))
    line = (F.col("span") > 0.46 * h) & (n > 0.28 * h) & (fill > 0.55)
    return cols.withColumn("bad", line | (outer & (n > 0.18 * h) & (fill > 0.45)))


def before_after(before: DataFrame, after: DataFrame, least: int) -> DataFrame:
    """(image_id, diff, unchanged): summed difference of two versions of each image that both have."""
    b = after.select("image_id", "y", "x", F.col("gray").alias("other"))
    diff = before.join(b, ["image_id", "y", "x"]).groupBy("image_id").agg(F.sum(F.abs(F.col("gray") - F.col("other"))).alias("diff"))
    return diff.withColumn("unchanged", F.col("diff") < least)
