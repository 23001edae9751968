"""Neighbourhood filters and geometry on pixel rows: each output pixel joins the input pixels it needs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import mask_components, spread


def gaussian(size: int, sigma: float = 0.0) -> list[float]:
    """One-dimensional kernel; without sigma the usual choice for the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(k) for x in k]


def convolve(pixels: DataFrame, kernel: list[float], axis: str, n: int, value: str = "gray") -> DataFrame:
    """One-dimensional convolution along x or y of a dense image of n pixels that way."""
    half, other = len(kernel) // 2, "x" if axis == "y" else "y"
    taps = F.explode(F.array(*[F.struct(F.lit(i - half).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(kernel)]))
    spread = pixels.select("image_id", other, F.col(axis).alias("from"), F.col(value).alias("g"), taps.alias("t"))
    # Each pixel sends its weight to those that see it, mirrored copies of it included.
    places = F.array(F.col("from"), -F.col("from"), 2 * (n - 1) - F.col("from"))
    sent = spread.select("image_id", other, "g", "t", F.explode(F.array_distinct(places)).alias("at")).withColumn(axis, F.col("at") - F.col("t.d"))
    inside = sent.where((F.col(axis) >= 0) & (F.col(axis) < n))
    return inside.groupBy("image_id", "y", "x").agg(F.sum(F.col("g") * F.col("t.w")).alias(value))


def blur(pixels: DataFrame, size: int, width: int, height: int, sigma: float = 0.0) -> DataFrame:
    """Gaussian blur, separable; the kernel must not be wider than the image."""
    k = gaussian(size, sigma)
    return convolve(convolve(pixels, k, "x", width), k, "y", height)


def adaptive_threshold(pixels: DataFrame, size: int, offset: float, width: int, height: int) -> DataFrame:
    """Pixels brighter than the Gaussian mean around them less the offset."""
    mean = blur(pixels, size, width, height).withColumnRenamed("gray", "mean")
    return pixels.join(mean, ["image_id", "y", "x"]).where(F.col("gray") > F.rint("mean") - offset).drop("mean")


def cubic(t: Column, a: float = -0.75) -> Column:
    t = F.abs(t)
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    return F.when(t <= 1, near).when(t < 2, far).otherwise(F.lit(0.0))


def lanczos4(t: Column) -> Column:
    x = t * math.pi
    return F.when(F.abs(t) < 1e-9, F.lit(1.0)).when(F.abs(t) >= 4, F.lit(0.0)).otherwise(4 * F.sin(x) * F.sin(x / 4) / F.nullif(x * x, F.lit(0.0)))


def linear(t: Column) -> Column:
    return F.greatest(1 - F.abs(t), F.lit(0.0))


KERNELS = {"bilinear": (1, linear), "bicubic": (2, cubic), "lanczos4": (4, lanczos4)}


def sample(pixels: DataFrame, spots: DataFrame, kind: str, width: int, height: int) -> DataFrame:
    """Values of images at fractional spots (image_id, y, x, sy, sx); borders repeat."""
    reach, weight = KERNELS[kind]
    near = F.sequence(F.lit(1 - reach), F.lit(reach))
    taps = spots.withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near))
    taps = taps.withColumn("v", F.floor("sy") + F.col("dy")).withColumn("u", F.floor("sx") + F.col("dx"))
    w = weight(F.col("sy") - F.col("v")) * weight(F.col("sx") - F.col("u"))
    clamp = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 1)).cast("int")
    taps = taps.select("image_id", "y", "x", w.alias("w"), clamp("v", height).alias("v"), clamp("u", width).alias("u"))
    source = pixels.select("image_id", F.col("y").alias("v"), F.col("x").alias("u"), "gray")
    sums = taps.join(source, ["image_id", "v", "u"]).groupBy("image_id", "y", "x").agg((F.sum(F.col("w") * F.col("gray")) / F.sum("w")).alias("gray"))
    return sums.withColumn("gray", F.least(F.greatest(F.rint("gray"), F.lit(0.0)), F.lit(255.0)).cast("int"))


def spine(images: DataFrame, width: int, height: int) -> DataFrame:
    ys, xs = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (height, width))
    return images.select("image_id").withColumn("y", ys).withColumn("x", xs)


def sized_tiles(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Tiles of dense pixel rows (image_id, y, x, gray) of images of one size."""
    from .tiles import from_pixels

    return from_pixels(pixels.withColumns({"width": F.lit(width), "height": F.lit(height)}))


def resize(pixels: DataFrame, width: int, height: int, factor: float, kind: str = "bicubic") -> DataFrame:
    """Dense images scaled by a factor; pixel centres map to pixel centres.

    Joining each output pixel to the input pixels it needs would make sixteen rows of one, so this goes through tiles.
    """
    from . import tiles

    return tiles.to_pixels(tiles.resize(sized_tiles(pixels, width, height), factor, kind))


def homography(corners: list[tuple[float, float]], width: int, height: int) -> list[float]:
    """The nine numbers that map output pixels to the quad tl, tr, br, bl of the input."""
    to = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    rows, right = [], []
    for (x, y), (u, v) in zip(to, corners):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)[0].tolist(), 1.0]


def warp(pixels: DataFrame, quads: DataFrame, size: tuple[int, int], out_size: tuple[int, int]) -> DataFrame:
    """Images straightened: quads has (image_id, corners array of (x, y) from the top left, clockwise)."""
    (width, height), (w, h) = size, out_size

    @F.pandas_udf("array<double>")
    def solve(corners: pd.Series) -> pd.Series:
        return pd.Series([homography([tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in c], w, h) for c in corners])

    m = quads.select("image_id", solve("corners").alias("m"))
    at = lambda i: F.col("m")[i] * F.col("x") + F.col("m")[i + 1] * F.col("y") + F.col("m")[i + 2]
    spots = spine(quads, w, h).join(m, "image_id")
    spots = spots.select("image_id", "y", "x", (at(3) / at(6)).alias("sy"), (at(0) / at(6)).alias("sx"))
    inside = (F.col("sy") >= -0.5) & (F.col("sy") < height - 0.5) & (F.col("sx") >= -0.5) & (F.col("sx") < width - 0.5)
    return sample(pixels, spots.where(inside), "bilinear", width, height)


def hough_votes(edges: DataFrame, degrees: int = 180) -> DataFrame:
    """Votes (image_id, theta, rho) of edge pixels for the lines through them."""
    theta = F.explode(F.sequence(F.lit(0), F.lit(degrees - 1))).alias("theta")
    p = edges.select("image_id", "y", "x", theta)
    rho = F.rint(F.col("x") * F.cos(F.radians("theta")) + F.col("y") * F.sin(F.radians("theta"))).cast("int")
    return p.groupBy("image_id", "theta", rho.alias("rho")).agg(F.count(F.lit(1)).alias("votes"))


def labelled(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, label) of the pixels of one image in reading order; label is the place of the first pixel of the 8-neighbour component among them."""
    y, x = part["y"].to_numpy(), part["x"].to_numpy()
    on = np.zeros((np.ptp(y) + 1, np.ptp(x) + 1), dtype=bool)
    on[y - y.min(), x - x.min()] = True
    (row, start, stop), first = mask_components(on)
    run, column = spread(start, stop)
    begin = np.cumsum(stop - start) - (stop - start)
    return row[run] + y.min(), column + x.min(), begin[first][run]


def component_areas(mask: DataFrame) -> DataFrame:
    """(image_id, y, x, label, area) of 8-neighbour components; one image is one group, its own size the bound."""
    from .tiles import by_groups

    def label(part: pa.Table) -> pa.RecordBatch:
        y, x, own = labelled(part)
        columns = [y.astype(np.int32), x.astype(np.int32), own.astype(np.int32), np.bincount(own)[own]]
        return pa.RecordBatch.from_arrays([pa.repeat(part["image_id"][0], len(y)), *(pa.array(c) for c in columns)], names=["image_id", "y", "x", "label", "area"])

    kind = dict(mask.dtypes)["image_id"]
    rows = mask.select("image_id", F.col("y").cast("int"), F.col("x").cast("int"))
    return by_groups(rows, ["image_id"], label, f"image_id {kind}, y int, x int, label int, area long")
