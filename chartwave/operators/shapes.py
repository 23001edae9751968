"""Boxes, quads and image sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yolo_box(xa: str, ya: str, xb: str, yb: str, width: str, height: str) -> dict[str, Column]:
    """Centre and size, by the image's size, of the box with two given corners."""
    x1, x2 = F.least(xa, xb), F.greatest(xa, xb)
    y1, y2 = F.least(ya, yb), F.greatest(ya, yb)
    w, h = F.col(width), F.col(height)
    return {"xc": (x1 + x2) / 2 / w, "yc": (y1 + y2) / 2 / h, "w": (x2 - x1) / w, "h": (y2 - y1) / h}


def yolo_line(cls: int = 0) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", F.lit(cls), "xc", "yc", "w", "h")


def pixel_box(width: str, height: str) -> dict[str, Column]:
    """Corners in pixels of centre and size, cut towards zero at each step."""
    cx, cy = (F.col("xc") * F.col(width)).cast("int"), (F.col("yc") * F.col(height)).cast("int")
    bw, bh = (F.col("w") * F.col(width)).cast("int"), (F.col("h") * F.col(height)).cast("int")
    return {
        "px1": (cx - bw / 2.0).cast("int"), "py1": (cy - bh / 2.0).cast("int"),
        "px2": (cx + bw / 2.0).cast("int"), "py2": (cy + bh / 2.0).cast("int"),
    }


def order_points(points: DataFrame) -> DataFrame:
    """Corners of each quad, one row: tl, tr, br, bl as structs (x, y, i); the first point wins ties."""
    at = F.struct("x", "y", "i")
    total, diff = F.col("x") + F.col("y"), F.col("y") - F.col("x")
    low = lambda key: F.min_by(at, F.struct(key, F.col("i")))
    high = lambda key: F.max_by(at, F.struct(key, -F.col("i")))
    return points.groupBy("shape_id").agg(low(total).alias("tl"), low(diff).alias("tr"), high(total).alias("br"), high(diff).alias("bl"))


CORNERS = ("tl", "tr", "br", "bl")


def angle_deviation() -> Column:
    """Mean distance of the four inner angles from 90 degrees."""
    out = F.lit(0.0)
    for i in range(4):
        p, q, r = (CORNERS[(i + k) % 4] for k in range(3))
        ax, ay = F.col(f"{p}.x") - F.col(f"{q}.x"), F.col(f"{p}.y") - F.col(f"{q}.y")
        bx, by = F.col(f"{r}.x") - F.col(f"{q}.x"), F.col(f"{r}.y") - F.col(f"{q}.y")
        cosine = (ax * bx + ay * by) / (F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by) + 1e-6)
        out = out + F.abs(F.degrees(F.acos(cosine)) - 90)
    return out / 4


def quad_area() -> Column:
    total = F.lit(0.0)
    for p, q in zip(CORNERS, (*CORNERS[1:], CORNERS[0])):
        total = total + F.col(f"{p}.x") * F.col(f"{q}.y") - F.col(f"{q}.x") * F.col(f"{p}.y")
    return F.abs(total) / 2


def ladder(*steps: tuple[Column, int], otherwise: int) -> Column:
    out = None
    for test, value in steps:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def corner_score(exact: Column, width: float, height: float, margin: float = 20) -> Column:
    """Points for shape, angles, spread, area and distance from the border of an ordered quad."""
    dev, area = angle_deviation(), quad_area() / (width * height)
    xs, ys = [F.col(f"{c}.x") for c in CORNERS], [F.col(f"{c}.y") for c in CORNERS]
    sx, sy = (F.greatest(*xs) - F.least(*xs)) / width, (F.greatest(*ys) - F.least(*ys)) / height
    border = sum(((x < margin) | (x > width - margin) | (y < margin) | (y > height - margin)).cast("int") for x, y in zip(xs, ys))
    return (
        F.when(exact, 150).otherwise(50)
        + ladder((dev < 15, 120), (dev < 25, 90), (dev < 40, 50), otherwise=10)
        + ladder(((sx > 0.6) & (sy > 0.5), 80), ((sx > 0.4) & (sy > 0.3), 50), ((sx > 0.25) & (sy > 0.2), 20), otherwise=0)
        + ladder((area.between(0.3, 0.75), 40), (area.between(0.15, 0.85), 30), (area.between(0.03, 0.95), 20), otherwise=5)
        + ladder((border == 4, -150), (border <= 2, 30), otherwise=0)
    )


def upscale_totals(images: DataFrame, factor: float, *by: str) -> DataFrame:
    """Images, pixels before and after scaling, and the increase in %, with a total row."""
    new = (F.col("width") * factor).cast("long") * (F.col("height") * factor).cast("long")
    old = F.col("width").cast("long") * F.col("height").cast("long")
    sums = images.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(old).alias("pixels"), F.sum(new).alias("pixels_after"))
    return sums.withColumn("increase_pct", 100.0 * (F.col("pixels_after") - F.col("pixels")) / F.nullif("pixels", F.lit(0)))


def pixel_count(width: str, height: str) -> dict[str, Column]:
    pixels = F.col(width) * F.col(height)
    return {"pixels": pixels, "megapixels": F.bround(pixels / 1e6, 2)}


def screen_size(width: str, height: str, most_width: float, most_height: float) -> dict[str, Column]:
    """Size scaled down to fit a screen, never up."""
    scale = F.least(most_width / F.col(width), most_height / F.col(height), F.lit(1.0))
    return {"fw": (F.col(width) * scale).cast("long"), "fh": (F.col(height) * scale).cast("long")}
