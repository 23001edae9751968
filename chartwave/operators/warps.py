"""Perspective and affine maps of images on tiles, each image by its own map and to its own size.

A map is nine numbers m that take an output pixel (x, y) to the input's
((m0 x + m1 y + m2) / w, (m3 x + m4 y + m5) / w) with w = m6 x + m7 y + m8.  Each output tile
asks for the input tiles that the rectangle around its preimage meets, and gets only their
parts inside it.  A line stays a line, so four corners bound the preimage; where w changes
its sign within a tile it has no bound and the tile asks for the whole image.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import SIZE, batch_of, by_groups, packed, schema_of


def turned(images: DataFrame) -> DataFrame:
    """Maps (image_id, m, out_w, out_h) that turn images (image_id, width, height, angle in degrees) about their middle, counter-clockwise."""
    a = F.radians("angle")
    cx, cy = F.expr("width div 2"), F.expr("height div 2")
    c, s = F.cos(a), F.sin(a)
    zero = F.lit(0.0)
    m = F.array(c, -s, cx - c * cx + s * cy, s, c, cy - s * cx - c * cy, zero, zero, F.lit(1.0))
    return images.select("image_id", m.alias("m"), F.col("width").alias("out_w"), F.col("height").alias("out_h"))


def solve(quad: list[tuple[float, float]], w: float, h: float) -> list[float]:
    """The map of a rectangle of w x h pixels onto the quad (top left, top right, bottom right, bottom left)."""
    rows, right = [], []
    for (x, y), (u, v) in zip([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], quad):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)[0].tolist(), 1.0]


def straightened(quads: DataFrame) -> DataFrame:
    """Maps that make the quads (image_id, corners as (x, y) from the top left, clockwise) rectangles.

    A rectangle is as wide and as high as the longer of the quad's opposite sides, in whole pixels.
    """
    p = lambda i, c: F.col("corners")[i][c]
    side = lambda i, j: F.sqrt(F.pow(p(i, "x") - p(j, "x"), 2) + F.pow(p(i, "y") - p(j, "y"), 2))
    # A hair, so that sides of whole pixels are not cut by the root's last digit.
    w, h = (F.greatest(F.floor(F.greatest(*s) + 1e-9).cast("int"), F.lit(1)) for s in ((side(2, 3), side(1, 0)), (side(1, 2), side(0, 3))))

    @F.pandas_udf("array<double>")
    def maps(corners: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([solve([(q["x"], q["y"]) for q in c], *s) for c, *s in zip(corners, w, h)])

    sized = quads.select("image_id", "corners", w.alias("out_w"), h.alias("out_h"))
    return sized.select("image_id", maps("corners", "out_w", "out_h").alias("m"), "out_w", "out_h")


def spots(m: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input y, input x, w) of output pixels."""
    w = m[6] * xs + m[7] * ys + m[8]
    safe = np.where(w == 0, np.nan, w)
    return (m[3] * xs + m[4] * ys + m[5]) / safe, (m[0] * xs + m[1] * ys + m[2]) / safe, w


def asked(m: np.ndarray, oy: int, ox: int, h: int, w: int, height: int, width: int, repeat: bool) -> tuple[int, int, int, int] | None:
    """(top, bottom, left, right), inclusive, of the input that an output tile needs; None if nothing of it is inside."""
    sy, sx, sign = spots(m, np.array([oy, oy, oy + h - 1, oy + h - 1.0]), np.array([ox, ox + w - 1, ox, ox + w - 1.0]))
    if not (np.isfinite(sy).all() and ((sign > 0).all() or (sign < 0).all())):
        return 0, height - 1, 0, width - 1
    box = math.floor(sy.min()), math.floor(sy.max()) + 1, math.floor(sx.min()), math.floor(sx.max()) + 1
    if not repeat and (box[0] >= height or box[1] < 0 or box[2] >= width or box[3] < 0):
        return None
    return tuple(int(min(max(v, 0), n - 1)) for v, n in zip(box, (height, height, width, width)))


def beside(at: np.ndarray, n: int, low: int, count: int, repeat: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index, share) of the pixels before and after places on an axis of n pixels, of which `count` from `low` on are held."""
    at = np.clip(at, -9, n + 9)
    first = np.floor(at)
    share = at - first
    out = []
    for pixel, part in ((first.astype(np.int64), 1 - share), (first.astype(np.int64) + 1, share)):
        out.append((np.clip(pixel, low, low + count - 1) - low, part if repeat else np.where((pixel >= 0) & (pixel < n), part, 0.0)))
    return out


def warp(tiles: DataFrame, maps: DataFrame, repeat: bool = True, tile: int = SIZE) -> DataFrame:
    """Tiles, of any number of planes, of the images that have a map, bilinear; outside the image its border repeats, else it is black.

    maps: (image_id, m, out_w, out_h).  Images without a map have no tile.  Where a map has no
    point (w = 0) the pixel is black.
    """
    kind = dict(tiles.dtypes)["image_id"]
    sized = tiles.groupBy("image_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.max("h").alias("side"), F.max("w").alias("across"))
    jobs = maps.select("image_id", "m", F.col("out_w").cast("int"), F.col("out_h").cast("int")).join(sized, "image_id")
    ask = "m array<double>, out_w int, out_h int, width int, height int, oy int, ox int, top int, bottom int, left int, right int, ty int, tx int"

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m, rows = np.array(r["m"]), []
                for oy in range(0, r["out_h"], tile):
                    for ox in range(0, r["out_w"], tile):
                        box = asked(m, oy, ox, min(tile, r["out_h"] - oy), min(tile, r["out_w"] - ox), r["height"], r["width"], repeat)
                        top, bottom, left, right = box or (0, 0, 0, 0)
                        for ty in range(top // r["side"], bottom // r["side"] + 1):
                            for tx in range(left // r["across"], right // r["across"] + 1):
                                rows.append((oy, ox, top, bottom, left, right, ty * r["side"], tx * r["across"]))
                n = len(rows)
                fixed = [pa.array([r["image_id"]] * n, batch.schema.field(0).type), pa.array([r["m"]] * n, pa.list_(pa.float64()))]
                fixed += [pa.array([r[c]] * n, pa.int32()) for c in ("out_w", "out_h", "width", "height")]
                own = [pa.array([x[k] for x in rows], pa.int32()) for k in range(8)]
                yield pa.RecordBatch.from_arrays([*fixed, *own], names=["image_id", *(c.split()[0] for c in ask.split(", "))])

    asks = jobs.select("image_id", "m", "out_w", "out_h", "width", "height", "side", "across").mapInArrow(lambda batches: packed(needs(batches)), f"image_id {kind}, {ask}")
    source = tiles.select("image_id", F.col("y0").alias("ty"), F.col("x0").alias("tx"), "h", "w", "px")
    # The pixels are neither broadcast nor sorted: what is asked is few bytes.
    met = source.join(asks.hint("shuffle_hash"), ["image_id", "ty", "tx"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            ty, tx, h, w = (batch.column(names.index(c)).to_pylist() for c in ("ty", "tx", "h", "w"))
            bounds = [batch.column(names.index(c)).to_pylist() for c in ("top", "bottom", "left", "right")]
            made = []
            for y0, x0, rows, columns, px, top, bottom, left, right in zip(ty, tx, h, w, batch.column(names.index("px")).to_pylist(), *bounds):
                grid, planes = np.frombuffer(px, dtype=np.uint8).reshape(rows, -1), len(px) // (rows * columns)
                made.append(grid[max(0, top - y0) : bottom + 1 - y0, max(0, left - x0) * planes : max(0, right + 1 - x0) * planes].tobytes())
            kept = [batch.column(names.index(c)) for c in order[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.binary())], names=order)

    order = ["image_id", *(c.split()[0] for c in ask.split(", ")), "h", "w", "px"]
    cut = met.select(*order).mapInArrow(part, f"image_id {kind}, {ask}, h int, w int, px binary")

    def build(parts: pa.Table) -> pa.RecordBatch:
        rows = parts.to_pylist()
        first = rows[0]
        oy, ox, width, height, out_w, out_h = (first[c] for c in ("oy", "ox", "width", "height", "out_w", "out_h"))
        h, w = min(tile, out_h - oy), min(tile, out_w - ox)
        top, left = first["top"], first["left"]
        whole = None
        for r in rows:
            y, x = max(r["ty"], top), max(r["tx"], left)
            n_y, n_x = min(r["ty"] + r["h"], first["bottom"] + 1) - y, min(r["tx"] + r["w"], first["right"] + 1) - x
            grid = np.frombuffer(r["px"], dtype=np.uint8).reshape(n_y, n_x, -1)
            if whole is None:
                whole = np.zeros((first["bottom"] + 1 - top, first["right"] + 1 - left, grid.shape[2]), dtype=np.uint8)
            whole[y - top : y - top + n_y, x - left : x - left + n_x] = grid
        sy, sx, _ = spots(np.array(first["m"]), np.arange(oy, oy + h)[:, None], np.arange(ox, ox + w)[None, :])
        real = np.isfinite(sy) & np.isfinite(sx)
        rows, columns = (beside(np.where(real, s, -9), n, low, count, repeat) for s, n, low, count in ((sy, height, top, whole.shape[0]), (sx, width, left, whole.shape[1])))
        planes, out = np.ascontiguousarray(whole.reshape(-1, whole.shape[2]).T), [np.zeros((h, w)) for _ in range(whole.shape[2])]
        for y, fy in rows:
            for x, fx in columns:
                place, share = y * whole.shape[1] + x, fy * fx
                for plane, sums in zip(planes, out):
                    sums += share * plane[place]
        made = np.stack([np.where(real, np.floor(np.round(sums, 6) + 0.5), 0) for sums in out], axis=-1).astype(np.uint8)
        return batch_of([first["image_id"]], [(out_w, out_h, oy, ox, h, w)], [made.tobytes()], parts.schema.field("image_id").type)

    return by_groups(cut, ["image_id", "oy", "ox"], build, schema_of(tiles))


def cropped(boxes: DataFrame) -> DataFrame:
    """Maps that cut images to their boxes (image_id, x1, y1, x2, y2), the last two exclusive."""
    one, zero = F.lit(1.0), F.lit(0.0)
    m = F.array(one, zero, F.col("x1").cast("double"), zero, one, F.col("y1").cast("double"), zero, zero, one)
    return boxes.where("x2 > x1 AND y2 > y1").select("image_id", m.alias("m"), (F.col("x2") - F.col("x1")).alias("out_w"), (F.col("y2") - F.col("y1")).alias("out_h"))
