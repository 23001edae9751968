"""Ordered outlines of masks on tiles: closed rings along pixel sides, outer ones and holes.

Between a pixel inside and one outside lies a side, directed so that the inside is on its right.
Each tile gives the sides of its own pixels, knowing one pixel around it, and joins those in
a row to one step.  Steps of an image are chained end to start: a ring's signed area is then
exactly the number of pixels it encloses, positive for outer rings and negative for holes, so
the sum over a component is its area.  Rings are as many rows as they have corners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regions
from .edges import simplified
from .tiles import SIZE, around, by_groups, packed

#: Directions of steps: right, down, left, up, as (dy, dx).
STEPS = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])


def chained(y: np.ndarray, x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    """The closed rings of unit sides, each as its corners (x, y) in order from its first corner in reading order."""
    return [ring for _, ring in rings_of(y, x, d)]


def rings_of(y: np.ndarray, x: np.ndarray, d: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The same, each with the place of its first side.

    Where two rings touch at a corner a ring turns left, so pixels that touch there belong to one ring.
    """
    width = int(x.max()) + 2
    start = y * width + x
    end = (y + STEPS[d, 0]) * width + x + STEPS[d, 1]
    order = np.lexsort((d, start))
    first, last = np.searchsorted(start[order], end, "left"), np.searchsorted(start[order], end, "right")
    # One side starts where this one ends, or two: then the left turn, (d + 3) mod 4.
    after = order[first]
    double = last - first == 2
    other = order[np.minimum(first + 1, len(order) - 1)]
    after = np.where(double & (d[other] == (d + 3) % 4), other, after)
    seen, rings = np.zeros(len(d), dtype=bool), []
    nexts = after.tolist()
    for k in order.tolist():
        if not seen[k]:
            ring, at = [], k
            while not seen[at]:
                seen[at] = True
                ring.append(at)
                at = nexts[at]
            ring = np.array(ring)
            turns = ring[d[ring] != d[np.roll(ring, 1)]]
            rings.append((k, np.stack([x[turns], y[turns]], axis=1)))
    return rings


def ring_area(ring: np.ndarray) -> int:
    """Signed area: positive where the ring runs clockwise on the screen."""
    x, y = ring[:, 0].astype(np.int64), ring[:, 1].astype(np.int64)
    return int((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) // 2


def outlines(mask: DataFrame, tile: int = SIZE) -> DataFrame:
    """(image_id, label, ring, hole, area, length, corners) of every 8-neighbour component.

    label names the component as regions.regions does.  Ring 0 is its outer outline, the others are
    its holes, in reading order; area is what a ring encloses in pixels, length its sides, corners
    the (x, y) where it turns.  A task holds the sides of one component, or of several of an image,
    never their pixels: components are dealt to one piece for each 2^21 pixels of their image.
    """
    kind = dict(mask.dtypes)["image_id"]
    _, parts = regions.regions(mask)
    names = ["image_id", "width", "height", "y0", "x0", "h", "w", "px"]
    # Each pixel's tile also tells which of its four neighbours are inside.
    weights = {(-1, 0): 1, (0, 1): 2, (1, 0): 4, (0, -1): 8}

    def near(grid: np.ndarray) -> np.ndarray:
        on = np.nan_to_num(grid) > 0
        h, w = on.shape[0] - 2, on.shape[1] - 2
        bits = sum(v * on[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for (dy, dx), v in weights.items())
        return np.where(on[1:-1, 1:-1], 16 + bits, 0).astype(float)

    marked = around(mask.select(*names), 1, 1, 1, 1, "none", near, tile)

    def own_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, width, height, y0, x0, grid in regions.grids(batch):
                (row, start, stop), seed = regions.local_seeds(grid != 0, width, y0, x0)
                at, column = regions.spread(start, stop)
                y, x, s, bits = row[at], column, seed[at], grid[row[at], column]
                found = []
                for d, (open_, (oy, ox)) in enumerate(zip((1, 2, 4, 8), ((0, 0), (0, 1), (1, 1), (1, 0)))):
                    edge = bits & open_ == 0
                    found.append((s[edge], y[edge] + oy + y0, x[edge] + ox + x0, np.full(int(edge.sum()), d)))
                columns = [np.concatenate([f[k] for f in found]) for k in range(4)]
                columns.append(np.full(len(columns[0]), 1 + (width * height >> 21)))
                kinds = (pa.int64(), *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(columns[0]), batch.schema.field(0).type), *(pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds))], names=["image_id", "seed", "y", "x", "d", "pieces"])

    steps = marked.mapInArrow(lambda batches: packed(own_sides(batches)), f"image_id {kind}, seed long, y int, x int, d int, pieces int").join(parts.select("image_id", "seed", "label").hint("merge"), ["image_id", "seed"])
    steps = steps.withColumn("piece", F.pmod(F.xxhash64("label"), F.col("pieces")))

    def follow(part: pa.Table) -> pa.RecordBatch:
        labels = part["label"].to_numpy()
        # Components of one image have no corner in common, so their sides are chained together.
        found = rings_of(*(part[c].to_numpy().astype(np.int64) for c in ("y", "x", "d")))
        rings = [(int(labels[k]), ring_area(r), r) for k, r in found]
        order = sorted(range(len(rings)), key=lambda k: (rings[k][0], rings[k][1] < 0, k))
        own, area, held = zip(*[rings[k] for k in order])
        place = np.arange(len(own)) - np.searchsorted(own, own, "left")
        length = [int(np.abs(np.diff(r, axis=0, append=r[:1])).sum()) for r in held]
        corners = np.concatenate(held).astype(np.int32)
        points = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(corners) + 1, 2, dtype=np.int32)), pa.array(corners.ravel()))
        ends = np.r_[0, np.cumsum([len(r) for r in held])].astype(np.int32)
        columns = [pa.array(own, pa.int64()), pa.array(place.astype(np.int32)), pa.array(np.array(area) < 0), pa.array(np.abs(area).astype(np.int64)), pa.array(length, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), points)]
        return pa.RecordBatch.from_arrays([pa.repeat(part["image_id"][0], len(own)), *columns], names=["image_id", "label", "ring", "hole", "area", "length", "corners"])

    schema = f"image_id {kind}, label long, ring int, hole boolean, area long, length long, corners array<array<int>>"
    return by_groups(steps.select("image_id", "piece", "label", "y", "x", "d"), ["image_id", "piece"], follow, schema)


def polygons(rings: DataFrame, share: float = 0.02) -> DataFrame:
    """The rings with `polygon`: the corners left when none may lie further than a share of the ring's length from its side."""
    names = rings.columns

    def simplify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [simplified(np.array(c, dtype=float), share * n).astype(int).tolist() for c, n in zip(batch.column(names.index("corners")).to_pylist(), batch.column(names.index("length")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.list_(pa.int32())))], names=[*names, "polygon"])

    schema = ", ".join(f"{c} {t}" for c, t in rings.dtypes)
    return rings.mapInArrow(simplify, f"{schema}, polygon array<array<int>>")
