"""Connected components and exact distances of masks of any size, on tiles.

A mask is a table of tiles (see operators.tiles) whose px is 0 outside and anything else
inside; its tiles must cover each image.  Components are labelled inside each tile by joining
runs; only the pixels at tile borders are then compared with their neighbours in other tiles,
and the links found there join the labels.  No task holds a whole image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import mask_components, merge, spread
from ..plans.store import dropped, stored
from .tiles import batch_of, by_groups, packed, schema_of

#: Border links of an image that one task joins; images with more go through rounds of joins.
LINKS = 1 << 20
#: Pixels of a strip or band that one task holds in a distance transform.
AREA = 1 << 20
#: Squared distance where there is no pixel inside.
NONE = np.int64(1) << 40


def grids(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(image_id, width, height, y0, x0, array) of each tile."""
    for i, width, height, y0, x0, h, w, px in zip(*[c.to_pylist() for c in batch.columns[:8]]):
        yield i, width, height, y0, x0, np.frombuffer(px, dtype=np.uint8).reshape(h, w)


def local_seeds(on: np.ndarray, width: int, y0: int, x0: int) -> tuple[tuple, np.ndarray]:
    """The runs of a tile's mask and their component's seed: its first pixel's place y * width + x in the image."""
    runs, first = mask_components(on)
    return runs, (y0 + runs[0][first]).astype(np.int64) * width + x0 + runs[1][first]


def split(mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tiles that are whole images, which exchange nothing, and the others; both read the mask, which is better written before."""
    one = (F.col("h") == F.col("height")) & (F.col("w") == F.col("width"))
    return mask.where(one), mask.where(~one)


def tile_regions(mask: DataFrame) -> DataFrame:
    """(image_id, seed, area, y1, x1, y2, x2) of each component inside its tile; bounds are inclusive."""
    kind = dict(mask.dtypes)["image_id"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, width, _, y0, x0, grid in grids(batch):
                (row, start, stop), seed = local_seeds(grid != 0, width, y0, x0)
                own, at = np.unique(seed, return_inverse=True)
                area = np.bincount(at, weights=stop - start, minlength=len(own)).astype(np.int64)
                bounds = [np.full(len(own), v) for v in (1 << 31, 1 << 31, -1, -1)]
                for pick, out, value in ((np.minimum, 0, y0 + row), (np.minimum, 1, x0 + start), (np.maximum, 2, y0 + row), (np.maximum, 3, x0 + stop - 1)):
                    pick.at(bounds[out], at, value)
                columns = [pa.array(own), pa.array(area), *(pa.array(b.astype(np.int32)) for b in bounds)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), batch.schema.field(0).type), *columns], names=["image_id", "seed", "area", "y1", "x1", "y2", "x2"])

    return mask.mapInArrow(lambda batches: packed(label(batches)), f"image_id {kind}, seed long, area long, y1 int, x1 int, y2 int, x2 int")


def border_links(mask: DataFrame) -> DataFrame:
    """(image_id, a, b): seeds of components of different tiles that touch, also at a corner."""
    kind = dict(mask.dtypes)["image_id"]

    def rims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, width, height, y0, x0, grid in grids(batch):
                (row, start, stop), seed = local_seeds(grid != 0, width, y0, x0)
                h, w = grid.shape
                at, x = spread(start, stop)
                y = row[at]
                rim = (y == 0) | (y == h - 1) | (x == 0) | (x == w - 1)
                y, x, own = y[rim] + y0, x[rim] + x0, seed[at[rim]]
                # A pixel asks for the neighbours below it and to its right that lie in another tile.
                asks = [(y, x, own, False)]
                for dy, dx in ((1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)):
                    v, u = y + dy, x + dx
                    out = ((v < y0) | (v >= y0 + h) | (u < x0) | (u >= x0 + w)) & (v >= 0) & (v < height) & (u >= 0) & (u < width)
                    asks.append((v[out], u[out], own[out], True))
                place, s = (np.concatenate(c) for c in ([v.astype(np.int64) * width + u for v, u, *_ in asks], [a[2] for a in asks]))
                asked = np.repeat([a[3] for a in asks], [len(a[0]) for a in asks])
                columns = [pa.array([i] * len(s), batch.schema.field(0).type), pa.array(place), pa.array(s), pa.array(asked)]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "place", "seed", "asked"])

    rim = stored(mask.mapInArrow(lambda batches: packed(rims(batches)), f"image_id {kind}, place long, seed long, asked boolean"))
    asks = rim.where("asked").select("image_id", "place", F.col("seed").alias("a"))
    holds = rim.where("NOT asked").select("image_id", "place", F.col("seed").alias("b"))
    links = stored(asks.join(holds, ["image_id", "place"]).select("image_id", "a", "b").distinct())
    dropped(rim)
    return links


def joined_seeds(links: DataFrame) -> DataFrame:
    """(image_id, seed, label): the smallest seed that each linked seed is joined with; unlinked ones are absent; written."""
    kind = dict(links.dtypes)["image_id"]
    most = links.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0
    if most <= LINKS:

        def join(part: pa.Table) -> pa.RecordBatch:
            own, at = np.unique(np.concatenate([part["a"].to_numpy(), part["b"].to_numpy()]), return_inverse=True)
            label = np.arange(len(own))
            merge(label, at[: part.num_rows], at[part.num_rows :])
            ids = pa.array([part["image_id"][0].as_py()] * len(own), part.schema.field("image_id").type)
            return pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(own[label])], names=["image_id", "seed", "label"])

        return stored(by_groups(links, ["image_id"], join, f"image_id {kind}, seed long, label long"))
    # Each round every seed takes the smallest label next to it, and then that label's own label.
    both = stored(links.union(links.select("image_id", "b", "a")).toDF("image_id", "seed", "near").distinct())
    labels = stored(both.select("image_id", "seed", F.col("seed").alias("label")).distinct())
    while True:
        near = both.join(labels.select("image_id", F.col("seed").alias("near"), F.col("label").alias("low")), ["image_id", "near"])
        low = near.groupBy("image_id", "seed").agg(F.min("low").alias("low"))
        once = stored(labels.join(low, ["image_id", "seed"]).select("image_id", "seed", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("moved")))
        head = once.select("image_id", F.col("seed").alias("label"), F.col("label").alias("short"))
        after = stored(once.join(head, ["image_id", "label"]).select("image_id", "seed", F.least("label", "short").alias("label"), "moved"))
        moved = not after.where("moved").isEmpty()
        dropped(labels, once)
        labels = after.drop("moved")
        if not moved:
            dropped(both)
            return labels


def regions(mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, parts), both written: 8-neighbour components, and the parts of them inside tiles.

    components: (image_id, label, area, y1, x1, y2, x2), label being the place y * width + x of the
    component's first pixel and bounds inclusive.  parts: (image_id, seed, label, area).  An image
    without a pixel inside has no row; repeated image ids are one image.
    """
    links = border_links(mask)
    names = joined_seeds(links)
    own = stored(tile_regions(mask).join(names, ["image_id", "seed"], "left").withColumn("label", F.coalesce("label", "seed")))
    sums = own.groupBy("image_id", "label").agg(
        F.sum("area").alias("area"), F.min("y1").alias("y1"), F.min("x1").alias("x1"), F.max("y2").alias("y2"), F.max("x2").alias("x2")
    )
    whole = stored(sums)
    dropped(links, names)
    return whole, own.select("image_id", "seed", "label", "area")


def keep_regions(mask: DataFrame, chosen: DataFrame, parts: DataFrame) -> DataFrame:
    """The mask (255 inside) with only the chosen components (image_id, label)."""
    seeds = parts.join(chosen.select("image_id", "label").distinct(), ["image_id", "label"], "left_semi")
    sized = mask.groupBy("image_id").agg(F.first("width").alias("width"), F.max("h").alias("side"), F.max("w").alias("across"))
    # A part lies in the tile of its seed.
    placed = seeds.join(sized, "image_id").select(
        "image_id", "seed", F.expr("CAST(seed div width div side * side AS INT)").alias("y0"), F.expr("CAST(seed % width div across * across AS INT)").alias("x0")
    )
    kept = placed.groupBy("image_id", "y0", "x0").agg(F.collect_list("seed").alias("seeds"))
    names = ["image_id", "width", "height", "y0", "x0", "h", "w", "px"]
    rows = mask.join(kept.hint("merge"), ["image_id", "y0", "x0"], "left").select(*names, "seeds")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (i, width, height, y0, x0, grid) in enumerate(grids(batch)):
                out = np.zeros(grid.shape, dtype=np.uint8)
                if batch.column(8)[k].is_valid:
                    (row, start, stop), seed = local_seeds(grid != 0, width, y0, x0)
                    stays = np.isin(seed, batch.column(8)[k].values.to_numpy(zero_copy_only=False))
                    at, x = spread(start[stays], stop[stays])
                    out[row[stays][at], x] = 255
                yield batch_of([i], [(width, height, y0, x0, *grid.shape)], [out.tobytes()], batch.schema.field(0).type)

    return rows.mapInArrow(lambda batches: packed(keep(batches)), schema_of(mask))


def without_small(mask: DataFrame, least: int = 50) -> DataFrame:
    """The mask without components of fewer than `least` pixels."""
    whole, parts = regions(mask)
    return keep_regions(mask, whole.where(F.col("area") >= least), parts)


def row_minima(g: np.ndarray) -> np.ndarray:
    """min over u of (x - u)^2 + g[row, u] for every row and x.

    The best u never falls as x grows, so the middle x of each stretch splits its candidates: every
    level halves the stretches and looks at each candidate about once.
    """
    rows, width = g.shape
    out = np.empty((rows, width), dtype=np.int64)
    low, high = np.zeros((rows, 1), dtype=np.int64), np.full((rows, 1), width - 1, dtype=np.int64)
    first, last = np.array([0]), np.array([width])  # stretches of x, the same in every row
    flat = g.ravel()
    while len(first):
        mid = (first + last) // 2
        base = np.arange(rows)[:, None] * width
        item, u = spread((low + base).ravel(), (high + base).ravel() + 1)
        x = np.broadcast_to(mid, low.shape).ravel()[item]
        value = (x - u % width) ** 2 + flat[u]
        starts = np.r_[0, np.cumsum((high - low + 1).ravel())[:-1]]
        best = np.minimum.reduceat(value, starts)
        out[:, mid] = best.reshape(low.shape)
        # The first candidate that reaches the best value.
        hit = np.flatnonzero(value == best[item])
        chosen = (u[hit[np.searchsorted(hit, starts)]] % width).reshape(low.shape)
        stretches = [(first, mid, low, chosen), (mid + 1, last, chosen, high)]
        kept = [(a[s], b[s], lo[:, s], hi[:, s]) for a, b, lo, hi in stretches for s in [a < b]]
        first, last = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
        low, high = (np.concatenate([k[i] for k in kept], axis=1) for i in (2, 3))
    return out


def column_distances(on: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest pixel inside along each column."""
    height = on.shape[0]
    y = np.arange(height)[:, None]
    far = 1 << 20
    above = np.maximum.accumulate(np.where(on, y, -far), axis=0)
    below = np.minimum.accumulate(np.where(on, y, far)[::-1], axis=0)[::-1]
    gap = np.minimum(y - above, below - y).astype(np.int64)
    return np.where(gap >= far - height, NONE, gap * gap)


def squared_distances(mask: DataFrame) -> DataFrame:
    """Exact squared distance of every pixel to the nearest one inside: bands (image_id, width, height, y0, h, d2).

    d2 holds h whole rows as 64-bit numbers, NONE (2^40) or more where the image has no pixel
    inside.  First columns, in strips as high as the image, then rows, in bands as wide; a strip
    or band has AREA pixels, or one column or row if that is more.  Images up to 2^20 on a side.
    """
    kind = dict(mask.dtypes)["image_id"]

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, width, height, y0, x0, grid in grids(batch):
                across = max(1, AREA // height)
                boxes, data, to = [], [], []
                for strip in range(x0 // across, (x0 + grid.shape[1] - 1) // across + 1):
                    left = max(x0, strip * across)
                    part = grid[:, left - x0 : (strip + 1) * across - x0]
                    boxes.append((width, height, y0, left, *part.shape))
                    data.append(np.packbits(part != 0).tobytes())
                    to.append(strip)
                made = batch_of([i] * len(to), boxes, data, batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([*made.columns, pa.array(to, pa.int32())], names=[*made.schema.names, "strip"])

    def columns(parts: pa.Table) -> pa.RecordBatch:
        rows = parts.to_pylist()
        width, height, strip = (rows[0][c] for c in ("width", "height", "strip"))
        across = max(1, AREA // height)
        left = strip * across
        on = np.zeros((height, min(across, width - left)), dtype=bool)
        for r in rows:
            bits = np.unpackbits(np.frombuffer(r["px"], dtype=np.uint8), count=r["h"] * r["w"]).reshape(r["h"], r["w"])
            on[r["y0"] : r["y0"] + r["h"], r["x0"] - left : r["x0"] - left + r["w"]] = bits
        g = column_distances(on)
        deep = max(1, AREA // width)
        tops = range(0, height, deep)
        return batch_of([rows[0]["image_id"]] * len(tops), [(width, height, y, left, *g[y : y + deep].shape) for y in tops], [g[y : y + deep].tobytes() for y in tops], parts.schema.field("image_id").type)

    def across(parts: pa.Table) -> pa.RecordBatch:
        rows = parts.to_pylist()
        width, height, y0, h = (rows[0][c] for c in ("width", "height", "y0", "h"))
        g = np.empty((h, width), dtype=np.int64)
        for r in rows:
            g[:, r["x0"] : r["x0"] + r["w"]] = np.frombuffer(r["px"], dtype=np.int64).reshape(h, -1)
        data = row_minima(g).tobytes()
        fixed = [pa.array([v], pa.int32()) for v in (width, height, y0, h)]
        return pa.RecordBatch.from_arrays([pa.array([rows[0]["image_id"]], parts.schema.field("image_id").type), *fixed, pa.array([data], pa.binary())], names=["image_id", "width", "height", "y0", "h", "d2"])

    dealt = mask.mapInArrow(lambda batches: packed(strips(batches)), f"{schema_of(mask)}, strip int")
    bands = by_groups(dealt, ["image_id", "strip"], columns, schema_of(mask))
    return by_groups(bands, ["image_id", "y0"], across, f"image_id {kind}, width int, height int, y0 int, h int, d2 binary")


def mask_tiles(pixels: DataFrame, images: DataFrame, tile: int = 512) -> DataFrame:
    """Tiles that cover each image (image_id, width, height), 255 at the given pixels (image_id, y, x)."""
    kind = dict(images.dtypes)["image_id"]
    every = images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"))
    for axis, size in (("y0", "height"), ("x0", "width")):
        every = every.withColumn(axis, F.explode(F.expr(f"sequence(0, {size} - 1, {tile})")))
    at = F.expr(f"(y % {tile}) * {tile} + x % {tile}").cast("int")
    own = pixels.select("image_id", F.expr(f"CAST(y div {tile} * {tile} AS INT)").alias("y0"), F.expr(f"CAST(x div {tile} * {tile} AS INT)").alias("x0"), at.alias("at"))
    held = own.groupBy("image_id", "y0", "x0").agg(F.collect_list("at").alias("at"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (i, width, height, y0, x0) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:5]])):
                grid = np.zeros((min(tile, height - y0), min(tile, width - x0)), dtype=np.uint8)
                if batch.column(5)[k].is_valid:
                    y, x = np.divmod(batch.column(5)[k].values.to_numpy(zero_copy_only=False), tile)
                    grid[y, x] = 255
                yield batch_of([i], [(width, height, y0, x0, *grid.shape)], [grid.tobytes()], batch.schema.field(0).type)

    # No side is broadcast: Spark takes rows made from a small table for small too.
    rows = every.join(held.hint("merge"), ["image_id", "y0", "x0"], "left").select("image_id", "width", "height", "y0", "x0", "at")
    return rows.mapInArrow(lambda batches: packed(fill(batches)), f"image_id {kind}, width int, height int, y0 int, x0 int, h int, w int, px binary")


def distances_at(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, y, x, dist) for each pixel (image_id, y, x) of a: how far the nearest pixel of b in the image is.

    Images without a pixel of b have no row.
    """
    kind = dict(a.dtypes)["image_id"]
    sizes = a.select("image_id", "y", "x").union(b.select("image_id", "y", "x")).groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    bands = squared_distances(mask_tiles(b, sizes.hint("merge").join(b.select("image_id").distinct(), "image_id", "left_semi")))
    deep = F.greatest(F.lit(1), F.expr(f"{AREA} div width"))
    own = a.select("image_id", F.col("y").cast("int"), F.col("x").cast("int")).join(sizes.hint("shuffle_hash"), "image_id")
    held = own.withColumn("y0", (F.floor(F.col("y") / deep) * deep).cast("int")).groupBy("image_id", "y0").agg(F.collect_list(F.struct("y", "x")).alias("at"))
    rows = bands.hint("merge").join(held, ["image_id", "y0"]).select("image_id", "width", "y0", "d2", F.col("at.y").alias("ys"), F.col("at.x").alias("xs"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                width, y0 = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                d2 = np.frombuffer(batch.column(3)[k].as_py(), dtype=np.int64)
                y, x = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (4, 5))
                ids = pa.array([batch.column(0)[k].as_py()] * len(y), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(y), pa.array(x), pa.array(np.sqrt(d2[(y - y0) * width + x].astype(np.float64)))], names=["image_id", "y", "x", "dist"])

    return rows.mapInArrow(lambda batches: packed(look(batches)), f"image_id {kind}, y int, x int, dist double")
