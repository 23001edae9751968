"""Raster filters on tiles, for tables of images of any and of different sizes.

A tile is a row (image_id, width, height, y0, x0, h, w, px): a rectangle of a gray image as
bytes, row by row; width and height are the whole image's.  A filter sends each tile only to
the output tiles that need some of it, cut to what they need; there the parts are put
together, with the border filled in where the image ends, and one numpy step makes the
output tile.  So a shuffle carries pixels about once, and no task holds a whole image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import gaussian

SIZE = 512
NAMES = ["width", "height", "y0", "x0", "h", "w"]


def schema_of(df: DataFrame) -> str:
    return f"image_id {dict(df.dtypes)['image_id']}, width int, height int, y0 int, x0 int, h int, w int, px binary"


def batch_of(ids: list, boxes: list[tuple], data: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([b[i] for b in boxes], pa.int32()) for i in range(6)]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns, pa.array(data, pa.binary())], names=["image_id", *NAMES, "px"])


#: Bytes and rows after which rows made in a task are handed over as one batch.
HELD_BYTES, HELD_ROWS = 4 << 20, 1 << 16


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of HELD_BYTES or HELD_ROWS: a tile's own rows are too few for a batch."""
    held, size, rows = [], 0, 0
    for batch in batches:
        held.append(batch)
        size, rows = size + batch.nbytes, rows + batch.num_rows
        if size >= HELD_BYTES or rows >= HELD_ROWS:
            yield pa.concat_batches(held)
            held, size, rows = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The frame dealt out by key for a step in Python.

    A number of partitions is named, as tiles and what is found in them are few bytes and much work: left to itself Spark puts them all into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """work(rows of a group) for each group of keys: like applyInArrow, for very many small groups.

    The rows come sorted in batches of many groups, and results leave in batches too.  A task
    holds one batch and one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in (p for c in own for p in (c.flatten() if pa.types.is_struct(c.type) else [c])):
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                key = tuple(c[a].as_py() for c in own) if a == 0 else None
                if open_ and not (a == 0 and key == last):
                    yield work(pa.Table.from_batches(open_))
                    open_ = []
                open_.append(batch.slice(a, b - a))
            last = tuple(c[-1].as_py() for c in own)
        if open_:
            yield work(pa.Table.from_batches(open_))

    return spread(df, *keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: packed(run(batches)), schema)


def from_images(images: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of whole images (image_id, width, height, px): gray bytes, row by row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, width, height, px in zip(*[c.to_pylist() for c in batch.columns]):
                grid = np.frombuffer(px, dtype=np.uint8).reshape(height, width)
                for y in range(0, height, size):
                    for x in range(0, width, size):
                        part = grid[y : y + size, x : x + size]
                        yield batch_of([i], [(width, height, y, x, *part.shape)], [part.tobytes()], batch.schema.field(0).type)

    narrow = images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), F.col("px").cast("binary"))
    return narrow.mapInArrow(cut, schema_of(images))


def gray_images(spark, path: str) -> DataFrame:
    """(image_id, width, height, px) of a folder's three-channel images, gray; one numpy step for each image."""
    from ..sources.readers import SUFFIXES

    read = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", SUFFIXES).load(path)
    rows = read.select("image.*").where("nChannels = 3").select(F.col("origin").alias("image_id"), "width", "height", "data")

    def gray(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.frombuffer(d, dtype=np.uint8).reshape(-1, 3) @ np.array([0.114, 0.587, 0.299]) for d in batch.column(3).to_pylist()]
            px = pa.array([np.floor(g + 0.5).astype(np.uint8).tobytes() for g in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], px], names=["image_id", "width", "height", "px"])

    return rows.mapInArrow(gray, "image_id string, width int, height int, px binary")


def from_pixels(pixels: DataFrame, tile: int = SIZE) -> DataFrame:
    """Tiles of dense pixel rows (image_id, width, height, y, x, gray)."""
    size = F.lit(tile)
    rows = pixels.select(
        "image_id", F.col("width").cast("int"), F.col("height").cast("int"), (F.floor(F.col("y") / size) * size).cast("int").alias("y0"),
        (F.floor(F.col("x") / size) * size).cast("int").alias("x0"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("gray").cast("int"),
    )

    at = ((F.col("y") - F.col("y0")).cast("long") * size + F.col("x") - F.col("x0")) * 256 + F.col("gray").bitwiseAND(F.lit(255))
    held = rows.groupBy("image_id", "width", "height", "y0", "x0").agg(F.collect_list(at.cast("int" if tile <= 2048 else "long")).alias("at"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy(zero_copy_only=False)
            ids, boxes, data = [], [], []
            for k, (i, width, height, y0, x0) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:5]])):
                grid = np.zeros((min(tile, height - y0), min(tile, width - x0)), dtype=np.uint8)
                spot, gray = np.divmod(flat[ends[k] : ends[k + 1]], 256)
                grid[spot // tile, spot % tile] = gray
                ids.append(i)
                boxes.append((width, height, y0, x0, *grid.shape))
                data.append(grid.tobytes())
            yield batch_of(ids, boxes, data, batch.schema.field(0).type)

    return held.mapInArrow(fill, schema_of(pixels))


def retiled(made: DataFrame, size: int) -> DataFrame:
    """The same images, of any number of planes, in tiles of `size`: many small tiles of an image cost more than a few large ones.

    A tile goes to each of those that it meets; `cut` suits tiles that are much larger than `size`.
    """
    meets = {f"o{a}": F.explode(F.expr(f"sequence(CAST({a}0 div {size} * {size} AS INT), {a}0 + {side} - 1, {size})")) for a, side in (("y", "h"), ("x", "w"))}
    dealt = made.select("image_id", *NAMES, "px")
    for name, places in meets.items():
        dealt = dealt.withColumn(name, places)

    def build(parts: pa.Table) -> pa.RecordBatch:
        rows = parts.to_pylist()
        width, height, oy, ox = (rows[0][c] for c in ("width", "height", "oy", "ox"))
        h, w, planes = min(size, height - oy), min(size, width - ox), len(rows[0]["px"]) // (rows[0]["h"] * rows[0]["w"])
        # Rows of bytes, as copying between arrays of three axes takes long.
        whole = np.zeros((h, w * planes), dtype=np.uint8)
        for r in rows:
            top, left = max(oy, r["y0"]), max(ox, r["x0"])
            bottom, right = min(oy + h, r["y0"] + r["h"]), min(ox + w, r["x0"] + r["w"])
            grid = np.frombuffer(r["px"], dtype=np.uint8).reshape(r["h"], r["w"] * planes)
            whole[top - oy : bottom - oy, (left - ox) * planes : (right - ox) * planes] = grid[top - r["y0"] : bottom - r["y0"], (left - r["x0"]) * planes : (right - r["x0"]) * planes]
        return batch_of([rows[0]["image_id"]], [(width, height, oy, ox, h, w)], [whole.tobytes()], parts.schema.field(0).type)

    return by_groups(dealt, ["image_id", "oy", "ox"], build, schema_of(made))


def cut(made: DataFrame, size: int) -> DataFrame:
    """The same images, of any number of planes, cut where tiles of `size` end: into those, if the tiles' sides are multiples of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, width, height, y0, x0, h, w, px in zip(*[c.to_pylist() for c in batch.columns]):
                grid, planes, boxes, data = np.frombuffer(px, dtype=np.uint8).reshape(h, -1), len(px) // (h * w), [], []
                for oy in range(y0 // size * size, y0 + h, size):
                    for ox in range(x0 // size * size, x0 + w, size):
                        top, left, right = max(oy, y0), max(ox, x0), min(ox + size, x0 + w)
                        part = grid[top - y0 : oy + size - y0, (left - x0) * planes : (right - x0) * planes]
                        boxes.append((width, height, top, left, len(part), right - left))
                        data.append(part.tobytes())
                yield batch_of([i] * len(data), boxes, data, batch.schema.field(0).type)

    return made.select("image_id", *NAMES, "px").mapInArrow(lambda batches: packed(run(batches)), schema_of(made))


def mapped(made: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Tiles of the same places whose pixels are work(pixels as an array (h, w, 3))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            px = [work(np.frombuffer(p, dtype=np.uint8).reshape(*s, 3)).astype(np.uint8).tobytes() for p, *s in zip(batch.column(7).to_pylist(), h, w)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(px, pa.binary())], names=batch.schema.names[:8])

    return made.select("image_id", *NAMES, "px").mapInArrow(run, schema_of(made))


def to_pixels(tiles: DataFrame) -> DataFrame:
    """Pixel rows (image_id, y, x, gray)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, _, y0, x0, h, w, px in zip(*[c.to_pylist() for c in batch.columns]):
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), w)
                gray = np.frombuffer(px, dtype=np.uint8).astype(np.int32)
                ids = pa.array([i] * len(y), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(y + y0, pa.int32()), pa.array(x + x0, pa.int32()), pa.array(gray)], names=["image_id", "y", "x", "gray"])

    return tiles.mapInArrow(lambda batches: packed(spread(batches)), f"image_id {dict(tiles.dtypes)['image_id']}, y int, x int, gray int")


def bounds(tiles: DataFrame) -> DataFrame:
    """(image_id, x1, y1, x2, y2): the box, bounds inclusive, around the pixels above zero of each tile that has any."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k, (y0, x0, h, w, px) in enumerate(zip(*[c.to_pylist() for c in batch.columns[3:8]])):
                grid = np.frombuffer(px, dtype=np.uint8).reshape(h, w)
                y, x = np.flatnonzero(grid.any(axis=1)), np.flatnonzero(grid.any(axis=0))
                if len(y):
                    at.append(k)
                    found.append([int(v) for v in (x[0] + x0, y[0] + y0, x[-1] + x0, y[-1] + y0)])
            columns = [pa.array([f[k] for f in found], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=["image_id", "x1", "y1", "x2", "y2"])

    return tiles.select("image_id", *NAMES, "px").mapInArrow(look, f"image_id {dict(tiles.dtypes)['image_id']}, x1 int, y1 int, x2 int, y2 int")


#: Index outside an image, by border rule: repeated edge, mirror without the edge, or none (-1).
BORDERS = {
    "repeat": lambda at, n: np.clip(at, 0, n - 1),
    "mirror": lambda at, n: np.zeros_like(at) if n == 1 else (n - 1) - np.abs((n - 1) - at % (2 * n - 2)),
}


def gather(tiles: DataFrame, needs: Callable, out_size: Callable, work: Callable, tile: int = SIZE) -> DataFrame:
    """Output tiles made from the parts of the input tiles that each needs.

    out_size(width, height) gives the output's size; needs(start, count, n) the first and last
    input index, along one axis of n pixels, for output pixels from start on, which may lie
    outside the image; work(patch(rows, columns), y0, x0, h, w, width, height) the tile, where
    patch gives the input at index arrays inside the image.  tile is the side of output tiles.
    """

    def spans(start: int, count: int, n: int) -> tuple[int, int]:
        low, high = needs(start, count, n)
        return max(0, min(low, n - 1)), max(0, min(high, n - 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}

        def strips(n_out: int, n: int) -> list[tuple[int, int, int]]:
            if (n_out, n) not in known:
                if len(known) > 4096:
                    known.clear()
                known[n_out, n] = [(o, *spans(o, min(tile, n_out - o), n)) for o in range(0, n_out, tile)]
            return known[n_out, n]

        for batch in batches:
            for i, width, height, y0, x0, h, w, px in zip(*[c.to_pylist() for c in batch.columns]):
                grid = np.frombuffer(px, dtype=np.uint8).reshape(h, w)
                ow, oh = out_size(width, height)
                ids, boxes, data, to = [], [], [], []
                across = [s for s in strips(ow, width) if s[1] < x0 + w and s[2] >= x0]
                for oy, top, bottom in (s for s in strips(oh, height) if s[1] < y0 + h and s[2] >= y0):
                    for ox, left, right in across:
                        part = grid[max(0, top - y0) : bottom + 1 - y0, max(0, left - x0) : right + 1 - x0]
                        ids.append(i)
                        boxes.append((width, height, max(y0, top), max(x0, left), *part.shape))
                        data.append(part.tobytes())
                        to.append((oy, ox))
                made = batch_of(ids, boxes, data, batch.schema.field(0).type)
                places = [pa.array([t[k] for t in to], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*made.columns, *places], names=[*made.schema.names, "oy", "ox"])

    def build(parts: pa.Table) -> pa.RecordBatch:
        rows = parts.to_pylist()
        width, height, oy, ox = (rows[0][c] for c in ("width", "height", "oy", "ox"))
        ow, oh = out_size(width, height)
        h, w = min(tile, oh - oy), min(tile, ow - ox)
        (top, bottom), (left, right) = spans(oy, h, height), spans(ox, w, width)
        whole = np.zeros((bottom + 1 - top, right + 1 - left), dtype=np.uint8)
        for r in rows:
            whole[r["y0"] - top : r["y0"] - top + r["h"], r["x0"] - left : r["x0"] - left + r["w"]] = np.frombuffer(r["px"], dtype=np.uint8).reshape(r["h"], r["w"])
        out = work(lambda ys, xs: whole[ys - top][:, xs - left], oy, ox, h, w, width, height)
        data = (out if out.dtype == np.uint8 else np.clip(np.rint(out), 0, 255).astype(np.uint8)).tobytes()
        return batch_of([rows[0]["image_id"]], [(ow, oh, oy, ox, h, w)], [data], parts.schema.field(0).type)

    schema = schema_of(tiles)
    dealt = tiles.mapInArrow(lambda batches: packed(deal(batches)), f"{schema}, oy int, ox int")
    return by_groups(dealt, ["image_id", "oy", "ox"], build, schema)


def around(tiles: DataFrame, up: int, left: int, down: int, right: int, border: str, work: Callable, tile: int = SIZE) -> DataFrame:
    """A filter that sees so many pixels around each; work(padded float array, its offset into the tile's rows and columns known) gives the tile.

    The mirror border needs pixels from as far inside as it reaches outside.
    """
    reach = max(up, left, down, right)

    def step(patch, y0, x0, h, w, width, height):
        ys, xs = np.arange(y0 - up, y0 + h + down), np.arange(x0 - left, x0 + w + right)
        if border == "none":
            inside = ((ys >= 0) & (ys < height))[:, None] & ((xs >= 0) & (xs < width))[None, :]
            return work(np.where(inside, patch(np.clip(ys, 0, height - 1), np.clip(xs, 0, width - 1)).astype(np.float64), np.nan))
        rule = BORDERS[border]
        return work(patch(rule(ys, height), rule(xs, width)).astype(np.float64))

    def needs(start: int, count: int, n: int) -> tuple[int, int]:
        low, high = start - reach, start + count - 1 + reach
        return (min(low, 2 * (n - 1) - high), max(high, -low)) if border == "mirror" else (low, high)

    return gather(tiles, needs, lambda w, h: (w, h), step, tile)


def blurred(grid: np.ndarray, kernel: list[float]) -> np.ndarray:
    """Separable correlation of a padded array."""
    n = len(kernel)
    rows = sum(k * grid[i : grid.shape[0] - n + 1 + i] for i, k in enumerate(kernel))
    return sum(k * rows[:, i : rows.shape[1] - n + 1 + i] for i, k in enumerate(kernel))


def blur(tiles: DataFrame, size: int, sigma: float = 0.0, tile: int = SIZE) -> DataFrame:
    kernel = gaussian(size, sigma)
    return around(tiles, *[size // 2] * 4, "mirror", lambda g: blurred(g, kernel), tile)


def adaptive_threshold(tiles: DataFrame, size: int, offset: float, tile: int = SIZE) -> DataFrame:
    """255 where a pixel is brighter than the Gaussian mean around it less the offset, else 0."""
    kernel, r = gaussian(size), size // 2
    return around(tiles, r, r, r, r, "repeat", lambda g: 255.0 * (g[r : g.shape[0] - r, r : g.shape[1] - r] > np.rint(blurred(g, kernel)) - offset), tile)


def median_blur(tiles: DataFrame, size: int, tile: int = SIZE) -> DataFrame:
    def median(grid: np.ndarray) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(grid.astype(np.uint8), (size, size))
        # Some rows at a time; the middle of an odd number of levels is one of them.
        step, half = max(1, (1 << 20) // (windows.shape[1] * size * size)), size * size // 2
        parts = [windows[k : k + step].reshape(-1, windows.shape[1], size * size) for k in range(0, len(windows), step)]
        if size % 2:
            return np.concatenate([np.partition(p, half, axis=2)[..., half] for p in parts])
        return np.concatenate([np.median(p, axis=2) for p in parts])

    return around(tiles, *[size // 2] * 4, "repeat", median, tile)


def extreme(grid: np.ndarray, n: int, pick: np.ufunc, axis: int) -> np.ndarray:
    """The extreme of every n values in a row along an axis, of twice as many at each step."""
    grid, known = grid if axis == 0 else grid.T, 1
    while known < n:
        more = min(known, n - known)
        grid = pick(grid[: len(grid) - more], grid[more:])
        known += more
    return grid if axis == 0 else grid.T


def morphed(tiles: DataFrame, steps: list[tuple[str, int, int]], tile: int = SIZE) -> DataFrame:
    """Dilations ("max") and erosions ("min") by rectangles, one after another: steps of (pick, height, width).

    Outside the image there is no value.  A tile sees as far as all steps together reach, so tiles exchange their borders once.
    """

    def sides(pick: str, height: int, width: int) -> tuple[int, int, int, int]:
        up, left = height // 2, width // 2
        if pick == "max":  # the dilation's rectangle is mirrored, as an opening must not move anything
            up, left = height - 1 - up, width - 1 - left
        return up, left, height - 1 - up, width - 1 - left

    reaches = [sides(*s) for s in steps]
    up, left, down, right = (sum(r[k] for r in reaches) for k in range(4))
    most = max(up, left, down, right)

    def work(patch, y0, x0, h, w, width, height):
        ys, xs = np.arange(y0 - up, y0 + h + down), np.arange(x0 - left, x0 + w + right)
        grid = patch(np.clip(ys, 0, height - 1), np.clip(xs, 0, width - 1))
        for (pick, n, m), (a, b, c, d) in zip(steps, reaches):
            none = 0 if pick == "max" else 255
            grid[(ys < 0) | (ys >= height)] = none
            grid[:, (xs < 0) | (xs >= width)] = none
            choose = np.maximum if pick == "max" else np.minimum
            grid = np.ascontiguousarray(extreme(extreme(grid, n, choose, 0), m, choose, 1))
            ys, xs = ys[a : len(ys) - c], xs[b : len(xs) - d]
        return grid

    return gather(tiles, lambda start, count, n: (start - most, start + count - 1 + most), lambda w, h: (w, h), work, tile)


def rank(tiles: DataFrame, height: int, width: int, pick: str, tile: int = SIZE) -> DataFrame:
    """Largest ("max": dilation) or smallest ("min": erosion) value of a rectangle; outside the image there is none."""
    return morphed(tiles, [(pick, height, width)], tile)


def dilate(tiles: DataFrame, height: int, width: int, tile: int = SIZE) -> DataFrame:
    return rank(tiles, height, width, "max", tile)


def erode(tiles: DataFrame, height: int, width: int, tile: int = SIZE) -> DataFrame:
    return rank(tiles, height, width, "min", tile)


def opened(tiles: DataFrame, height: int, width: int, tile: int = SIZE) -> DataFrame:
    return morphed(tiles, [("min", height, width), ("max", height, width)], tile)


def closed(tiles: DataFrame, height: int, width: int, tile: int = SIZE) -> DataFrame:
    return morphed(tiles, [("max", height, width), ("min", height, width)], tile)


def smoothed(tiles: DataFrame, close: int, open_: int, tile: int = SIZE) -> DataFrame:
    """The tiles closed by one square and then opened by another."""
    return morphed(tiles, [("max", close, close), ("min", close, close), ("min", open_, open_), ("max", open_, open_)], tile)


def without_lines(tiles: DataFrame, length: int, tile: int = SIZE) -> DataFrame:
    """The tiles less their openings by upright and by level lines of that length, 0 at least, made where the pixels lie."""
    reach = length - 1
    up = length // 2

    def run(pick: Callable, grid: np.ndarray) -> np.ndarray:
        out = grid[: grid.shape[0] - reach]
        for i in range(1, length):
            out = pick(out, grid[i : grid.shape[0] - reach + i])
        return out

    def left(grid: np.ndarray) -> np.ndarray:
        own = grid[reach : grid.shape[0] - reach, reach : grid.shape[1] - reach]
        out = own
        for g, turn in ((grid[:, reach : grid.shape[1] - reach], False), (grid[reach : grid.shape[0] - reach].T, True)):
            # An erosion tells nothing of places outside the image.
            low = run(np.fmin, g)
            low = np.where(np.isnan(g[up : up + len(low)]), np.nan, low)
            line = run(np.fmax, low)
            out = out - (line.T if turn else line)
        return np.maximum(out, 0)

    return around(tiles, *[reach] * 4, "none", left, tile)


def cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1, np.where(t < 2, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a, 0.0))


def lanczos4(t: np.ndarray) -> np.ndarray:
    return np.where(np.abs(t) < 4, np.sinc(t) * np.sinc(t / 4), 0.0)


KERNELS = {"bilinear": (1, lambda t: np.maximum(1 - np.abs(t), 0.0)), "bicubic": (2, cubic), "lanczos4": (4, lanczos4)}


def resize(tiles: DataFrame, factor: float, kind: str = "bicubic", tile: int = SIZE) -> DataFrame:
    """Images scaled by a factor; pixel centres map to pixel centres, borders repeat."""
    reach, weight = KERNELS[kind]

    def taps(start: int, count: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        spot = (np.arange(start, start + count) + 0.5) / factor - 0.5
        at = np.floor(spot)[:, None] + np.arange(1 - reach, reach + 1)
        w = weight(spot[:, None] - at)
        return np.clip(at, 0, n - 1).astype(np.int64), w / w.sum(axis=1, keepdims=True)

    def needs(start: int, count: int, n: int) -> tuple[int, int]:
        at = matrix(start, count, n)[0]
        return int(at[0]), int(at[-1])

    known = {}

    def matrix(start: int, count: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(input indices, weights of each for each output index): a band, but small enough to multiply whole."""
        if (start, count, n) not in known:
            if sum(m.size for _, m in known.values()) > 1 << 21:
                known.clear()
            known[start, count, n] = made_matrix(start, count, n)
        return known[start, count, n]

    def made_matrix(start: int, count: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at, w = taps(start, count, n)
        low = at.min()
        out = np.zeros((count, at.max() + 1 - low))
        np.add.at(out, (np.arange(count)[:, None], at - low), w)
        return np.arange(low, at.max() + 1), out

    def work(patch, y0, x0, h, w, width, height):
        (ys, wy), (xs, wx) = matrix(y0, h, height), matrix(x0, w, width)
        return (wy @ patch(ys, xs).astype(np.float64)) @ wx.T

    return gather(tiles, needs, lambda w, h: (int(w * factor), int(h * factor)), work, tile)
