"""Contrast-limited adaptive equalisation on tiles, each image with cells of its own size.

An image is cut into `cells` x `cells` cells (beyond its border they are filled with mirrored
pixels).  Tiles count the levels of their own pixels by cell, the counts of an image are one
small row, and each tile then blends the curves of the cells around each pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import grids
from .tiles import BORDERS, NAMES, batch_of, packed, schema_of


def cell_share(start: int, count: int, n: int, cells: int) -> np.ndarray:
    """(cells, count): how often each pixel from start on counts in each cell along one axis of n pixels."""
    size = -(-n // cells)
    places = np.arange(size * cells)
    source = BORDERS["mirror"](places, n) - start
    out = np.zeros((cells, count))
    own = (source >= 0) & (source < count)
    np.add.at(out, (places[own] // size, source[own]), 1)
    return out


def curves_of(counts: np.ndarray, clip: float) -> np.ndarray:
    """The level that each level becomes in each cell (cells, 256): running counts after what exceeds the limit is dealt out evenly."""
    area = counts.sum(axis=1, keepdims=True)
    kept = np.minimum(counts, np.maximum(1, (clip * area / 256).astype(np.int64)))
    excess = (counts - kept).sum(axis=1, keepdims=True)
    rest = excess % 256
    step = np.maximum(1, 256 // np.maximum(rest, 1))
    gray = np.arange(256)
    kept = kept + excess // 256 + ((gray % step == 0) & (gray // step < rest))
    return np.minimum(np.rint(np.cumsum(kept, axis=1) * (255.0 / np.maximum(1, area))), 255)


def blend(start: int, count: int, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower cell, upper cell, share of the upper) of each pixel, by the distance to the cells' middles."""
    place = np.arange(start, start + count) / -(-n // cells) - 0.5
    low = np.floor(place).astype(int)
    return np.clip(low, 0, cells - 1), np.clip(low + 1, 0, cells - 1), place - low


def local_contrast(tiles: DataFrame, clip: float = 2.0, cells: int = 8) -> DataFrame:
    """The tiles with local contrast raised.  Tiles may have any size, images too; an empty table stays empty."""
    kind = dict(tiles.dtypes)["image_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, width, height, y0, x0, grid in grids(batch):
                rows, columns = cell_share(y0, grid.shape[0], height, cells), cell_share(x0, grid.shape[1], width, cells)
                (ty, y), (tx, x) = np.nonzero(rows), np.nonzero(columns)
                at = (ty[:, None] * cells + tx) * 256 + grid[y[:, None], x]
                n = np.bincount(at.ravel(), np.outer(rows[ty, y], columns[tx, x]).ravel())
                own = np.flatnonzero(n)
                columns_ = [pa.array(c) for c in (own // 256, own % 256, n[own].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(columns_[0]), batch.schema.field(0).type), *columns_], names=["image_id", "cell", "gray", "n"])

    counts = tiles.select("image_id", *NAMES, "px").mapInArrow(lambda batches: packed(count(batches)), f"image_id {kind}, cell long, gray long, n long").groupBy("image_id", "cell", "gray").agg(F.sum("n").alias("n"))

    # A count as one number: (cell * 256 + gray) * 2^40 + n.
    coded = ((F.col("cell") * 256 + F.col("gray")) * (1 << 40) + F.col("n")).alias("c")
    held = counts.select("image_id", coded).groupBy("image_id").agg(F.collect_list("c").alias("all"))

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for k in range(batch.num_rows):
                at, n = np.divmod(flat[ends[k] : ends[k + 1]], 1 << 40)
                table = np.zeros(cells * cells * 256, dtype=np.int64)
                table[at] = n
                own = curves_of(table.reshape(-1, 256), clip).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([own], pa.binary())], names=["image_id", "curves"])

    made = held.mapInArrow(lambda batches: packed(curves(batches)), f"image_id {kind}, curves binary")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (i, width, height, y0, x0, grid) in enumerate(grids(batch)):
                table = np.frombuffer(batch.column(8)[k].as_py(), dtype=np.uint8).reshape(cells, cells, 256).astype(np.float64)
                (y1, y2, b), (x1, x2, a) = blend(y0, grid.shape[0], height, cells), blend(x0, grid.shape[1], width, cells)
                out = np.zeros(grid.shape)
                for ys, wy in ((y1, 1 - b), (y2, b)):
                    for xs, wx in ((x1, 1 - a), (x2, a)):
                        out += wy[:, None] * wx * table[ys[:, None], xs, grid]
                data = np.rint(np.round(out, 6)).astype(np.uint8).tobytes()
                yield batch_of([i], [(width, height, y0, x0, *grid.shape)], [data], batch.schema.field(0).type)

    return tiles.join(made.hint("merge"), "image_id").select("image_id", *NAMES, "px", "curves").mapInArrow(lambda batches: packed(apply(batches)), schema_of(tiles))
