"""Writers of signals, labels, reports and event streams."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive_bytes(signals: DataFrame, key: str, rate: float) -> DataFrame:
    """(key, content): an npz file with one array for each lead of the key.  signals: (key, lead, v array)."""

    @F.pandas_udf("binary")
    def pack(leads: pd.Series) -> pd.Series:
        out = []
        for rows in leads:
            buffer = io.BytesIO()
            np.savez(buffer, sampling_rate=np.float64(rate), **{r["lead"]: np.asarray(r["v"], dtype=np.float32) for r in rows})
            out.append(buffer.getvalue())
        return pd.Series(out)

    rows = F.array_sort(F.collect_list(F.struct("lead", "v")))
    return signals.groupBy(key).agg(rows.alias("rows")).select(key, pack("rows").alias("content"))


def label_files(lines: DataFrame) -> DataFrame:
    """(image_id, content): one label line for each shape, in order.  lines: (image_id, shape, line)."""
    rows = F.array_sort(F.collect_list(F.struct("shape", "line")))
    return lines.groupBy("image_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("content"))


def report(parts: list[DataFrame], key: str = "lead") -> DataFrame:
    """Reports with different metrics as one: the key, then the sorted union of the metrics."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(key, *sorted(c for c in out.columns if c != key))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def event_stream_text(events: DataFrame) -> DataFrame:
    """Events as server-sent text blocks."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("value"))


def png(gray_or_bgr: np.ndarray) -> bytes:
    """A PNG file of an image (height, width) or (height, width, 3 channels b, g, r)."""
    height, width = gray_or_bgr.shape[:2]
    rows = gray_or_bgr[..., ::-1] if gray_or_bgr.ndim == 3 else gray_or_bgr
    raw = b"".join(b"\0" + np.ascontiguousarray(r, dtype=np.uint8).tobytes() for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if gray_or_bgr.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def image_bytes(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, content): a PNG file of each image; pixels: (key, y, x, gray) or (key, y, x, b, g, r)."""
    channels = ["b", "g", "r"] if "b" in pixels.columns else ["gray"]

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((rows.y.max() + 1, rows.x.max() + 1, len(channels)), dtype=np.uint8)
        grid[rows.y, rows.x] = rows[channels]
        return pd.DataFrame({key: [rows[key].iloc[0]], "content": [png(grid if len(channels) == 3 else grid[..., 0])]})

    kind = dict(pixels.dtypes)[key]
    return pixels.select(key, "y", "x", *channels).groupBy(key).applyInPandas(draw, f"{key} {kind}, content binary")


def lead_crops(crops: DataFrame) -> DataFrame:
    """(name, content): a PNG file Lead_<lead>.png of each crop; crops: (lead, y, x, gray or b, g, r)."""
    return image_bytes(crops, "lead").select(F.concat(F.lit("Lead_"), "lead", F.lit(".png")).alias("name"), "content")


def recordings(samples: DataFrame, quality: DataFrame, boxes: DataFrame, key: str, rate: float) -> DataFrame:
    """(key, norm, mv): two npz files of each recording: peak-normalised leads with their baseline, peak and box; leads in mV with the rate.

    samples: (key, lead, mv array, norm array); quality: (key, lead, baseline, peak); boxes: (key, lead, box array).
    """

    @F.pandas_udf("norm binary, mv binary")
    def pack(leads: pd.Series) -> pd.DataFrame:
        out = []
        for rows in leads:
            norm, mv = {}, {}
            for r in rows:
                norm[r["lead"]] = np.asarray(r["norm"], dtype=np.float32)
                norm[f"{r['lead']}__baseline"], norm[f"{r['lead']}__peak"] = np.float32(r["baseline"]), np.float32(r["peak"])
                if r["box"] is not None:
                    norm[f"{r['lead']}__box"] = np.asarray(r["box"], dtype=np.int32)
                mv["RHYTHM" if r["lead"] == "Rhythm" else r["lead"]] = np.asarray(r["mv"], dtype=np.float32)
            made = []
            for arrays in (norm, mv | {"sampling_rate": np.float64(rate)}):
                buffer = io.BytesIO()
                np.savez(buffer, **arrays)
                made.append(buffer.getvalue())
            out.append(made)
        return pd.DataFrame(out, columns=["norm", "mv"])

    rows = samples.join(quality, [key, "lead"], "left").join(boxes, [key, "lead"], "left")
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lead", "norm", "mv", "baseline", "peak", "box"))).alias("rows"))
    return packed.select(key, pack("rows").alias("f")).select(key, "f.norm", "f.mv")


def result_json(results: DataFrame) -> DataFrame:
    """(run_id, value): the result document of each run; absent fields are left out."""
    return results.select("run_id", F.to_json(F.struct("*")).alias("value"))


def write_predictions(predictions: DataFrame, path: str, key: str) -> None:
    """One folder of JSON for each recording."""
    predictions.write.mode("overwrite").partitionBy(key).json(path)


def served(paths: DataFrame, root: str) -> DataFrame:
    """Paths with whether they may be served: inside the root, not merely beginning like it."""
    inside = F.startswith("path", F.lit(root.rstrip("/") + "/")) & ~F.contains("path", F.lit("/../")) & ~F.endswith("path", F.lit("/.."))
    return paths.withColumn("served", inside)
