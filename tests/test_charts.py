"""Tile filters, calibration, segmentation, digitisation, alignment, classification; files and streams around them."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartwave.functions import chart, held, kernels
from chartwave.operators import align, calibrate, colour, layout, raster, sequence, stats, tallies, tiles
from chartwave.plans import classify, deskew, digitize
from chartwave.sources import adapters, readers, sinks
from chartwave.streaming import jobs as stream


def pixels_of(spark, images):
    """Pixel rows of {name: array (height, width, 3)}."""
    parts = []
    for name, a in images.items():
        y, x = np.indices(a.shape[:2])
        cols = {"image_id": [name] * y.size, "width": np.full(y.size, a.shape[1], np.int32), "height": np.full(y.size, a.shape[0], np.int32), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32)}
        parts.append(pa.table(cols | {c: a[..., k].ravel().astype(np.int32) for k, c in enumerate("bgr")}))
    return spark.createDataFrame(pa.concat_tables(parts))


def grids(made):
    out = {}
    for r in tiles.to_pixels(made).collect():
        out.setdefault(r.image_id, {})[r.y, r.x] = r.gray
    return {i: np.array([[c[y, x] for x in range(max(k[1] for k in c) + 1)] for y in range(max(k[0] for k in c) + 1)]) for i, c in out.items()}


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(1)
    return {"a": rng.integers(0, 256, (37, 50)).astype(np.uint8), "b": rng.integers(0, 256, (9, 70)).astype(np.uint8), "c": np.full((1, 1), 9, np.uint8), "d": rng.integers(0, 256, (33, 3)).astype(np.uint8)}


def tiled(spark, small):
    rows = [(i, a.shape[1], a.shape[0], a.tobytes()) for i, a in small.items()]
    return tiles.from_images(spark.createDataFrame(rows, "image_id string, width int, height int, px binary"))


def slow_resize(a, factor, kind):
    reach, weight = tiles.KERNELS[kind]
    h, w = a.shape
    out = np.zeros((int(h * factor), int(w * factor)))
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            sy, sx = (y + 0.5) / factor - 0.5, (x + 0.5) / factor - 0.5
            ys, xs = int(np.floor(sy)) + np.arange(1 - reach, reach + 1), int(np.floor(sx)) + np.arange(1 - reach, reach + 1)
            wy, wx = weight(sy - ys), weight(sx - xs)
            part = a[np.clip(ys, 0, h - 1)][:, np.clip(xs, 0, w - 1)]
            out[y, x] = wy @ part @ wx / wy.sum() / wx.sum()
    return np.clip(np.rint(out), 0, 255)


@pytest.mark.parametrize("size", [512, 16])
def test_tile_filters_equal_whole_images(spark, small, monkeypatch, size):
    monkeypatch.setattr(tiles, "SIZE", size)
    made = tiled(spark, small)
    assert all((grids(made)[i] == a).all() for i, a in small.items())
    for kind, factor in (("bicubic", 2.0), ("lanczos4", 1.5)):
        got = grids(tiles.resize(made, factor, kind))
        assert all(np.abs(got[i] - slow_resize(a, factor, kind)).max() <= (0 if kind == "bicubic" else 1) for i, a in small.items())
    pad = lambda a, r, **k: np.pad(a.astype(float), r, **k)
    view = np.lib.stride_tricks.sliding_window_view
    got = grids(tiles.median_blur(made, 5))
    assert all((got[i] == np.median(view(pad(a, 2, mode="edge"), (5, 5)), axis=(2, 3))).all() for i, a in small.items())
    got = grids(tiles.erode(made, 2, 5))
    wanted = {i: view(np.pad(a.astype(float), ((1, 0), (2, 2)), constant_values=999), (2, 5)).min(axis=(2, 3)) for i, a in small.items()}
    assert all((got[i] == wanted[i]).all() for i in small)
    opened, closed = grids(tiles.opened(made, 4, 3)), grids(tiles.closed(made, 4, 3))
    assert all((opened[i] <= a).all() and (closed[i] >= a).all() for i, a in small.items())
    assert all((grids(tiles.opened(tiles.opened(made, 4, 3), 4, 3))[i] == opened[i]).all() for i in small)
    got, k = grids(tiles.blur(made, 7)), np.array(tiles.gaussian(7))
    for i, a in small.items():
        if min(a.shape) > 3:
            assert np.abs(got[i] - np.einsum("yxij,i,j->yx", view(pad(a, 3, mode="reflect"), (7, 7)), k, k)).max() <= 0.5 + 1e-9


def test_pixels_and_tiles_agree(spark, small):
    rows = [(i, a.shape[1], a.shape[0], y, x, int(a[y, x])) for i, a in small.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    made = tiles.from_pixels(spark.createDataFrame(rows, "image_id string, width int, height int, y int, x int, gray int"))
    assert all((grids(made)[i] == a).all() for i, a in small.items())
    assert tiles.resize(made.limit(0), 2.0).count() == 0


def test_calibration_of_a_drawn_grid(spark):
    lines = np.zeros((240, 320, 3), np.uint8)
    lines[..., 2] = 60
    lines[::8, :, 2] = lines[:, ::8, 2] = 200
    rows = {r.image_id: r for r in calibrate.px_per_mm(pixels_of(spark, {"grid": lines, "none": np.zeros((40, 40, 3), np.uint8)})).collect()}
    assert abs(rows["grid"].px_per_mm - 8) < 0.2 and rows["grid"].confidence > 0.8 and rows["grid"].n >= 6
    assert (rows["none"].px_per_mm, rows["none"].confidence, rows["none"].method) == (11.8, 0.0, "fallback-default")


def drawn_chart(width=800, height=480):
    """White traces on black: three rows of four leads and a rhythm strip."""
    image, x = np.zeros((height, width, 3), np.uint8), np.arange(width)
    rows = [60, 180, 300, 420]
    shape = 18 * np.sin(2 * np.pi * x / 50)
    for y0 in rows:
        for dy in (-1, 0, 1):
            image[np.rint(y0 - shape).astype(int) + dy, x] = 255
    return image, rows, shape


def test_digitize_a_whole_chart(spark):
    image, rows, shape = drawn_chart()
    samples, quality = digitize.run(pixels_of(spark, {"c": image}), chart.lead_dim(spark))
    got = {}
    for r in samples.collect():
        got.setdefault(r.lead, []).append((r.idx, r.mv, r.norm))
    assert {k: len(v) for k, v in got.items()} == {n: 5000 if n == "Rhythm" else 1250 for n, *_ in chart.LEADS}
    assert all(max(abs(v[2]) for v in own) == pytest.approx(1) for own in got.values())
    off = np.array([v[1] for v in sorted(got["Rhythm"])]) * 118 - np.interp(np.linspace(0, 799, 5000), np.arange(800), shape)
    assert np.abs(off - np.median(off))[1000:4700].max() < 3
    q = {r.lead: r for r in quality.collect()}
    assert len(q) == 13 and all(r.finite_share > 0.8 and r.mask_pixels > 300 and r.score == 1.0 for r in q.values())


def test_drawn_charts_come_back_with_and_without_labels_and_baselines(spark):
    """Every lead of ten charts within three pixels of what was drawn; given baselines are the drawn rows."""
    d, leads = "/root/testdata/sf0.001", chart.lead_dim(spark)
    images = adapters.charts(spark, d)
    made = deskew.colour_tiles(images, 128)
    anchors = layout.label_anchors(adapters.chart_labels(spark, d), images.select("image_id", "width"))
    samples, quality = digitize.run_tiles(made, leads, anchors, adapters.chart_baselines(spark, d), 128)
    boxes, splits = digitize.segment(made, anchors, 128)
    boxes = {(r.image_id, r.lead): r for r in boxes.collect()}
    sizes = {r.image_id: (r.width, r.height) for r in images.select("image_id", "width", "height").collect()}
    q = {(r.image_id, r.lead): r for r in quality.collect()}
    assert len(sizes) == 10 and q.keys() == boxes.keys() == {(i, n) for i in sizes for n, *_ in chart.LEADS}
    assert {r.image_id: r.method for r in splits.collect()} == {i: "equal-width" if i % 2 else "OCR" for i in sizes}
    got = {}
    for r in samples.collect():
        got.setdefault((r.image_id, r.lead), []).append((r.idx, r.mv))
    for (i, lead), own in got.items():
        box, (rows, wave) = boxes[i, lead], adapters.chart_shape(i, *sizes[i])
        row = rows[[n for n, *_ in chart.LEADS].index(lead) // 4]
        at = np.linspace(box.fx1, box.fx2 - 1, len(own))
        middle = slice(len(own) // 5, -len(own) // 10)
        drawn = row - np.interp(at, np.arange(sizes[i][0]), wave)
        found = q[i, lead].baseline + box.fy1 - np.array([v for _, v in sorted(own)]) * 118
        assert np.abs(found - drawn)[middle].max() < 3, (i, lead)
        assert q[i, lead].finite_share > 0.8 and (i % 3 or q[i, lead].baseline + box.fy1 == row)
    assert len(got) == 130


def test_digitising_black_images_and_none(spark):
    """No ink: flat leads of equal width; no image: no row."""
    black = spark.createDataFrame([("b", 64, 48, bytes(64 * 48 * 3)), ("s", 2, 2, bytes(12))], "image_id string, width int, height int, px binary")
    samples, quality = digitize.run_tiles(deskew.colour_tiles(black, 16), chart.lead_dim(spark), tile=16)
    rows = samples.where("image_id = 'b'").collect()
    assert len({r.lead for r in rows}) == 13 and all(r.mv == r.norm == 0 for r in rows)
    assert all((r.mask_pixels, r.finite_share) == (0, 0) for r in quality.collect())
    samples, quality = digitize.run_tiles(deskew.colour_tiles(black.where("false"), 16), chart.lead_dim(spark), tile=16)
    assert not samples.count() and not quality.count()


def test_counts_of_tiles_equal_those_of_pixels(spark):
    """Calibration, boxes' ink and percentiles from counts over tiles of 16 are those of pixel rows."""
    rng = np.random.default_rng(4)
    images = {"a": rng.integers(0, 256, (50, 70, 3), dtype=np.uint8), "b": np.zeros((130, 140, 3), np.uint8)}
    images["b"][::8, :, 2] = images["b"][:, ::8, 2] = 200
    pixels = pixels_of(spark, images)
    made = tallies.colour_from_pixels(pixels, 16)
    one, two = ({r.image_id: r.asDict() for r in f.collect()} for f in (calibrate.px_per_mm(pixels), calibrate.px_per_mm_of(made)))
    assert one == two
    boxes = spark.createDataFrame([("a", "I", 5, 3, 40, 45), ("a", "II", 20, 10, 70, 50), ("b", "I", 0, 0, 140, 130)], "image_id string, lead string, x1 long, y1 long, x2 long, y2 long")
    gray = pixels.withColumn("gray", raster.gray_of()).join(boxes, "image_id").where("x >= x1 AND x < x2 AND y >= y1 AND y < y2")
    cells = gray.select(F.concat_ws(" ", "image_id", "lead").alias("image_id"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"), "gray")
    want = {r.image_id: (r.top, r.bottom) for r in colour.tight_bounds(cells).collect()}
    got = {f"{r.image_id} {r.lead}": (r.top, r.bottom) for r in digitize.tight_rows(made, boxes).collect()}
    assert got == want and len(got) == 3


def test_column_splits_prefer_labels_then_lines(spark):
    anchors = spark.createDataFrame([(1, 100, [12, 40, 60, 90]), (2, 100, [2, 4, 60, 90]), (3, 100, None), (4, 100, [12, None, None, None])], "image_id int, width int, anchors array<bigint>")
    lines = spark.createDataFrame([(2, [24, 51, 77, 90]), (4, [1, 2, 3])], "image_id int, places array<bigint>")
    got = {r.image_id: (r.method, r.edges) for r in layout.column_splits(anchors, lines).collect()}
    assert got == {1: ("OCR", [0, 26, 50, 75, 100]), 2: ("white-separator", [0, 24, 51, 77, 100]), 3: ("equal-width", [0, 25, 50, 75, 100]), 4: ("equal-width", [0, 25, 50, 75, 100])}


def beats(n, scale=1.0, offset=0.0, gain=1.0):
    t = np.arange(n) * scale + offset
    out = 0.1 * np.sin(t / 37)
    for k, at in enumerate(np.cumsum(40 + 9 * np.sin(np.arange(60) * 1.7))):
        out += (0.8 + 0.3 * np.cos(k)) * np.exp(-0.5 * ((t - at) / 2) ** 2)
    return gain * out


@pytest.mark.parametrize("scale, offset, gain", [(1.0, 0.0, 1.0), (1.02, 15.0, 0.5), (0.97, -20.0, 2.0)])
def test_alignment_recovers_scale_shift_and_gain(spark, scale, offset, gain):
    truth, paper = beats(900), beats(700, scale, offset, gain)
    frame = lambda v: spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(v)], "run_id string, idx int, v double")
    row = align.align(frame(truth), frame(paper), ["run_id"], 50.0).first()
    assert abs(row.scale - scale) <= 0.006 and abs(row.offset_samples - offset) <= 8 and row.offset_ms == row.offset_samples * 20
    assert row.matches >= 5 and row["corr"] > 0.6 and abs(row.gain * gain - 1) < 0.5
    assert set(align.summary(align.align(frame(truth), frame(paper), ["run_id"], 50.0), ["run_id"]).columns) >= {"run_id", "scale", "rmse", "matches"}


def test_metrics_of_the_active_part(spark):
    rows = [("a", i, float(i), float(i) + (5 if i > 20 else 0)) for i in range(30)]
    pairs = spark.createDataFrame(rows, "run_id string, idx int, ref double, est double")
    gains = spark.createDataFrame([("a", 1.0, 0.0)], "run_id string, gain double, offset double")
    on = lambda n: spark.createDataFrame([("a", i) for i in range(n)], "run_id string, idx int")
    assert align.aligned_metrics(pairs, gains, ["run_id"], on(15)).first().rmse == 0
    assert align.aligned_metrics(pairs, gains, ["run_id"], on(5)).first().n == 30
    flat = stats.pair_metrics(spark.createDataFrame([("a", 1.0, 2.0)] * 3, "run_id string, ref double, est double"), ["run_id"]).first()
    assert flat.pearson is None and flat.rmse == 1


def test_polyphase_keeps_a_slow_wave():
    x = np.sin(np.arange(400) / 15)
    up = kernels.polyphase(x, 3, 2)
    assert len(up) == 600 and np.abs(up[60:-60] - np.sin(np.arange(600) * 2 / 3 / 15)[60:-60]).max() < 0.01
    assert kernels.polyphase(x, 1, 1) is x and len(kernels.polyphase(x, 2, 3)) == 267


def test_a_model_is_made_once_in_a_worker():
    made = []
    assert [held.held(k, lambda: made.append(1) or len(made)) for k in ("a", "a", "b", "b")] == [1, 1, 2, 2] and list(held.HELD) == ["b"]


def test_classification_with_a_given_model(spark):
    leads = ["I", "II", "Rhythm"]
    rows = [(1, n, [float(k) for k in range(50)]) for n in ("I", "II", "RHYTHM")] + [(2, "I", [1.0])]
    signals = spark.createDataFrame(rows, "run_id int, lead string, v array<double>")

    def model():
        return lambda x: np.array([[0.4, 0.4, 0.2]]) if x.shape == (1, classify.POINTS, 3) and abs(x.mean()) < 1e-6 and abs(x.std() - 1) < 1e-3 else np.array([[0.0, 0.0, 1.0]])

    got = {r.run_id: r for r in classify.predict(signals, ["run_id"], model, ["HB", "MI", "Normal"], leads).collect()}
    assert (got[1].label, got[1].confidence, got[1].missing) == ("HB", 0.4, "") and got[1].probabilities["Normal"] == 0.2
    assert got[2].label is None and got[2].missing == "II,Rhythm"
    with pytest.raises(Exception, match="3 probabilities for 2 classes"):
        classify.predict(signals, ["run_id"], model, ["HB", "MI"], leads).collect()
    images = spark.createDataFrame([("a", b"x"), ("b", b"late")], "image_id string, content binary")
    assert classify.detected(images, lambda c: [("ecg", 1, 2, 3, len(c))]).where("image_id = 'b'").first().y2 == 4

    def read(content):
        if content == b"late":
            raise TimeoutError
        return [("aVR", 88, 5, 10), ("?", 3, 0, 0)]

    assert [tuple(r) for r in chart.confident(classify.recognised(images, read)).collect()] == [("a", "aVR", 88, 5, 10)]


def test_names_and_probabilities_must_agree(spark):
    rows = spark.createDataFrame([(["a", "b"], [0.1, 0.9])], "k array<string>, v array<double>")
    assert rows.select(chart.named_probabilities(F.col("k"), F.col("v")).alias("m")).first().m == {"a": 0.1, "b": 0.9}
    with pytest.raises(Exception, match="as many classes"):
        rows.select(chart.named_probabilities(F.slice("k", 1, 1), F.col("v"))).collect()
    assert rows.select(chart.new_run_id()).first()[0] != rows.select(chart.new_run_id()).first()[0]


def jpeg_with(tag, order):
    word = "<H" if order == b"II" else ">H"
    entry = struct.pack(word, 274) + struct.pack(word, 3) + struct.pack(word[0] + "I", 1) + struct.pack(word, tag) + b"\0\0"
    tiff = order + struct.pack(word, 42) + struct.pack(word[0] + "I", 8) + struct.pack(word, 1) + entry
    block = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda\x00\x02"


def test_files(spark, tmp_path):
    for i, (tag, order) in enumerate([(6, b"II"), (3, b"MM"), (8, b"II"), (99, b"MM")]):
        (tmp_path / f"{i}.jpg").write_bytes(jpeg_with(tag, order))
    (tmp_path / "4.png").write_bytes(b"no image")
    assert [r.angle for r in readers.oriented_files(spark, str(tmp_path)).orderBy("path").collect()] == [90, 180, 270, 0, 0]
    assert [r.path[-5:] for r in readers.sorted_files(spark, str(tmp_path), 3).collect()] == ["0.jpg", "1.jpg", "2.jpg"]
    deep = tmp_path / "runs"
    for folder in ("b", "a/c"):
        (deep / folder).mkdir(parents=True)
        (deep / folder / "ecg_signals_mv.npz").write_bytes(b"x")
        (deep / folder / "other.npz").write_bytes(b"x")
    found = lambda: [r.path.split("/runs/")[1] for r in readers.result_archives(spark, str(deep)).select("path").collect()]
    assert found() == ["a/c/ecg_signals_mv.npz", "b/ecg_signals_mv.npz"]
    (deep / "ecg_signals_mv.npz").write_bytes(b"x")
    assert found() == ["ecg_signals_mv.npz"]
    (tmp_path / "names.json").write_text('["HB",\n "MI"]')
    (tmp_path / "bad.json").write_text("[]")
    assert [(r.ord, r.name) for r in readers.class_names(spark, str(tmp_path / "names.json")).collect()] == [(0, "HB"), (1, "MI")]
    with pytest.raises(Exception, match="JSON array"):
        readers.class_names(spark, str(tmp_path / "bad.json")).collect()
    assert readers.preferred_file(spark, [str(deep), str(tmp_path)], "names.json", "*.npz").endswith("names.json")
    assert readers.preferred_file(spark, [str(tmp_path)], "none", "*.json").endswith("bad.json")
    with pytest.raises(FileNotFoundError):
        readers.preferred_file(spark, [str(tmp_path)], "none", "*.none")
    rates = readers.sampling_rates(*(spark.createDataFrame(r, "id int, sampling_rate double") for r in ([(1, 250.0), (2, None)], [(1, None), (3, 100.0)])), "id")
    assert sorted(tuple(r) for r in rates.collect()) == [(1, 250.0, 250.0), (2, 500.0, 500.0), (3, 500.0, 100.0)]


def test_images_and_archives_written_are_read_again(spark, tmp_path):
    image = np.random.default_rng(3).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    made = sinks.image_bytes(pixels_of(spark, {"a": image}).select("image_id", "y", "x", "b", "g", "r")).first()
    (tmp_path / "a.png").write_bytes(made.content)
    got = np.zeros_like(image)
    for r in readers.image_pixels(spark, str(tmp_path)).collect():
        got[r.y, r.x] = (r.b, r.g, r.r)
    assert (got == image).all()
    assert [(r.width, r.height, len(r.px)) for r in tiles.gray_images(spark, str(tmp_path)).collect()] == [(7, 5, 35)]
    gray = spark.createDataFrame([("I", y, x, y * x) for y in range(3) for x in range(4)], "lead string, y int, x int, gray int")
    crop = sinks.lead_crops(gray).first()
    at = crop.content.index(b"IDAT")
    rows = zlib.decompress(crop.content[at + 4 : at + 4 + struct.unpack(">I", crop.content[at - 4 : at])[0]])
    assert crop.name == "Lead_I.png" and rows == bytes([0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 0, 0, 2, 4, 6])
    samples = spark.createDataFrame([(1, "I", [0.5], [1.0]), (1, "Rhythm", [0.2], [1.0])], "run_id int, lead string, mv array<double>, norm array<double>")
    quality = spark.createDataFrame([(1, "I", 10.0, 4.0), (1, "Rhythm", 11.0, 5.0)], "run_id int, lead string, baseline double, peak double")
    boxes = spark.createDataFrame([(1, "I", [1, 2, 3, 4])], "run_id int, lead string, box array<int>")
    files = sinks.recordings(samples, quality, boxes, "run_id", 500.0).first()
    norm, mv = readers.archive(files.norm), readers.archive(files.mv)
    assert norm["I__box"] == [1, 2, 3, 4] and norm["Rhythm__baseline"] == [11] and norm["I__peak"] == [4] and "Rhythm__box" not in norm
    assert mv["sampling_rate"] == [500] and set(mv) == {"I", "RHYTHM", "sampling_rate"}


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([("r1", True, None), ("r2", False, "bad image")], "run_id string, success boolean, error string")
    docs = {r.run_id: json.loads(r.value) for r in sinks.result_json(rows).collect()}
    assert docs["r2"]["error"] == "bad image" and "error" not in docs["r1"]
    sinks.write_predictions(rows, str(tmp_path / "p"), "run_id")
    assert spark.read.json(str(tmp_path / "p")).count() == 2
    paths = spark.createDataFrame([("/up/a.png",), ("/uploads2/a",), ("/up/../etc",)], "path string")
    assert [r.served for r in sinks.served(paths, "/up").collect()] == [True, False, False]


def test_steady_detection_over_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    found = [bool(rng.random() < 0.85) if i % 29 else None for i in range(300)]
    schema, source = "camera int, seq long, found boolean", tmp_path / "in"
    wanted, n = [], 0
    for i, f in enumerate(found):
        n = n + 1 if f else 0
        if n == 10:
            wanted.append(i)
            n = 0
    out, counts = [], []
    for k in range(3):
        rows = [(1, i, f) for i, f in enumerate(found) if i // 100 == k]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    told = stream.each_batch(lambda number, rows: counts.append(rows))

    def keep(batch, number):
        out.extend(r.seq for r in batch.collect())
        told(batch, number)

    query = stream.steady(reader).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(counts) == len(out) and sorted(out) == wanted
    events = spark.createDataFrame([(1, 1, "{a}"), (1, 2, None), (2, 1, None)], "run_id int, seq int, prediction string")
    assert {r.run_id: r.prediction for r in stream.predictions(events).collect()} == {1: "{a}", 2: None}


def slow_alignment(truth, paper, truth_peaks, paper_peaks, step, tol):
    """Every scale and offset on its own, as the rule says it."""
    best, n, m = (-np.inf,), len(truth), len(paper)
    for scale in kernels.SCALES:
        sweep, at = [], 0.2 * min(n, m) - scale * m
        while at < n - 0.2 * min(n, m) + step:
            sweep.append(at)
            at += step
        for offset in sorted({step * round(o / step) for o in [t - scale * p for t in truth_peaks for p in paper_peaks] + sweep}):
            spots = [(i, (i - offset) / scale) for i in range(n)]
            both = [(truth[i], np.interp(u, np.arange(m), paper)) for i, u in spots if 0 <= u <= m - 1 + 1e-12]
            corr = -np.inf
            if len(both) >= max(80, 0.15 * min(n, m)):
                a, b = np.array(both).T
                corr = np.corrcoef(a, b)[0, 1] if a.std() * b.std() >= 1e-6 else -np.inf
            taken, score = set(), 0.0
            for p in paper_peaks:
                gaps = [abs(t - offset - scale * p) for t in truth_peaks]
                if gaps and min(gaps) <= tol and gaps.index(min(gaps)) not in taken:
                    taken.add(gaps.index(min(gaps)))
                    score += np.exp(-0.5 * (min(gaps) / tol) ** 2)
            anchor = score if len(taken) >= 2 else 0.2 * score
            if (total := anchor + 0.35 * max(corr, -1.0)) > best[0] + 1e-9:
                best = (total, corr, anchor, len(taken), scale, offset)
    return best


def test_alignment_of_all_offsets_at_once():
    rng = np.random.default_rng(9)
    for n, m in ((150, 130), (120, 170)):
        truth, paper = np.convolve(rng.normal(size=n), np.ones(4), "same"), np.convolve(rng.normal(size=m), np.ones(4), "same")
        peaks = [np.sort(rng.choice(k, 5, replace=False)).astype(float) for k in (n, m)]
        assert kernels.alignment(truth, paper, *peaks, 5, 8) == pytest.approx(slow_alignment(truth, paper, *peaks, 5, 8), abs=1e-6)
    flat = kernels.alignment(np.ones(100), np.ones(90), np.zeros(0), np.zeros(0), 5, 8)
    assert flat[1] == -np.inf and flat[3] == 0
    assert kernels.alignment(np.zeros(0), np.ones(5), np.zeros(0), np.zeros(0), 5, 8)[0] == -np.inf


def test_alignment_at_unequal_rates(spark):
    fast, slow = np.interp(np.arange(9000) * 0.1, np.arange(900), beats(900)), beats(900)
    low = np.interp(np.arange(0, 700, 50 / 36), np.arange(900), slow)
    frame = lambda v: spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(v)], "run_id string, idx int, v double")
    row = align.align(frame(slow), frame(low), ["run_id"], 50.0, 36.0).first()
    assert abs(row.scale - 1) <= 0.004 and abs(row.offset_samples) <= 5 and row["corr"] > 0.8 and len(fast) == 9000
    assert align.at_rate(frame(np.arange(10.0)), ["run_id"], 500.0, 360.0).count() == 8


def test_validation_report(spark):
    rows = [("a", i, float(v)) for i, v in enumerate(beats(600))] + [("b", i, 1.0) for i in range(20)] + [("c", 0, 1.0)]
    late = [("a", i, float(v)) for i, v in enumerate(np.r_[np.zeros(13), beats(600)[:-13]])] + [("b", i, 1.0) for i in range(25)] + [("d", 0, 1.0)]
    frame = lambda r: spark.createDataFrame(r, "run_id string, idx int, v double")
    got = {r.run_id: r for r in align.validate(frame(rows), frame(late), ["run_id"], 50.0).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert a.lag == -13 and a.lag_ms == -260 and a.n == 587 and a.rmse < 1e-9 and a.pearson == pytest.approx(1) and a.dtw < 1e-9
    assert a.rr_error_ms < 1e-9 and a.r_error < 1e-9 and a.n_beats > 5
    assert b.lag == -19 and b.n == 1 and b.pearson is None and b.rmse == 0 and b.n_beats is None  # all lags are equal


def test_strips_and_tiles_of_crops_give_the_same(spark, monkeypatch):
    """the trace was a row for each pixel and a sample; images and crops of several tiles and strips give what whole ones do."""
    d, leads = "/root/testdata/sf0.001", chart.lead_dim(spark)
    images = adapters.charts(spark, d).where("image_id < 4")
    made = deskew.colour_tiles(images, 128)
    found = {}
    for work in (48, 512):
        monkeypatch.setattr(digitize, "WORK", work)
        samples, quality = digitize.run_tiles(made, leads, None, adapters.chart_baselines(spark, d), 16)
        sums = samples.groupBy("image_id", "lead").agg(F.count("mv").alias("n"), F.sum(F.col("mv") * F.col("idx")).alias("m"), F.max("norm").alias("top"))
        found[work] = sorted((r.image_id, r.lead, r.n, round(r.m, 6), round(r.top, 9)) for r in sums.collect()), sorted(map(tuple, quality.collect()))
    assert found[48] == found[512] and len(found[48][0]) == len(found[48][1]) == 13 * images.count()


def test_columns_of_a_lead_equal_the_operators_on_rows(spark):
    """separators, tips, gaps, the modal row and refined peaks of arrays are those of the operators on rows."""
    rng = np.random.default_rng(12)
    on = rng.random((60, 80)) < np.where(np.arange(80) % 9 == 0, 0.7, 0.08)
    on[:, 40] = False
    on[5:55, 20] = True
    y, x = np.nonzero(on)
    mask = spark.createDataFrame([("a", 80, 60, int(v), int(u)) for v, u in zip(y, x)], "image_id string, width int, height int, y int, x int")
    bad = {r.x for r in raster.separator_columns(mask).where("bad").collect()}
    assert bad and bad == set(np.flatnonzero(digitize.separators(on, 80, 0)).tolist())
    tips = {r.x: r.y for r in raster.spike_tips(mask.select("image_id", "y", "x"), spark.createDataFrame([("a", 60)], "image_id string, height int")).collect()}
    got = digitize.spike_rows(*digitize.ends(on), np.count_nonzero(on, axis=1))
    assert tips and tips == {int(k): int(got[k]) for k in np.flatnonzero(~np.isnan(got))}
    v = np.where(rng.random(200) < 0.4, np.nan, rng.integers(0, 30, 200) + rng.random(200))
    rows = spark.createDataFrame([("a", i, None if np.isnan(s) else float(s)) for i, s in enumerate(v)], "image_id string, idx int, v double")
    filled = sequence.fill_short_gaps(rows, ["image_id"], 3)
    peaks = sequence.refine_peaks(filled.withColumn("v", F.coalesce("v", F.lit(0.0))), ["image_id"]).orderBy("idx").collect()
    mine = digitize.without_gaps(v, 3)
    assert [r.v for r in filled.orderBy("idx").collect()] == [None if np.isnan(s) else s for s in mine.tolist()]
    assert stats.modal_value(filled, ["image_id"], 1 << 20).first().mode == digitize.modal_row(mine)
    assert [r.refined for r in peaks] == digitize.refined(np.where(np.isnan(mine), 0.0, mine)).tolist()
