"""End-to-end plans, sources, sinks and streams."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chartwave.functions.chart import STEPS
from chartwave.operators import jobs
from chartwave.plans import digitize
from chartwave.sources import adapters, readers, sinks
from chartwave.streaming import jobs as stream

SF = "/root/testdata/sf0.001"


def chart_pixels(width=500, height=300, px_per_mm=8.0):
    """A sine with spikes, drawn three pixels thick, with a separator line and short dropouts."""
    t = np.arange(width)
    mv = 0.3 * np.sin(2 * np.pi * t / 160)
    mv[::200] += 0.8
    rows = 150 - mv * px_per_mm * 10
    cells = {(int(round(r)) + d, int(x)) for x, r in zip(t, rows) for d in (-1, 0, 1)}
    cells -= {(y, x) for y in range(height) for x in (101, 102, 333)}
    cells |= {(y, 250) for y in range(20, 280)}
    return mv, [("a", y, x, 255) for y, x in cells if 0 <= y < height]


def test_digitize_a_rendered_chart(spark):
    mv, cells = chart_pixels()
    mask = spark.createDataFrame(cells, "image_id string, y int, x int, gray int")
    widths = spark.createDataFrame([("a", 500)], "image_id string, width int")
    out = digitize.digitize(mask, widths, 300, 8.0, 500).orderBy("idx").collect()
    got = np.array([r.mv for r in out])
    shift = np.median(got - mv)
    smooth = np.array([i % 200 not in (0, 1, 199) for i in range(500)])
    assert len(got) == 500 and abs(np.corrcoef(got, mv)[0, 1]) > 0.99
    assert np.abs(got - mv - shift)[smooth].max() < 3 / 80
    assert max(abs(r.norm) for r in out) == pytest.approx(1)
    arrays = digitize.packed(spark.createDataFrame(out)).first()
    assert arrays.v == got.tolist()


def test_registry_and_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 50


@pytest.mark.parametrize("name", ["dtw_distance", "sinc_resample", "peak_positions", "grid_period", "adaptive_threshold", "resize_bicubic", "component_areas", "hough_votes", "local_contrast", "edge_pixels", "background_removed", "skeleton", "mask_outlines", "simplified_outline"])
def test_queries_without_sql_run(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_archives(spark, tmp_path):
    signals = spark.createDataFrame([("r1", "I", [0.0, 1.5]), ("r1", "RHYTHM", [2.0])], "run_id string, lead string, v array<double>")
    content = sinks.archive_bytes(signals, "run_id", 250.0).first().content
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "s.npz").write_bytes(content)
    (tmp_path / "bad.npz").write_bytes(b"no archive")
    pickled = io.BytesIO()
    np.savez(pickled, a=np.array([{}], dtype=object))
    (tmp_path / "p.npz").write_bytes(pickled.getvalue())
    got = {(r.lead, tuple(r.v), r.sampling_rate) for r in readers.signal_archives(spark, str(tmp_path)).collect()}
    assert got == {("I", (0.0, 1.5), 250.0), ("Rhythm", (2.0,), 250.0)}


def test_annotations_labels_and_images(spark, tmp_path):
    (tmp_path / "a").mkdir()
    shape = {"label": "ecg", "points": [[30, 60], [10, 20]]}
    (tmp_path / "a" / "x.json").write_text(json.dumps({"imageWidth": 100, "imageHeight": 200, "shapes": [shape, {"label": "no", "points": [[1, 1], [2, 2]]}]}))
    r = readers.annotations(spark, str(tmp_path / "a"), "ecg").collect()
    assert [(x.xa, x.yb, x.width) for x in r] == [(30.0, 20.0, 100)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.txt").write_text("0 0.2 0.2 0.2 0.2\nbroken line\n\n0 .5 .5 1 1")
    assert readers.yolo_labels(spark, str(tmp_path / "l")).count() == 2
    lines = spark.createDataFrame([("a", 2, "l2"), ("a", 1, "l1")], "image_id string, shape int, line string")
    assert sinks.label_files(lines).first().content == "l1\nl2"
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"\x00" + bytes([255, 0, 1, 10, 20, 30])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.PNG").write_bytes(png)
    (tmp_path / "i" / "y.txt").write_bytes(b"no")
    assert readers.image_files(spark, str(tmp_path / "i")).count() == 1
    px = readers.image_pixels(spark, str(tmp_path / "i")).orderBy("x").collect()
    assert [(p.y, p.x, p.b, p.g, p.r) for p in px] == [(0, 0, 1, 0, 255), (0, 1, 30, 20, 10)]


def test_reports(spark, tmp_path):
    a = spark.createDataFrame([("I", 1.0)], "lead string, rmse double")
    b = spark.createDataFrame([("II", 2.0)], "lead string, mae double")
    both = sinks.report([a, b])
    assert both.columns == ["lead", "mae", "rmse"]
    sinks.write_report(both, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r/csv")).count() == 2
    assert sinks.event_stream_text(a).first().value == 'data: {"lead":"I","rmse":1.0}\n\n'


def test_stream_equals_batch(spark, tmp_path):
    events = adapters.progress(spark, SF)
    src, out = str(tmp_path / "in"), str(tmp_path / "ck")
    events.coalesce(1).write.parquet(src)
    rows = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = stream.track(rows).writeStream.format("memory").queryName("tracked").outputMode("update").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.run_id, r.ord): (r.status, r.failed) for r in spark.table("tracked").collect()}
    wanted = {(r.run_id, r.ord): (r.status, r.failed) for r in jobs.job_steps(events).collect()}
    assert got == wanted and wanted


def test_state_rules():
    s = stream.advance(None, "progress", "crop", True)
    assert s is None
    s = stream.advance(None, "start", None, True)
    s = stream.advance(s, "progress", "crop", True)
    assert s["status"] == ["complete"] * 4 + ["processing"] + ["waiting"] * 3
    done = stream.advance(s, "complete", None, True)
    assert stream.advance(done, "progress", "yolo", True)["status"] == ["complete"] * 8
    exact = stream.advance({"status": ["complete"] * 8, "failed": False}, "progress", "yolo", False)
    assert exact["status"][STEPS.index("crop")] == "processing"
    odd = stream.advance({"status": ["complete"] * 8, "failed": False}, "progress", "nosuch", False)
    assert odd["status"][0] == "processing"


def test_windows_and_watermarks(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("type"), F.col("event_type").alias("step"), "ts")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for i, df in enumerate((stream.deduplicated(rows), stream.windowed_counts(rows, "1 hour"))):
        q = df.writeStream.format("memory").queryName(f"w{i}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("w0").count() > 0 and spark.table("w1").count() > 0


def test_attempts_in_a_stream_equal_the_batch(spark, tmp_path):
    from chartwave.functions.chart import STEPS

    rows = [(1, 0, 1, "progress", STEPS[3]), (1, 0, 2, "start", None), (1, 0, 3, "progress", STEPS[4]), (1, 0, 4, "error", None), (1, 1, 5, "progress", STEPS[1]),
            (2, 0, 1, "start", None), (2, 0, 2, "progress", STEPS[2]), (2, 0, 9, "complete", None), (3, 0, 1, "progress", STEPS[2]), (3, 1, 2, "progress", STEPS[1]),
            (4, 1, 3, "progress", STEPS[2]), (4, 0, 1, "start", None), (4, 0, 2, "progress", STEPS[5]), (5, 2, 7, "start", None)]
    schema = "run_id long, attempt int, seq long, type string, step string"
    for k, part in enumerate((rows, rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / ("whole" if not k else "parts") / str(k)))
    wanted = {(r.run_id, r.ord): (r.status, r.failed) for r in jobs.job_steps(jobs.last_attempt(spark.createDataFrame(rows, schema))).collect()}
    assert wanted[1, 2] == ("processing", False) and wanted[4, 3] == ("processing", False) and wanted[5, 0] == ("complete", False) and (3, 0) not in wanted
    for name in ("whole", "parts"):
        got = {}

        def keep(batch, number):
            got.update({(r.run_id, r.ord): (r.status, r.failed) for r in batch.collect()})

        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
        q = stream.track_attempts(reader).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / f"ck{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert got == wanted, name


def test_result_documents_of_either_shape(spark, tmp_path):
    docs = {"a": {"success": True, "run_id": "r1", "width": 10, "height": 20, "prediction": [{"class": "x", "probability": 0.5}]}, "b": {"success": False, "error": "ECG cropping failed", "details": "no box"}, "c": {"run_id": "r3", "npz_file": "f.npz"}}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "d.json").write_text("{broken")
    got = {r.file.rsplit("/", 1)[1][0]: r for r in readers.result_documents(spark, str(tmp_path)).collect()}
    assert {k: r.ok for k, r in got.items()} == {"a": True, "b": False, "c": True, "d": False}
    assert json.loads(got["a"].prediction)[0]["class"] == "x" and got["a"].width == 10 and got["b"].error == "ECG cropping failed" and got["b"].run_id is None
    back = sinks.result_json(spark.createDataFrame([("r9", True, "m")], "run_id string, success boolean, message string")).first()
    assert json.loads(back.value) == {"run_id": "r9", "success": True, "message": "m"}
