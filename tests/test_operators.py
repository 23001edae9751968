"""Hand-computed cases of the chart operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartwave.functions import chart, kernels
from chartwave.operators import filters, jobs, matching, raster, sequence, shapes, stats

K = ["k"]


def signal(spark, values, name="v"):
    return spark.createDataFrame([(1, i, None if x is None else float(x)) for i, x in enumerate(values)], f"k int, idx int, {name} double")


def column(df, c="v", by="idx"):
    return [r[c] for r in df.orderBy(by).collect()]


@pytest.mark.parametrize("values, gap, wanted", [([1, None, None, 4], 2, [1, 2, 3, 4]), ([1, None, None, 4], 1, [1, None, None, 4]), ([None, 1, 2, None], 5, [None, 1, 2, None])])
def test_short_gaps(spark, values, gap, wanted):
    assert column(sequence.fill_short_gaps(signal(spark, values), K, gap)) == wanted


def test_all_gaps(spark):
    assert column(sequence.fill_all_gaps(signal(spark, [None, 1, None, 3, None]), K)) == [1, 1, 2, 3, 3]
    assert column(sequence.fill_all_gaps(signal(spark, [None, None]), K)) == [0, 0]


def test_scores(spark):
    s = signal(spark, [1, 2, 3])
    assert column(s.withColumn("v", stats.zscore(s, K, 1e-12, "zero"))) == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    flat = signal(spark, [5, 5, 5])
    assert column(flat.withColumn("v", stats.zscore(flat, K, 1e-12, "zero"))) == [0, 0, 0]
    r = stats.robust_z(signal(spark, [1, 2, 3, 4, 100]), K)
    assert column(r, "z") == pytest.approx([-1.348982, -0.674491, 0, 0.674491, 65.425604], abs=1e-5)


def test_runs_and_folds(spark):
    s = signal(spark, [0, 1, 1, 0, 1])
    assert sorted((r.start, r.stop) for r in sequence.runs(s, K, F.col("v") > 0).collect()) == [(1, 2), (4, 4)]
    peaks = spark.createDataFrame([(1, i) for i in (3, 5, 9, 12)], "k int, idx int")
    assert sorted(r.idx for r in sequence.keep_spaced(peaks, K, "idx", 5).collect()) == [3, 9]
    lines = spark.createDataFrame([(1, float(y)) for y in (0, 4, 8, 12, 16)], "k int, y double")
    assert sorted(r.y for r in sequence.keep_spaced(lines, K, "y", 5).collect()) == [0, 8, 16]
    lines = spark.createDataFrame([(1, float(y)) for y in (10, 30, 70)], "k int, y double")
    assert [(r.top, r.bottom) for r in sequence.vertical_anchors(lines, K, 100).orderBy("y").collect()] == [(0, 24), (16, 44), (42, 98)]
    bands = spark.createDataFrame([(1, *b) for b in ((0, 2), (3, 5), (9, 11), (20, 22), (30, 32))], "k int, start int, stop int")
    assert sorted((r.start, r.stop) for r in sequence.merge_bands(bands, K, 4).collect()) == [(0, 5), (9, 11), (20, 22), (30, 32)]


def test_smoothing_and_resampling(spark):
    assert column(signal(spark, [3, 3, 3]).withColumn("v", sequence.moving_mean(K, 3))) == [2, 3, 2]
    assert column(sequence.resample(signal(spark, [0, 10]), K, 5)) == [0, 2.5, 5, 7.5, 10]
    assert column(sequence.refine_peaks(signal(spark, [0, 2, 1]), K), "refined") == pytest.approx([0, 2.0416667, 1], abs=1e-6)
    assert column(signal(spark, [1, 9, 2, 3, 4]).withColumn("v", sequence.running_median(K, 3))) == [1, 2, 3, 3, 4]


def pairs(spark, ref, est):
    return spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(ref, est))], "k int, idx int, ref double, est double")


def test_pair_metrics(spark):
    r = stats.pair_metrics(pairs(spark, [3, 4], [3, 5]), K).first()
    assert (r.rmse, r.mae, r.prd, r.snr) == pytest.approx((0.707107, 0.5, 20, 13.9794), abs=1e-5)
    same = stats.pair_metrics(pairs(spark, [3, 4], [3, 4]), K).first()
    assert same.rmse == 0 and same.snr == math.inf
    assert stats.pair_metrics(pairs(spark, [3], [4]), K).first().pearson is None


def test_lag_and_matches(spark):
    assert matching.best_lag(pairs(spark, [0, 0, 1, 0], [1, 0, 0, 0]), K, 10).first().lag == 2
    t = spark.createDataFrame([(1, i) for i in (10, 20, 40)], "k int, idx int")
    p = spark.createDataFrame([(1, i) for i in (9, 11, 22, 60)], "k int, idx int")
    assert sorted((r.truth_idx, r.paper_idx) for r in matching.match_peaks(t, p, K, 3).collect()) == [(10, 9), (20, 22)]


def test_gain_fit_recovers_gain_and_offset(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(400)
    y = 1.7 * x + 0.3
    y[::40] += 25
    r = stats.trimmed_gain_fit(pairs(spark, y, x), K).first()
    assert (r.gain, r.offset) == pytest.approx((1.7, 0.3), abs=1e-3)


def test_consensus_and_mode(spark):
    r = stats.inlier_consensus(signal(spark, [11.8, 11.9, 11.7, 20]), K).first()
    assert (r.centre, r.spread, r.n) == pytest.approx((11.8, 0.081650, 3), abs=1e-5)
    assert stats.modal_value(signal(spark, [5, 5, 5, 9, 40]), K, 50, 1).first().mode == 5
    assert stats.percentiles(signal(spark, [1, 2, 3, 4]), K, [85]).first().p85 == pytest.approx(3.55)


def test_amplitude(spark):
    peaks = spark.createDataFrame([("I", 1.5), ("V2", 0.01), ("zz", 1.0)], "lead string, peak double")
    got = {r.lead: (r.issues, r.score) for r in stats.amplitude_check(peaks, chart.lead_dim(spark), chart.OTHER_RANGE).collect()}
    assert got == {"I": ("high", 0.75), "V2": ("low", 0.75), "zz": ("", 1.0)}


def points(spark, xy):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "shape_id int, i int, x double, y double")


def test_quads_and_boxes(spark):
    q = shapes.order_points(points(spark, [(10, 0), (0, 0), (0, 10), (10, 10)])).first()
    assert [(q[c].x, q[c].y) for c in shapes.CORNERS] == [(0, 0), (10, 0), (10, 10), (0, 10)]
    big = shapes.order_points(points(spark, [(100, 100), (900, 100), (900, 900), (100, 900)]))
    assert big.select(shapes.corner_score(F.lit(True), 1000.0, 1000.0).alias("s")).first().s == 420
    box = spark.createDataFrame([(30.0, 60.0, 10.0, 20.0, 100, 200)], "xa double, ya double, xb double, yb double, width int, height int")
    box = box.withColumns(shapes.yolo_box("xa", "ya", "xb", "yb", "width", "height"))
    assert box.select(shapes.yolo_line().alias("l")).first().l == "0 0.200000 0.200000 0.200000 0.200000"
    size = spark.createDataFrame([(4032, 3024)], "width int, height int")
    r = shapes.upscale_totals(size, 2.0, "width").where("width IS NULL").first()
    assert (r.pixels, r.pixels_after, r.increase_pct) == (12192768, 48771072, 300.0)


def mask(spark, cells):
    return spark.createDataFrame([(1, y, x) for y, x in cells], "image_id int, y int, x int")


def test_masks(spark):
    a, b = mask(spark, [(0, 0), (0, 1), (0, 2)]), mask(spark, [(0, 1), (0, 2), (0, 3)])
    r = raster.overlap(a, b).first()
    assert (r.dice, r.iou, r.coverage_pct) == pytest.approx((2 / 3, 0.5, 200 / 3))
    r = raster.hausdorff(mask(spark, [(0, 0)]), mask(spark, [(3, 4)])).first()
    assert (r.pixel_rmse, r.hausdorff) == (5, 5)
    square = [(y, x) for y in range(3) for x in range(3)]
    assert raster.erode(mask(spark, square), 1, 8, 8).count() == 4 and raster.dilate(mask(spark, square), 1, 8, 8).count() == 16
    areas = filters.component_areas(mask(spark, [(0, 0), (1, 1), (5, 5), (2, 0), (6, 4), (6, 6)])).collect()
    assert sorted(r.area for r in areas) == [3] * 6


def test_tokens_and_text(spark):
    t = spark.createDataFrame([(x,) for x in ("|II", "a V R", "v3", "foo", " I ")], "t string")
    assert [r.l for r in t.select(chart.lead_of(F.col("t")).alias("l")).collect()] == ["II", "aVR", "V3", None, "I"]
    t = spark.createDataFrame([("A.PNG",), ("noext",)], "t string")
    assert [r.e for r in t.select(chart.extension(F.col("t")).alias("e")).collect()] == [".png", ".jpg"]
    assert spark.range(1).select(chart.keyword_hits(F.lit("ECG report, V3: x")).alias("n")).first().n == 3
    lines = spark.createDataFrame([(1, 'PROGRESS:{"type":"progress","step":"crop"}'), (2, "PROGRESS:{bad"), (3, "hello")], "seq int, line string")
    assert [(r.seq, r.step) for r in jobs.parse_lines(lines).collect()] == [(1, "crop")]


def image(spark, a):
    return spark.createDataFrame([(1, y, x, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id int, y int, x int, gray int")


def array_of(df, h, w, c="gray"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[c]
    return out


def test_filters_against_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (9, 12))
    k = np.array(filters.gaussian(5))
    p = np.pad(a.astype(float), 2, mode="reflect")
    wanted = np.array([[(p[y : y + 5, x : x + 5] * np.outer(k, k)).sum() for x in range(12)] for y in range(9)])
    assert np.allclose(array_of(filters.blur(image(spark, a), 5, 12, 9), 9, 12), wanted)
    assert (array_of(filters.resize(image(spark, a), 12, 9, 1.0), 9, 12) == a).all()
    flat = np.full((6, 6), 77)
    for kind in filters.KERNELS:
        assert (array_of(filters.resize(image(spark, flat), 6, 6, 2.0, kind), 12, 12) == 77).all()
    quad = spark.createDataFrame([(1, [(0.0, 0.0), (11.0, 0.0), (11.0, 8.0), (0.0, 8.0)])], "image_id int, corners array<struct<x:double,y:double>>")
    assert (array_of(filters.warp(image(spark, a), quad, (12, 9), (12, 9)), 9, 12) == a).all()
    turned = raster.rotate(image(spark, a), 90, 12, 9)
    assert (array_of(turned, 12, 9) == np.rot90(a, -1)).all()


def slow_dtw(a, b, w):
    n, m = len(a), len(b)
    w = max(abs(n - m), w)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[n, m] / (n + m)


floats = st.lists(st.floats(-50, 50), min_size=1, max_size=25)


@settings(max_examples=80, deadline=None)
@given(floats, floats, st.integers(1, 12))
def test_dtw(a, b, w):
    a, b = np.array(a), np.array(b)
    assert kernels.dtw(a, b, w) == pytest.approx(slow_dtw(a, b, w), abs=1e-7)
    assert kernels.dtw(a, a, w) == 0


def test_dtw_fixture_and_spectral_kernels():
    assert kernels.dtw(np.array([0, 1, 2.0]), np.array([0, 2.0]), 10) == pytest.approx(0.2)
    t = np.arange(400)
    wave = np.sin(2 * np.pi * t / 20)
    assert kernels.spacing(wave, 5, 25) == pytest.approx(20)
    assert np.allclose(kernels.sinc_resample(wave, 800)[::2], wave, atol=1e-9)
    assert np.allclose(kernels.sinc_resample(kernels.sinc_resample(wave, 1000), 400), wave, atol=1e-9)
    r = kernels.autocorrelation(wave)
    slow = np.array([(wave[: 400 - k] - wave.mean()) @ (wave[k:] - wave.mean()) for k in range(50)])
    assert np.allclose(r[:50], slow / slow[0], atol=1e-6)


def test_peak_rules():
    x = np.array([0, 3, 0, 5, 5, 5, 0, 4, 0, 1, 0.9, 1.1, 0.0])
    assert kernels.peaks(x, 0.5, 1, 0.0).tolist() == [1, 4, 7, 9, 11]
    assert kernels.peaks(x, 2, 1, 0.0).tolist() == [1, 4, 7]
    assert kernels.peaks(x, 0.5, 4, 0.0).tolist() == [4, 9] or kernels.peaks(x, 0.5, 4, 0.0).tolist() == [4, 11]
    assert kernels.peaks(x, 0.5, 1, 0.5).tolist() == [1, 4, 7, 11]
