"""The registry of queries and of the DuckDB SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chart, kernels
from ..operators import edges, filters, jobs, matching, raster, sequence, shapes, stats
from ..sources import adapters as src
from . import charts
from .oracles import ORACLES as ORACLES

RUN = ["run_id"]
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles rounded; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query
def signal_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.pair_metrics(src.sig_pair(spark, d), RUN))


@query
def zscore_population(spark, d):
    s = src.sig_user(spark, d)
    out = s.select("run_id", "idx", stats.zscore(s, RUN, 1e-12, "zero").alias("z"), stats.zscore(s, RUN, 1e-8, "centred").alias("z_centred"))
    return longs(rounded(out), "idx")


@query
def robust_z(spark, d):
    return longs(rounded(stats.robust_z(src.sig_user(spark, d), RUN).select("run_id", "idx", "z")), "idx")


@query
def invalid_to_zero(spark, d):
    e = src.table(spark, d, "events")
    bad = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return rounded(e.select("event_id", stats.invalid_to_zero(bad.cast("double")).alias("v")))


@query
def px_to_mv(spark, d):
    s = src.sig_user(spark, d, every_null=9)
    out = stats.calibrated(s, RUN, 50.0, 8.0, 10.0).select("run_id", "idx", "mv", "norm", "peak")
    return longs(rounded(out, 8), "idx")


@query
def amplitude_check(spark, d):
    leads = chart.lead_dim(spark)
    peaks = src.sig_user(spark, d).groupBy("run_id", "lead").agg((F.max("v") / 50).alias("peak"))
    names = {"click": "I", "view": "aVR", "purchase": "V2", "signup": "Rhythm"}
    peaks = peaks.withColumn("lead", chart.mapped(F.col("lead"), names, F.col("lead")))
    return rounded(stats.amplitude_check(peaks, leads, chart.OTHER_RANGE))


@query
def gap_fill_short(spark, d):
    out = sequence.fill_short_gaps(src.sig_user(spark, d, every_null=3), RUN, 2)
    return longs(rounded(out.select("run_id", "idx", "v")), "idx")


@query
def gap_fill_all(spark, d):
    return longs(rounded(sequence.fill_all_gaps(src.sig_user(spark, d, every_null=3), RUN).select("run_id", "idx", "v")), "idx")


@query
def contiguous_runs(spark, d):
    return longs(sequence.runs(src.sig_user(spark, d), RUN, F.col("v") >= 50), "start", "stop")


@query
def active_bands(spark, d):
    return longs(sequence.active_bands(src.sig_user(spark, d), RUN, 3, 50.0, 2), "start", "stop")


@query
def moving_mean_zero_pad(spark, d):
    s = src.sig_user(spark, d)
    return longs(rounded(s.select("run_id", "idx", sequence.moving_mean(RUN, 7).alias("v"))), "idx")


@query
def running_median_baseline(spark, d):
    s = src.sig_user(spark, d)
    return longs(rounded(s.select("run_id", "idx", (F.col("v") - sequence.running_median(RUN, 5)).alias("v"))), "idx")


@query
def first_difference(spark, d):
    s = src.sig_user(spark, d)
    back = F.lag("v").over(sequence.ordered(RUN))
    return longs(rounded(s.select("run_id", "idx", F.coalesce(F.col("v") - back, F.lit(0.0)).alias("diff"))), "idx")


@query
def rr_interval(spark, d):
    peaks = sequence.local_maxima(src.sig_user(spark, d), RUN, 60.0)
    gap = (F.col("idx") - F.lag("idx").over(sequence.ordered(RUN))) * 1000 / F.lit(chart.SAMPLE_HZ)
    return longs(rounded(peaks.select("run_id", "idx", gap.alias("rr_ms"))), "idx")


@query
def quadratic_peak_refine(spark, d):
    s = src.sig_user(spark, d).withColumn("v", F.col("v") - 50)
    return longs(rounded(sequence.refine_peaks(s, RUN).select("run_id", "idx", F.col("refined").alias("v"))), "idx")


@query
def refractory_peaks(spark, d):
    s = src.sig_user(spark, d)
    z = s.withColumn("v", F.round(stats.zscore(s, RUN, 1e-12, "zero"), 6))
    high = F.greatest(F.lit(0.7), F.percentile("v", F.lit(0.9)).over(sequence.Window.partitionBy("run_id"))) - 1e-6
    peaks = sequence.local_maxima(z.withColumn("high", high), RUN, -1e9).where("v >= high")
    return sequence.keep_spaced(peaks, RUN, "idx", 5).select("run_id", F.col("idx").cast("long").alias("idx"))


@query
def merge_nearby_kept(spark, d):
    return rounded(sequence.keep_spaced(src.sig_user(spark, d).select("run_id", F.col("v").alias("y")), RUN, "y", 7.5))


@query
def vertical_anchors(spark, d):
    lines = src.sig_user(spark, d).select("run_id", F.col("v").alias("y")).distinct()
    return rounded(longs(sequence.vertical_anchors(lines, RUN, 100), "top", "bottom"))


@query
def band_merge(spark, d):
    bands = sequence.runs(src.sig_user(spark, d), RUN, F.col("v") >= 50)
    return longs(sequence.merge_bands(bands, RUN, 4), "start", "stop")


@query
def resample_linear(spark, d):
    return longs(rounded(sequence.resample(src.sig_user(spark, d), RUN, 100)), "idx")


@query
def cross_correlation_lag(spark, d):
    pairs = src.sig_pair(spark, d)
    return longs(rounded(matching.best_lag(pairs, RUN, 200), 3), "lag")


def pair_peaks(spark, d):
    s = src.sig_pair(spark, d)
    return [sequence.local_maxima(s.select("run_id", "idx", F.col(c).alias("v")), RUN, 50.0) for c in ("ref", "est")]


@query
def candidate_offsets(spark, d):
    sizes = src.sig_pair(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_truth")).withColumn("n_paper", F.col("n_truth"))
    scales = [round(0.95 + 0.002 * k, 6) for k in range(51)]
    out = matching.candidate_offsets(*pair_peaks(spark, d), sizes, RUN, scales, 2.0)
    return rounded(out.groupBy("run_id", "scale").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi"), F.sum("q").alias("total")))


@query
def nearest_peak_match(spark, d):
    return longs(matching.match_peaks(*pair_peaks(spark, d), RUN, 3), "truth_idx", "paper_idx", "dist")


@query
def trimmed_gain_fit(spark, d):
    return rounded(stats.trimmed_gain_fit(src.sig_pair(spark, d), RUN), 4)


@query
def percentiles(spark, d):
    return rounded(stats.percentiles(src.sig_user(spark, d), ["lead"], [15, 50, 65, 70, 75, 80, 85, 90, 98]))


@query
def modal_baseline(spark, d):
    return longs(stats.modal_value(src.sig_user(spark, d), RUN, 101), "mode")


@query
def inlier_consensus(spark, d):
    return rounded(stats.inlier_consensus(src.sig_user(spark, d), RUN))


@query
def histogram_cdf_gamma(spark, d):
    return longs(raster.gamma_curve(src.raster(spark, d)), "gray", "out")


@query
def otsu_threshold(spark, d):
    return rounded(longs(raster.otsu(src.raster(spark, d)), "threshold"))


@query
def projection_profile(spark, d):
    out = raster.column_profile(src.raster(spark, d).where("gray >= 128"), 8)
    return rounded(longs(out, "x", "top", "bottom", "span"))


@query
def trace_mask(spark, d):
    ink = raster.trace_ink(src.raster_bgr(spark, d), 8, 8, 0.12)
    return longs(ink.select("image_id", "y", "x", "gray", "sat"), "y", "x", "gray", "sat")


@query
def grid_color_mask(spark, d):
    return raster.coloured_grid(src.raster_bgr(spark, d)).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query
def bounding_box(spark, d):
    r = src.raster(spark, d)
    images = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"))
    return longs(raster.bounding_box(images, r.where("gray >= 230"), 8, 8, 1), "x1", "y1", "x2", "y2")


@query
def weighted_centroid(spark, d):
    return rounded(longs(raster.weighted_centroid(src.raster(spark, d).where("gray >= 60")), "x"))


@query
def dilate_erode(spark, d):
    on = src.raster(spark, d).where("gray >= 100")
    big = raster.dilate(on, 1, 8, 8).groupBy("image_id").agg(F.count(F.lit(1)).alias("dilated"))
    small = raster.erode(on, 1, 8, 8).groupBy("image_id").agg(F.count(F.lit(1)).alias("eroded"))
    return big.join(small, "image_id", "left").select("image_id", "dilated", F.coalesce("eroded", F.lit(0)).cast("long").alias("eroded"))


@query
def mask_overlap(spark, d):
    return rounded(raster.overlap(*src.mask_pair(spark, d)))


@query
def mask_hausdorff(spark, d):
    return rounded(raster.hausdorff(*src.mask_pair(spark, d)))


@query
def minmax_normalize(spark, d):
    r = src.raster(spark, d).withColumn("gray", F.col("gray") % 97)
    return raster.minmax(r).groupBy("image_id").agg(F.sum("gray").alias("total"), F.sum(F.col("gray") * (F.col("y") * 8 + F.col("x"))).alias("moment"))


@query
def rotate_crop(spark, d):
    out = raster.crop(raster.rotate(src.raster(spark, d), 90, 8, 8), 1, 2, 6, 7)
    return longs(out.select("image_id", "y", "x", "gray"), "y", "x", "gray")


@query
def order_points(spark, d):
    q = shapes.order_points(src.quads(spark, d))
    out = q.select("shape_id", *[F.col(f"{c}.i").cast("long").alias(c) for c in shapes.CORNERS], shapes.angle_deviation().alias("angle_dev"))
    return rounded(out, 4)


@query
def corner_score(spark, d):
    q = shapes.order_points(src.quads(spark, d))
    score = shapes.corner_score(F.col("shape_id") % 2 == 0, 60.0, 110.0, 5.0)
    return q.select("shape_id", score.cast("long").alias("score"))


@query
def yolo_boxes(spark, d):
    b = src.boxes(spark, d).where("label = 'ecg'")
    b = b.withColumns(shapes.yolo_box("xa", "ya", "xb", "yb", "width", "height"))
    return rounded(longs(b.select("image_id", "shape", "xc", "yc", "w", "h"), "shape"), 10)


@query
def yolo_to_pixel(spark, d):
    b = src.boxes(spark, d).withColumns(shapes.yolo_box("xa", "ya", "xb", "yb", "width", "height"))
    return longs(b.withColumns(shapes.pixel_box("width", "height")).select("image_id", "shape", "px1", "py1", "px2", "py2"), "shape", "px1", "py1", "px2", "py2")


@query
def upscale_stats(spark, d):
    images = src.table(spark, d, "lineitem").select("l_linestatus", (F.col("l_quantity") * 10).cast("int").alias("width"), (F.col("l_extendedprice") / 10).cast("int").alias("height"))
    return rounded(shapes.upscale_totals(images, 2.0, "l_linestatus"), 4)


@query
def orientation_vote(spark, d):
    t = src.ocr(spark, d)
    per = t.groupBy("image_id", "angle").agg(F.max(chart.alnum_chars(F.col("text"))).alias("chars"), F.max(chart.keyword_hits(F.col("text"))).alias("keywords"))
    per = per.withColumn("score", F.col("chars") + 250 * F.col("keywords"))
    best = per.groupBy("image_id").agg(F.max_by(F.struct("angle", "score"), F.struct("score", -F.col("angle"))).alias("b"))
    # Without enough text the shape decides; every third image here stands upright.
    shape = F.when(F.col("image_id") % 3 == 0, F.lit(90)).otherwise(F.lit(0))
    angle = F.when(F.col("b.score") < 10, shape).otherwise(F.col("b.angle"))
    return best.select("image_id", angle.cast("long").alias("angle"), F.col("b.score").cast("long").alias("score"))


@query
def lead_token_match(spark, d):
    t = src.tokens(spark, d).withColumn("lead", chart.lead_of(F.col("token"))).where("lead IS NOT NULL")
    return t.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query
def progress_parse(spark, d):
    return jobs.parse_lines(src.progress_lines(spark, d)).select("seq", "type", "step", "runId")


@query
def job_state(spark, d):
    return longs(jobs.job_steps(src.progress(spark, d)), "ord")


@query
def job_attempts(spark, d):
    """Steps of each job by its last attempt only."""
    return longs(jobs.job_steps(jobs.last_attempt(src.attempts(spark, d))), "ord")


@query
def newest_jobs(spark, d):
    return jobs.newest_jobs(src.progress(spark, d))


@query
def stable_runs(spark, d):
    r = sequence.runs(src.sig_user(spark, d), RUN, F.col("v") >= 30).withColumn("n", F.col("stop") - F.col("start") + 1)
    return longs(r.where("n >= 10").select("run_id", "start", "n"), "start", "n")


@query
def dedupe_progress(spark, d):
    return jobs.first_of_each(src.progress(spark, d).where("type = 'progress'"), "run_id", "step").select("run_id", "step", "seq")


@query
def predict_argmax(spark, d):
    p = src.probs(spark, d).withColumn("p", F.round("p", 6))
    best = p.groupBy("run_id").agg(F.min(F.struct((-F.col("p")).alias("neg"), "label")).alias("b"))
    names = {"click": "Normal", "error": "HB", "purchase": "MI", "signup": "PMI"}
    label = chart.mapped(F.col("b.label"), names, F.col("b.label"))
    return best.select("run_id", label.alias("label"), chart.mapped(label, chart.CLASS_NAMES, label).alias("shown"), (-F.col("b.neg")).alias("confidence"))


@query
def missing_leads(spark, d):
    have = src.sig_user(spark, d).select("run_id", F.upper("lead").alias("lead")).distinct()
    wanted = have.select("run_id").distinct().withColumn("lead", F.explode(F.array(*[F.lit(x) for x in ("CLICK", "VIEW", "PURCHASE", "SIGNUP", "ERROR", "RHYTHM")])))
    lost = wanted.join(have, ["run_id", "lead"], "left_anti")
    return lost.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("lead")), ",").alias("missing"))


@query
def content_type(spark, d):
    ext = chart.extension(F.regexp_replace("url", r"[?#].*$", ""))
    return src.table(spark, d, "pages").select("page_id", ext.alias("ext"), chart.mapped(ext, chart.CONTENT_TYPES, F.lit("application/octet-stream")).alias("content_type"))


@query
def report_union_columns(spark, d):
    m = stats.pair_metrics(src.sig_pair(spark, d), RUN)
    a, b = m.where("run_id % 2 = 0").select("run_id", "rmse", "mae"), m.where("run_id % 2 = 1").select("run_id", "snr", "mae")
    both = a.unionByName(b, allowMissingColumns=True)
    return rounded(both.select("run_id", *sorted(c for c in both.columns if c != "run_id")))


def packed(s: DataFrame, value: str):
    """The samples of each group as one array, in order."""
    pair = F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v"))))
    return F.transform(pair, lambda r: r["v"])


@query
def dtw_distance(spark, d):
    pairs = src.sig_pair(spark, d)
    both = pairs.groupBy("run_id").agg(packed(pairs, "ref").alias("ref"), packed(pairs, "est").alias("est"))
    return rounded(both.select("run_id", kernels.dtw_distance(F.col("ref"), F.col("est")).alias("dtw")))


@query
def sinc_resample(spark, d):
    s = src.sig_user(spark, d)
    both = s.groupBy("run_id").agg(packed(s, "v").alias("v"))
    return both.select("run_id", F.posexplode(kernels.resampled(F.col("v"), 100)).alias("idx", "v"))


@query
def peak_positions(spark, d):
    s = src.sig_user(spark, d)
    both = s.groupBy("run_id").agg(packed(s, "v").alias("v"))
    return both.select("run_id", F.explode(kernels.peak_positions(F.col("v"), 50.0, 4, 5.0)).alias("idx"))


@query
def grid_period(spark, d):
    s = src.sig_user(spark, d)
    both = s.groupBy("run_id").agg(packed(s, "v").alias("v"))
    return both.select("run_id", kernels.grid_period(F.col("v")).alias("px_per_mm"), kernels.dominant_spacing(F.col("v")).alias("spacing"))


@query
def adaptive_threshold(spark, d):
    return filters.adaptive_threshold(src.raster(spark, d), 5, 2.0, 8, 8)


@query
def resize_bicubic(spark, d):
    return filters.resize(src.raster(spark, d), 8, 8, 2.0)


@query
def component_areas(spark, d):
    return filters.component_areas(src.raster(spark, d).where("gray >= 160"))


@query
def hough_votes(spark, d):
    votes = filters.hough_votes(src.raster(spark, d).where("gray >= 200"))
    return votes.groupBy("image_id").agg(F.max_by(F.struct("theta", "rho", "votes"), F.struct("votes", -F.col("theta"), -F.col("rho"))).alias("b")).select("image_id", "b.*")


@query
def local_contrast(spark, d):
    return edges.local_contrast(src.raster(spark, d), 8, 8, 2.0, 2)


@query
def edge_pixels(spark, d):
    return edges.edges(src.raster(spark, d), 8, 8, 200, 500)


@query
def median_blur(spark, d):
    return longs(edges.median_blur(src.raster(spark, d), 5, 8, 8), "y", "x", "gray")


@query
def background_removed(spark, d):
    r = src.raster(spark, d)
    return raster.minmax(edges.without_background(r, filters.blur(r, 5, 8, 8), edges.median_blur(r, 5, 8, 8)))


@query
def skeleton(spark, d):
    return edges.skeleton(src.raster(spark, d).where("gray >= 100"))


@query
def mask_outlines(spark, d):
    return edges.outlines(src.raster(spark, d).where("gray >= 160"))


@query
def simplified_outline(spark, d):
    shapes_ = edges.outlines(src.raster(spark, d).where("gray >= 100"))
    return shapes_.select("image_id", "label", edges.simplified_outline(F.col("hull"), 0.05).alias("corners"))


QUERIES.update(charts.QUERIES)
ORACLES.update(charts.ORACLES)
