"""Alignment of an extracted signal with its truth: time scale and offset, then gain and offset, then error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.store import dropped, stored
from . import matching, sequence, stats


def packed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the values of each signal as one array, in order."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", "v")))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda s: s["v"]).alias(name))


def anchor_peaks(features: DataFrame, name: str, hz: float) -> DataFrame:
    """Peaks of an array column by its own percentiles: 70th as height, 85th less 50th (0.25 at least) as prominence."""
    order = F.array_sort(name)
    last = F.size(order) - 1

    def at(p: float):
        spot = last * p
        low = F.element_at(order, (F.floor(spot) + 1).cast("int"))
        return low + (F.element_at(order, (F.ceil(spot) + 1).cast("int")) - low) * (spot - F.floor(spot))

    peaks = kernels.peak_positions_by(F.col(name), at(0.7), max(1, round(0.25 * hz)), F.greatest(F.lit(0.25), at(0.85) - at(0.5)))
    return features.withColumn(f"{name}_peaks", peaks)


def horizontal(truth: DataFrame, paper: DataFrame, keys: list[str], hz: float) -> DataFrame:
    """(keys, scale, offset, score, corr, anchor, matches): the best time scale and offset of each pair of signals.

    truth, paper: (keys, idx, v), baseline-corrected.  All scales and offsets of a pair are
    scored where its signals lie; the first best one in the order of scale and offset wins.
    """
    sides = []
    for rows, name in ((truth, "truth"), (paper, "paper")):
        feature = packed(sequence.alignment_feature(rows, keys, hz), keys, name)
        sides.append(anchor_peaks(feature, name, hz))
    best = kernels.best_alignment(*[F.col(c) for c in ("truth", "paper", "truth_peaks", "paper_peaks")], hz)
    return sides[0].join(sides[1], keys).select(*keys, best.alias("b")).select(*keys, "b.*")


def laid_over(truth: DataFrame, paper: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, ref, est): the paper signal interpolated at each sample of the truth, null outside it."""
    arrays = packed(paper, keys, "paper").join(fit.select(*keys, "scale", "offset"), keys)
    at = (F.col("idx") - F.col("offset")) / F.col("scale")
    rows = truth.join(arrays, keys).withColumn("at", at)
    inside = (F.col("at") >= 0) & (F.col("at") <= F.size("paper") - 1)
    low = F.get("paper", F.floor("at").cast("int"))
    est = F.when(inside, low + (F.get("paper", F.ceil("at").cast("int")) - low) * (F.col("at") - F.floor("at")))
    return rows.select(*keys, "idx", F.col("v").alias("ref"), est.alias("est"))


def aligned_metrics(pairs: DataFrame, gains: DataFrame, keys: list[str], active: DataFrame | None = None) -> DataFrame:
    """Error metrics of the fitted paper signal where it overlaps the truth; with `active` (keys, idx) only there, if ten or more."""
    own = pairs.where("est IS NOT NULL").join(gains.select(*keys, "gain", F.col("offset").alias("v_offset")), keys)
    own = own.withColumn("est", F.col("gain") * F.col("est") + F.col("v_offset"))
    if active is not None:
        own = own.join(active.withColumn("on", F.lit(True)), [*keys, "idx"], "left")
        own = own.withColumn("n_on", F.count("on").over(Window.partitionBy(*keys))).where((F.col("n_on") < 10) | F.col("on"))
    return stats.pair_metrics(own, keys)


def at_rate(rows: DataFrame, keys: list[str], source_hz: float, target_hz: float) -> DataFrame:
    """(keys, idx, v) at another rate, by polyphase filtering; gaps count as zero.  Equal rates change nothing."""
    if abs(source_hz - target_hz) < 1e-6:
        return rows
    own = packed(rows, keys, "v")
    return own.select(*keys, F.posexplode(kernels.polyphase_resampled(F.col("v"), F.lit(source_hz), F.lit(target_hz))).alias("idx", "v"))


def align(truth: DataFrame, paper: DataFrame, keys: list[str], hz: float, paper_hz: float | None = None) -> DataFrame:
    """One row for each pair of signals: time scale and offset (samples and ms), scores, gain, offset and error metrics.

    truth, paper: (keys, idx, v) at hz and paper_hz (the same if not given); gaps in v are filled.
    Samples are counted at hz.  Pairs of which one side is missing have no row.
    """
    paper = at_rate(paper, keys, paper_hz or hz, hz)
    # Each step is needed more than once by those after it, so it is written.
    truth, paper = (stored(sequence.baseline_corrected(df, keys, hz)) for df in (truth, paper))
    fit = stored(horizontal(truth, paper, keys, hz))
    pairs = stored(laid_over(truth, paper, fit, keys))
    gains = stored(stats.trimmed_gain_fit(pairs.where("est IS NOT NULL"), keys))
    dropped(truth, paper)
    errors = aligned_metrics(pairs, gains, keys)
    out = fit.withColumnRenamed("offset", "offset_samples").join(gains.withColumnRenamed("offset", "v_offset"), keys, "left").join(errors, keys, "left")
    return out.withColumn("offset_ms", 1000 * F.col("offset_samples") / hz)


def summary(aligned: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """The rounded report row of each pair, halves to even."""
    cols = ("scale", "offset_ms", "corr", "anchor", "gain", "v_offset", "rmse", "mae", "pearson", "snr")
    return aligned.select(*keys, "matches", *[F.bround(c, digits).alias(c) for c in cols])


def validate(reference: DataFrame, estimate: DataFrame, keys: list[str], hz: float) -> DataFrame:
    """The report of each pair of signals: error metrics, time warping distance, lag, and errors of beats.

    reference, estimate: (keys, idx, v).  Both are cut to the shorter one; then the estimate is moved
    by the lag of the highest cross-correlation and both are cut to what overlaps.  Beats are peaks of
    the standardised signal above 0.7 and its 90th percentile, 0.22 s apart.  Pairs of which one side
    is missing have no row; metrics that are undefined (constant signals, no beats) are null.  Where
    all lags are equal, as for a constant signal, the least one counts.
    """
    arrays = packed(reference, keys, "a").join(packed(estimate, keys, "b"), keys)
    n = F.least(F.size("a"), F.size("b"))
    arrays = arrays.select(*keys, F.slice("a", 1, n).alias("a"), F.slice("b", 1, n).alias("b")).withColumn("lag", kernels.lag_between(F.col("a"), F.col("b")))
    lag, size = F.col("lag"), F.size("a") - F.abs("lag")
    start = lambda c: F.greatest(c, F.lit(0)) + 1
    cut = stored(arrays.select(*keys, "lag", F.slice("a", start(lag), size).alias("a"), F.slice("b", start(-lag), size).alias("b")))
    pairs = cut.select(*keys, F.posexplode(F.arrays_zip("a", "b")).alias("idx", "s")).select(*keys, "idx", F.col("s.a").alias("ref"), F.col("s.b").alias("est"))
    metrics = stats.pair_metrics(pairs, keys)
    warped = cut.select(*keys, "lag", (1000.0 * F.col("lag") / hz).alias("lag_ms"), kernels.dtw_distance(F.col("a"), F.col("b")).alias("dtw"))
    beats = [sequence.beat_peaks(pairs.select(*keys, "idx", F.col(c).alias("v")), keys, hz) for c in ("ref", "est")]
    errors = matching.beat_errors(*beats, keys, hz).withColumnRenamed("n", "n_beats")
    return metrics.join(warped, keys).join(errors, keys, "left")
