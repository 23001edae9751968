"""Normalisation, error metrics and robust statistics of signals, by groups of key columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def invalid_to_zero(v: Column) -> Column:
    return F.when(finite(v), v).otherwise(F.lit(0.0))


def clip(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def zscore(df: DataFrame, keys: list[str], least_std: float, flat: str) -> Column:
    """Population z-score; where the deviation is below least_std, zero or only centred values."""
    w = Window.partitionBy(*keys)
    mean, std = F.avg("v").over(w), F.stddev_pop("v").over(w)
    centred = F.col("v") - mean
    return F.when(std < least_std, F.lit(0.0) if flat == "zero" else centred).otherwise(centred / std)


def robust_z(df: DataFrame, keys: list[str], eps: float = 1e-9) -> DataFrame:
    """(v - median) / (1.4826 MAD); the deviation where the MAD is too small."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("med", F.median("v").over(w)).withColumn("dev", F.abs(F.col("v") - F.col("med")))
    scale = 1.4826 * F.median("dev").over(w)
    scale = F.when(scale < eps, F.stddev_pop("v").over(w) + eps).otherwise(scale)
    return df.withColumn("z", (F.col("v") - F.col("med")) / scale).drop("med", "dev")


def snr_db(signal: Column, noise: Column) -> Column:
    """10 log10 of a power ratio; +inf where the noise vanishes."""
    return F.when(noise <= 1e-12, F.lit(float("inf"))).otherwise(10 * F.log10(F.nullif(signal, F.lit(0.0)) / F.greatest(noise, F.lit(1e-12))))


def pair_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Error metrics of est against ref: n, pearson (null when undefined), rmse, mae, prd, snr."""
    d = F.col("est") - F.col("ref")
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("ref", "est").alias("c"), F.stddev_pop("ref").alias("sr"), F.stddev_pop("est").alias("se"),
        F.sum(d * d).alias("dd"), F.avg(F.abs(d)).alias("mae"), F.sum(F.col("ref") * F.col("ref")).alias("rr"),
    )
    return sums.select(
        *keys, "n",
        F.when((F.col("n") > 1) & (F.col("sr") > 1e-12) & (F.col("se") > 1e-12), F.col("c") / F.nullif(F.col("sr") * F.col("se"), F.lit(0.0))).alias("pearson"),
        F.sqrt(F.col("dd") / F.col("n")).alias("rmse"), "mae",
        (100 * F.sqrt(F.col("dd") / F.nullif(F.col("rr"), F.lit(0.0)))).alias("prd"),
        snr_db(F.col("rr"), F.col("dd")).alias("snr"),
    )


def percentiles(df: DataFrame, keys: list[str], points: list[int]) -> DataFrame:
    """Linearly interpolated percentiles p<point> of v."""
    return df.groupBy(*keys).agg(*[F.percentile("v", F.lit(p / 100)).alias(f"p{p}") for p in points])


def modal_value(df: DataFrame, keys: list[str], height: int, taps: int = 7) -> DataFrame:
    """The most frequent whole value below height after a moving sum over taps; the least wins ties."""
    half = taps // 2
    bins = df.where(F.col("v").isNotNull()).groupBy(*keys, F.rint("v").cast("int").alias("bin")).count().where(f"bin >= 0 AND bin < {height}")
    near = bins.select(*keys, "count", F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - half), F.least(F.lit(height - 1), F.col("bin") + half))).alias("at"))
    sums = near.groupBy(*keys, "at").agg(F.sum("count").alias("n"))
    return sums.groupBy(*keys).agg(F.max_by("at", F.struct("n", -F.col("at"))).alias("mode"))


def inlier_consensus(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median of the values near the median, their spread, and a confidence of both."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("med", F.median("v").over(w)).withColumn("dev", F.abs(F.col("v") - F.col("med")))
    df = df.withColumn("mad", F.median("dev").over(w))
    near = F.col("dev") <= F.greatest(F.lit(1.5), 2.5 * F.col("mad")) + 1e-9
    out = df.where(near).groupBy(*keys).agg(F.median("v").alias("centre"), F.stddev_pop("v").alias("spread"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("confidence", clip(F.least(F.lit(1.0), F.col("n") / 6.0) / (1 + F.col("spread")), 0.0, 1.0))


def calibrated(df: DataFrame, keys: list[str], baseline: float, px_per_mm: float, mm_per_mv: float) -> DataFrame:
    """Pixel rows v as mv (a missing pixel is 0), peak-normalised norm, and the peak."""
    mv = F.coalesce((F.lit(baseline) - F.col("v")) / px_per_mm / mm_per_mv, F.lit(0.0))
    df = df.withColumn("mv", mv).withColumn("peak", F.max(F.abs("mv")).over(Window.partitionBy(*keys)))
    return df.withColumn("norm", F.coalesce(F.col("mv") / F.nullif("peak", F.lit(0.0)), F.lit(0.0)))


def amplitude_check(peaks: DataFrame, leads: DataFrame, other: tuple[float, float]) -> DataFrame:
    """Compares twice the peak with the lead's plausible range: issues (text) and score."""
    p2p = 2 * F.col("peak")
    lo, hi = F.coalesce("lo_mv", F.lit(other[0])), F.coalesce("hi_mv", F.lit(other[1]))
    low = F.when(p2p < lo, F.lit("low"))
    high = F.when(p2p > hi, F.lit("high"))
    out = peaks.join(leads.select("lead", "lo_mv", "hi_mv"), "lead", "left")
    out = out.withColumn("issues", F.concat_ws(",", low, high)).drop("lo_mv", "hi_mv")
    return out.withColumn("score", F.when(F.col("issues") == "", F.lit(1.0)).otherwise(F.lit(0.75)))


def trimmed_gain_fit(pairs: DataFrame, keys: list[str], min_rows: int = 10, min_active: int = 20, rounds: int = 4) -> DataFrame:
    """ref = gain * est + offset on large deflections only, refitted without the largest residuals.

    A row is active if both deviations from the medians lie between the 65th and 98th
    percentiles; with fewer than min_active of those, if either is above the 75th.
    Each round keeps the residuals up to the 80th percentile.  Below min_rows rows, or
    active rows, gain 1 and offset 0.  All rounds share one partitioning.
    """
    w = Window.partitionBy(*keys)
    df = pairs.withColumn("mx", F.median("est").over(w)).withColumn("my", F.median("ref").over(w))
    df = df.withColumn("ax", F.abs(F.col("est") - F.col("mx"))).withColumn("ay", F.abs(F.col("ref") - F.col("my")))
    at = lambda c, p: F.percentile(c, F.lit(p)).over(w)
    for c in ("ax", "ay"):
        df = df.withColumns({f"{c}{int(100 * p)}": at(c, p) for p in (0.65, 0.75, 0.98)})
    slack = 1e-9
    both = reduce(lambda a, b: a & b, [(F.col(c) >= F.col(f"{c}65") - slack) & (F.col(c) <= F.col(f"{c}98") + slack) for c in ("ax", "ay")])
    either = reduce(lambda a, b: a | b, [F.col(c) >= F.col(f"{c}75") - slack for c in ("ax", "ay")])
    df = df.withColumn("both", both).withColumn("enough", F.sum(F.col("both").cast("int")).over(w) >= min_active)
    df = df.withColumn("active", F.when(F.col("enough"), F.col("both")).otherwise(either))
    df = df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("n_active", F.sum(F.col("active").cast("int")).over(w))
    df = df.where("active").withColumn("keep", F.lit(True))
    for _ in range(rounds):
        y, x = F.when(F.col("keep"), F.col("ref")), F.when(F.col("keep"), F.col("est"))
        df = df.withColumn("gain", F.regr_slope(y, x).over(w)).withColumn("offset", F.regr_intercept(y, x).over(w))
        df = df.withColumn("res", F.abs(F.col("ref") - (F.col("gain") * F.col("est") + F.col("offset"))))
        df = df.withColumn("keep", F.col("res") <= F.greatest(F.percentile("res", F.lit(0.8)).over(w), F.lit(1e-9)) + slack)
    fit = df.groupBy(*keys).agg(
        F.first("gain").alias("gain"), F.first("offset").alias("offset"), F.sum(F.col("keep").cast("long")).alias("n_kept"),
        F.first("n").alias("n"), F.first("n_active").alias("n_active"),
    )
    poor = (F.col("n") < min_rows) | (F.col("n_active") < min_rows)
    return fit.select(*keys, F.when(poor, F.lit(1.0)).otherwise(F.col("gain")).alias("gain"), F.when(poor, F.lit(0.0)).otherwise(F.col("offset")).alias("offset"), "n_kept")


def with_gain(v: Column, gain: float, offset: float) -> Column:
    return v * gain + offset


def sample_ms(idx: Column, hz: float) -> Column:
    return 1000.0 * idx / F.lit(hz)


def amplitude_issues(peaks: DataFrame, leads: DataFrame, other: tuple[float, float]) -> DataFrame:
    """(keys of peaks, lead, issue): the implausible amplitude in words, empty if there is none."""
    out = peaks.join(leads.select("lead", "lo_mv", "hi_mv"), "lead", "left")
    p2p, lo, hi = 2 * F.col("peak"), F.coalesce("lo_mv", F.lit(other[0])), F.coalesce("hi_mv", F.lit(other[1]))
    text = lambda word, sign, bound: F.format_string(f"amplitude too {word} (%.3f mV {sign} %.2f mV)", p2p, bound)
    issue = F.when(p2p < lo, text("low", "<", lo)).when(p2p > hi, text("high", ">", hi)).otherwise(F.lit(""))
    return out.withColumn("issue", issue).drop("peak", "lo_mv", "hi_mv")


def batch_counts(items: DataFrame, done: Column, size: Column, *by: str) -> DataFrame:
    """Items, successes, failures and summed sizes by group, with a total row."""
    return items.rollup(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("success"), F.count_if(~done).alias("failed"), F.sum(size).alias("pixels"))
