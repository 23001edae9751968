"""Ordered operators over (keys, idx, v): runs, gaps, smoothing, peaks, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import robust_z


def ordered(keys: list[str], by: str = "idx"):
    return Window.partitionBy(*keys).orderBy(by)


def runs(df: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """Inclusive runs (start, stop) of rows that pass the test."""
    hits = df.where(test).withColumn("island", F.col("idx") - F.row_number().over(ordered(keys)))
    return hits.groupBy(*keys, "island").agg(F.min("idx").alias("start"), F.max("idx").alias("stop")).drop("island")


def moving_mean(keys: list[str], taps: int) -> Column:
    """Zero-padded moving mean: the sum is divided by all taps at the edges too."""
    return F.sum("v").over(ordered(keys).rowsBetween(-(taps // 2), taps // 2)) / taps


def active_bands(df: DataFrame, keys: list[str], taps: int, threshold: float, min_height: int) -> DataFrame:
    """Half-open bands [start, stop) where the smoothed projection exceeds the threshold."""
    smooth = df.withColumn("smooth", moving_mean(keys, taps))
    bands = runs(smooth, keys, F.col("smooth") > threshold).withColumn("stop", F.col("stop") + 1)
    return bands.where(F.col("stop") - F.col("start") >= min_height)


def running_median(keys: list[str], taps: int) -> Column:
    """Median over an odd window, the edges repeated."""
    w, all_ = ordered(keys), Window.partitionBy(*keys)
    first, last = F.min_by("v", "idx").over(all_), F.max_by("v", "idx").over(all_)
    half = taps // 2
    before = [F.coalesce(F.lag("v", k).over(w), first) for k in range(half, 0, -1)]
    after = [F.coalesce(F.lead("v", k).over(w), last) for k in range(1, half + 1)]
    return F.get(F.array_sort(F.array(*before, F.col("v"), *after)), F.lit(half))


def with_neighbours(df: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest non-null values at both sides: pi, pv and ni, nv."""
    back = ordered(keys).rowsBetween(Window.unboundedPreceding, -1)
    ahead = ordered(keys).rowsBetween(1, Window.unboundedFollowing)
    at = F.when(F.col("v").isNotNull(), F.col("idx"))
    return df.withColumns(
        {
            "pi": F.last(at, True).over(back), "pv": F.last("v", True).over(back),
            "ni": F.first(at, True).over(ahead), "nv": F.first("v", True).over(ahead),
        }
    )


def blend() -> Column:
    return F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("idx") - F.col("pi")) / (F.col("ni") - F.col("pi"))


def fill_short_gaps(df: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """Linear fill of inner gaps of up to max_gap nulls; edges stay null."""
    near = with_neighbours(df, keys)
    short = F.col("ni") - F.col("pi") - 1 <= max_gap
    return near.withColumn("v", F.coalesce("v", F.when(short, blend()))).drop("pi", "pv", "ni", "nv")


def fill_all_gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Linear fill inside, the nearest value at the edges, zero where nothing is known."""
    near = with_neighbours(df, keys)
    return near.withColumn("v", F.coalesce("v", blend(), "pv", "nv", F.lit(0.0))).drop("pi", "pv", "ni", "nv")


def refine_peaks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Parabolic refinement of strict local extremes of |v|.

    A refined value only grows in magnitude, so its neighbour can never qualify too and
    the neighbours used are always unrefined ones.
    """
    w = ordered(keys)
    a, b, c = F.lag("v").over(w), F.col("v"), F.lead("v").over(w)
    bend = a - 2 * b + c
    shift = F.try_divide(0.5 * (a - c), F.nullif(bend, F.lit(0.0)))
    peak = (F.abs(b) > F.abs(a)) & (F.abs(b) > F.abs(c)) & (F.abs(bend) >= 1e-6) & (F.abs(shift) <= 0.5)
    return df.withColumn("refined", F.when(peak, b - 0.25 * (a - c) * shift).otherwise(b))


def local_maxima(df: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    w = ordered(keys)
    near = df.withColumn("a", F.lag("v").over(w)).withColumn("c", F.lead("v").over(w))
    return near.where((F.col("v") >= F.col("a")) & (F.col("v") >= F.col("c")) & (F.col("v") >= threshold)).drop("a", "c")


def keep_spaced(df: DataFrame, keys: list[str], order: str, least: float) -> DataFrame:
    """Values in order, each kept if it is at least `least` after the last kept one (a fold)."""
    values = F.array_sort(F.collect_list(F.col(order).cast("double")))
    none = F.array_repeat(F.lit(0.0), 0)
    far = lambda kept, x: (F.size(kept) == 0) | (x - F.element_at(kept, -1) >= least)
    step = lambda kept, x: F.when(far(kept, x), F.concat(kept, F.array(x))).otherwise(kept)
    grouped = df.groupBy(*keys).agg(values.alias("all"))
    kept = F.aggregate("all", none, lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).otherwise(step(kept, x)))
    return grouped.select(*keys, F.explode(kept).alias(order))


def beat_peaks(df: DataFrame, keys: list[str], hz: float) -> DataFrame:
    """(keys, idx, v) of beats: local maxima of the standardised signal above 0.7 and its 90th percentile, 0.22 s apart.

    The first of close ones is kept; a constant signal has none.
    """
    from . import stats

    z = df.select(*keys, "idx", F.col("v").alias("raw"), "v").withColumn("v", F.round(stats.zscore(df, keys, 1e-12, "zero"), 9))
    high = F.greatest(F.lit(0.7), F.percentile("v", F.lit(0.9)).over(Window.partitionBy(*keys)))
    tops = local_maxima(z.withColumn("high", high), keys, 0.7).where("v >= high - 1e-9")
    kept = keep_spaced(tops, keys, "idx", max(1, int(0.22 * hz))).withColumn("idx", F.col("idx").cast(dict(df.dtypes)["idx"]))
    return kept.join(df.select(*keys, "idx", "v"), [*keys, "idx"])


def vertical_anchors(baselines: DataFrame, keys: list[str], height: int, share: float = 0.7) -> DataFrame:
    """(y, top, bottom): rows within 0.7 of the distance to the nearer neighbour; null where there is none."""
    w = ordered(keys, "y")
    near = F.least(F.col("y") - F.lag("y").over(w), F.lead("y").over(w) - F.col("y"))
    top, bottom = (F.col("y") - share * near).cast("int"), (F.col("y") + share * near).cast("int")
    known = near.isNotNull()
    return baselines.select(
        *keys, "y", F.when(known, F.greatest(F.lit(0), top)).alias("top"), F.when(known, F.least(F.lit(height), bottom)).alias("bottom")
    )


def merge_bands(bands: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """Merges bands over the smallest gaps until at most `most` are left.

    Merging leaves the other gaps as they are, so the smallest n - most go at once.
    """
    w, all_ = ordered(keys, "start"), Window.partitionBy(*keys)
    gaps = bands.withColumn("gap", F.col("start") - F.lag("stop").over(w)).withColumn("n", F.count(F.lit(1)).over(all_))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("gap").asc_nulls_last(), "start"))
    gaps = gaps.withColumn("joined", F.col("gap").isNotNull() & (place <= F.col("n") - most))
    part = F.sum((~F.col("joined")).cast("int")).over(ordered(keys, "start"))
    return gaps.withColumn("part", part).groupBy(*keys, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")


def resample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Linear resampling of each signal to n points over the same span."""
    size = df.groupBy(*keys).agg(F.max("idx").alias("last"))
    spine = size.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"), "last")
    at = F.col("place") * F.col("last") / F.lit(float(max(1, n - 1)))
    spine = spine.withColumn("spot", at).withColumn("i0", F.floor("spot")).withColumn("i1", F.ceil("spot"))
    low, high = (df.select(*keys, F.col("idx").alias(i), F.col("v").alias(v)) for i, v in (("i0", "v0"), ("i1", "v1")))
    # Spark takes the spine, made from one row for each signal, for as small as those: it must not be broadcast.
    both = spine.hint("merge").join(low, [*keys, "i0"]).hint("merge").join(high.hint("merge"), [*keys, "i1"])
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("spot") - F.col("i0"))
    return both.select(*keys, F.col("place").alias("idx"), value.alias("v"))


def edge_mean(keys: list[str], taps: int, value: str = "v") -> Column:
    """Moving mean with the edges repeated; an even window reaches one further back than ahead."""
    w, all_ = ordered(keys), Window.partitionBy(*keys)
    left, right = taps // 2, taps - taps // 2 - 1
    place = F.row_number().over(w) - 1
    before = F.greatest(F.lit(0), left - place)
    after = F.greatest(F.lit(0), right - (F.count(F.lit(1)).over(all_) - 1 - place))
    first, last = F.min_by(value, "idx").over(all_), F.max_by(value, "idx").over(all_)
    return (F.sum(value).over(w.rowsBetween(-left, right)) + before * first + after * last) / taps


def baseline_corrected(df: DataFrame, keys: list[str], hz: float) -> DataFrame:
    """Gaps filled and the running median over 200 ms taken off."""
    taps = max(3, round(0.2 * hz))
    full = fill_all_gaps(df, keys)
    return full.withColumn("v", F.col("v") - running_median(keys, taps + 1 - taps % 2))


def alignment_feature(df: DataFrame, keys: list[str], hz: float) -> DataFrame:
    """Robust energy of a baseline-corrected signal: what two recordings are laid over each other by."""
    z = robust_z(df, keys).withColumn("z", F.least(F.greatest("z", F.lit(-6.0)), F.lit(6.0)))
    step = F.coalesce(F.abs(F.col("z") - F.lag("z").over(ordered(keys))), F.lit(0.0))
    energy = z.withColumn("v", F.abs("z") + 0.8 * step)
    smooth = energy.withColumn("v", edge_mean(keys, max(3, round(0.045 * hz))))
    return robust_z(smooth.drop("z"), keys).withColumn("v", F.col("z")).drop("z")


def highest(peaks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, idx, ord): the n highest peaks of each group that has as many, numbered by place."""
    high = Window.partitionBy(*keys).orderBy(F.desc("v"), "idx")
    own = peaks.withColumn("place", F.row_number().over(high)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return own.where((F.col("n") >= n) & (F.col("place") <= n)).select(*keys, "idx", (F.row_number().over(ordered(keys)) - 1).alias("ord"))


def stacked(samples: DataFrame, keys: list[str], leads: list[str]) -> DataFrame:
    """(keys, idx, leads array): samples (keys, lead, idx, v) of all leads side by side, zero where one is missing."""
    values = samples.groupBy(*keys, "idx").agg(F.map_from_entries(F.collect_list(F.struct("lead", "v"))).alias("m"))
    return values.select(*keys, "idx", F.array(*[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0.0)) for n in leads]).alias("leads"))
