"""Classification of recordings by a given model, one prediction for each recording."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chart, kernels
from ..functions.held import held
from ..operators import stats

POINTS = 5000


def preprocessed(signals: DataFrame, keys: list[str], points: int = POINTS) -> DataFrame:
    """(keys, lead, v): invalid values to zero, resampled to `points`, population z-score (only centred if flat)."""
    clean = signals.select(*keys, chart.lead_alias(F.col("lead")).alias("lead"), F.transform("v", lambda x: stats.invalid_to_zero(x.cast("double"))).alias("v"))
    even = clean.withColumn("v", kernels.resampled(F.col("v"), points))
    n = F.lit(float(points))
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x))
    mean = total(lambda x: x) / n
    own = even.withColumn("mean", mean)
    own = own.withColumn("std", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n))
    scale = F.when(F.col("std") < 1e-8, F.lit(1.0)).otherwise(F.col("std"))
    return own.select(*keys, "lead", F.transform("v", lambda x: (x - F.col("mean")) / scale).alias("v"))


def predict(signals: DataFrame, keys: list[str], model: Callable[[], Callable[[np.ndarray], np.ndarray]], classes: list[str], leads: list[str]) -> DataFrame:
    """(keys, missing, label, confidence, probabilities): what the model says of each recording.

    signals: (keys, lead, v array).  model makes, once in each worker, a function from an
    array (recordings, points, leads) to one (recordings, classes); a wrong number of
    classes is an error.  A recording without all leads gets their names in `missing` and
    no prediction.  The first of equally probable classes is taken.
    """
    own = preprocessed(signals, keys).where(F.col("lead").isin(leads))
    packed = own.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lead", "v"))).alias("m"))
    missing = F.filter(F.array(*[F.lit(n) for n in leads]), lambda n: ~F.map_contains_key("m", n))
    rows = packed.withColumn("missing", F.array_join(missing, ","))
    stacked = F.when(F.col("missing") == "", F.flatten(F.array(*[F.try_element_at("m", F.lit(n)) for n in leads])))

    key = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def scores(batches: pd.Series) -> pd.Series:
        judge = held(key, model)
        out: list = [None] * len(batches)
        for i, flat in enumerate(batches):
            if flat is not None:
                x = np.asarray(flat, dtype=np.float32).reshape(len(leads), -1).T[None]
                p = np.asarray(judge(x))[0]
                if len(p) != len(classes):
                    raise ValueError(f"the model gave {len(p)} probabilities for {len(classes)} classes")
                out[i] = p.astype(float).tolist()
        return pd.Series(out)

    done = rows.withColumn("p", scores(stacked))
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_position("p", F.array_max("p")).cast("int")
    return done.select(*keys, "missing", F.when(F.col("p").isNotNull(), F.element_at(names, best)).alias("label"), F.array_max("p").alias("confidence"), F.map_from_arrays(names, "p").alias("probabilities"))


def detected(images: DataFrame, detect: Callable[[bytes], list[tuple]]) -> DataFrame:
    """(image_id, label, x1, y1, x2, y2): boxes that a given detector finds in the bytes of each image."""

    @F.pandas_udf("array<struct<label:string,x1:int,y1:int,x2:int,y2:int>>")
    def run(content: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("label", "x1", "y1", "x2", "y2"), b)) for b in detect(c)] for c in content])

    return images.select("image_id", F.explode(run("content")).alias("b")).select("image_id", "b.*")


def recognised(images: DataFrame, read: Callable[[bytes], list[tuple]]) -> DataFrame:
    """(image_id, text, conf, left, width): words that a given reader finds; an image on which it times out gives none."""

    @F.pandas_udf("array<struct<text:string,conf:int,left:int,width:int>>")
    def run(content: pd.Series) -> pd.Series:
        out = []
        for c in content:
            try:
                out.append([dict(zip(("text", "conf", "left", "width"), w)) for w in read(c)])
            except TimeoutError:
                out.append([])
        return pd.Series(out)

    return images.select("image_id", F.explode(run("content")).alias("w")).select("image_id", "w.*")
