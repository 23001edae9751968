import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwave.llm import negatives
from chartwave.llm.queries import op11_hard_negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, score int, cell string"


def brute(rows, anchors, positives=5, k=10, low=30, high=90, scale=256):
    kept = {}
    for i, v, label in rows:
        if None in (i, label) or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i] = min(kept.get(i, (label, [1 << 60])), (label, [math.floor(scale * x) for x in v]))
    out = []
    for i in filter(anchors, kept):
        label, v = kept[i]
        score = {j: sum(x * y for x, y in zip(v, w)) for j, (_, w) in kept.items() if j != i and len(w) == len(v)}
        order = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in order if kept[j][0] == label][:positives]:
            hard = [j for j in order if kept[j][0] != label and low * score[p] <= 100 * score[j] <= high * score[p]][:k]
            out += [(i, p, r + 1, j, score[p], score[j]) for r, j in enumerate(hard)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = [(i, v, (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows]
    got = op11_hard_negatives(spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    wanted = brute(rows, lambda i: i % 100 == 0)
    assert result(got) == wanted and wanted


@pytest.mark.parametrize("small", [False, True])
def test_groups_ties_and_rounds(spark, monkeypatch, small):
    if small:
        for name, value in (("SAMPLE_ROWS", 200), ("BLOCK_ROWS", 16), ("PACK_QUERIES", 3), ("SALT_BLOCKS", 2), ("FIRST_RINGS", 2), ("GROWTH", 2), ("DEALT_QUERIES", 7)):
            monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(scale=0.3, size=8)).round(2).tolist(), i % 5) for i in range(700)]
    rows += [(i, [0.5] * 8, i % 3) for i in range(700, 1000)]
    got = negatives.mine(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), F.col("vec_id") % 10 == 0)
    assert result(got) == brute(rows, lambda i: i % 10 == 0)


def floats(v):
    return v if v is None else [x if x is None else float(x) for x in v]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)], i % 2) for i in range(60)]
    rows += [(None, [1.0, 0, 0], 1), (60, None, 1), (61, [1.0, None, 0], 1), (62, [nan, 0.0, 0], 1), (63, [inf, 0.0, 0], 0), (64, [1.0, 1, 1], None),
             (65, [], 0), (66, [], 0), (67, [], 1), (68, [0.0, 0, 0], 1), (69, [2.0, 1], 0), (70, [1.0, 2], 0), (71, [1.0, 1], 1), (5, [0.1, 0.2, 0.3], 0), (5, [0.1, 0.2, 0.3], 0)]
    got = negatives.mine(spark.createDataFrame([(i, floats(v), label, None, None) for i, v, label in rows], SCHEMA), F.lit(True))
    assert result(got) == brute(rows, lambda i: True)
    assert result(negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True))) == []
    assert result(negatives.mine(spark.createDataFrame([(1, [1.0], 1, 1, "")], SCHEMA), F.lit(True))) == []


def test_bounds_hold():
    rng = np.random.default_rng(5)
    data, queries = rng.integers(-200, 200, (3000, 16)).astype("<i4"), rng.integers(-300, 300, (40, 16)).astype("<i4")
    space = negatives.Space(data[:500], int(np.square(data.astype(np.int64)).sum(axis=1).max()))
    pivot, away, ring = space.keys(data)
    cells = sorted(set(zip(pivot.tolist(), ring.tolist())))
    own = {c: (pivot == c[0]) & (ring == c[1]) for c in cells}
    space.rings = np.array([(n, p, away[own[p, r]].min(), away[own[p, r]].max()) for n, (p, r) in enumerate(cells)])
    top, least = space.bounds(queries)
    scores = negatives.exact_scores(queries, data)
    for n, c in enumerate(cells):
        assert (scores[:, own[c]].max(axis=1) <= top[:, n]).all() and (scores[:, own[c]].min(axis=1) >= least[:, n]).all()


def test_large_components_are_exact():
    a = np.array([[1 << 24, -(1 << 24), 3]], dtype="<i4")
    assert negatives.exact_scores(a, a).tolist() == [[2 * (1 << 48) + 9]]
