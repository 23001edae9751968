import math

import numpy as np
import pytest

from chartwave.llm import rabitq
from tests.llm.helpers import partition

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, cosine):
    good = {}
    for i, v, *_ in rows:
        v = None if v is None or any(x is None for x in v) else np.array(v, dtype=np.float32).astype(float)
        if v is not None and len(v) and np.isfinite(v).all() and v.any():
            good[i] = v / np.linalg.norm(v)
    links = [
        (a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine
    ]
    n = {i: 0 for i, *_ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    parts = partition(links, [r[0] for r in rows])
    return {i: (n[i], parts[i], parts[i] == i) for i, *_ in rows}


def cloud(rng, n, d):
    """Lone vectors, a chain, and one dense group of near copies."""
    rows = [rng.standard_normal(d) for _ in range(n)]
    centre = rng.standard_normal(d)
    rows += [centre + rng.standard_normal(d) * 0.16 for _ in range(n // 3)]
    for v in rows[:20]:
        rows.append(v + rng.standard_normal(d) * rng.uniform(0.05, 0.4))
    return [(i * 3 + 1, [float(x) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_links_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(rabitq, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(0)
    rows = [(*r, 0, "x") for r in cloud(rng, 240, 32)]
    rows += [
        (90_000, None, 0, "x"), (90_001, [], 0, "x"), (90_002, [0.0] * 32, 0, "x"), (90_003, [None, 1.0], 0, "x"),
        (90_004, [float("nan")] * 32, 0, "x"), (90_005, [float("inf")] * 32, 0, "x"), (90_006, [1.0, 2.0], 0, "x"),
        (90_007, [2.0, 4.0], 0, "x"), (90_008, rows[0][1], 0, "x"), (90_009, [-x for x in rows[0][1]], 0, "x"),
    ]
    out = rabitq.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == brute(rows, 0.95)


def test_empty_table_null_and_repeated_ids(spark):
    assert rabitq.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, [1.0, 0.0], 0, ""), (1, [1.0, 0.0], 0, ""), (1, [1.0, 0.0], 0, ""), (2, [1.0, 0.0], 0, "")]
    out = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in rabitq.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(0, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def pairs_at(rng, n, d, cosine):
    o, side = rng.standard_normal((n, d)), rng.standard_normal((n, d))
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    side -= (side * o).sum(1, keepdims=True) * o
    return o, cosine * o + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)


def test_estimates_are_unbiased_and_the_bound_holds():
    rng = np.random.default_rng(4)
    d, cosine = 48, 0.9
    o, q = pairs_at(rng, 1000, d, cosine)
    means, below = [], 0
    for seed in range(30):
        bits, factor, turned = rabitq.codes(o, 1, seed)
        packed = rabitq.pack(*rabitq.codes(q, 2, seed))
        more, _, step, near = rabitq.unpack(packed, d)
        assert np.abs(near - q @ rabitq.rotation(d, 0, seed).T).max(axis=1).max() <= step.max() / 2 + 1e-6
        assert (more[:, : 2 * d] == rabitq.codes(q, 2, seed)[0]).all()
        est = np.diag(rabitq.estimate(bits, factor, near))
        below += (est < rabitq.least_estimate(factor, step, cosine, d, 3.0)).sum()
        means.append(est.mean())
    assert abs(np.mean(means) - cosine) < 0.003
    assert below <= 3 * 30_000 * (1 - rabitq.NormalDist().cdf(3.0))


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold are all found, however the two halves of the loss fall."""
    rng = np.random.default_rng(8)
    o, q = pairs_at(rng, 1500, 64, 0.9501)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([o, q]))]
    out = rabitq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links > 0 for r in out) >= 0.999 * len(rows)


def test_copies_count_without_being_compared(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3, 16))
    rows = [(i, [float(x) for x in base[i % 3]]) for i in range(3000)] + [(9000, [float(x) for x in base[0] * 1.5])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in rabitq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near = [[j for j in range(3) if base[i] @ base[j] >= 0.95 * np.linalg.norm(base[i]) * np.linalg.norm(base[j])] for i in range(3)]
    assert near == [[0], [1], [2]]
    assert all(out[i] == (1000 if i % 3 == 0 else 999, i % 3) for i in range(3000)) and out[9000] == (1000, 0)


def test_repeated_ids_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.99, 0.01]), (2, [1.0, 0.0]), (2, [1.0, 0.001]), (-2, [1.0, 0.001]), (3, [0.0, 1.0]), (1, [0.0, 1.0])]
    out = rabitq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    # Links of all rows of an id: id 1 has two rows that link with three vectors of other ids, and one with one.
    assert sorted({(r.vec_id, r.n_links, r.component_id) for r in out}) == [(-2, 4, -2), (1, 7, -2), (2, 6, -2), (3, 1, -2)]


def test_bands_reach_the_wanted_recall():
    for n in (100, 10_000, 10_000_000):
        bits, bands = rabitq.bands_for(n, 0.95, 0.9999)
        share = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - share) ** bands >= 0.9999
