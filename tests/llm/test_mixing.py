import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chartwave.llm import mixing
from tests.llm.helpers import docs_of


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1}, {"a": 0.9, "b": 0.07, "c": 0.02, "d": 0.01}, {str(i): 1 + i % 7 for i in range(40)}])
def test_every_prefix_of_a_period_is_within_one_block(weights):
    period = 1000
    shares = mixing.whole_shares(weights, period)
    assert sum(shares.values()) == period and min(shares.values()) >= 1
    slots = mixing.edf_period(shares, period)
    assert sorted(s for own in slots.values() for s in own) == list(range(period))
    for s, own in slots.items():
        for k, slot in enumerate(own):
            assert k * period // shares[s] <= slot < -(-(k + 1) * period // shares[s])
        placed = set(own)
        done = 0
        for t in range(period):
            done += t in placed
            assert abs(done - shares[s] * (t + 1) / period) < 1


def test_phases_place_every_block_once():
    blocks = {"a": 2500, "b": 130, "c": 7, "d": 1}
    rows = mixing.phases(blocks, mixing.tempered(blocks, 0.5), 100)
    seen, slots = Counter(), set()
    for r in rows:
        for k in range(r["first"], r["last"]):
            at, n = k - r["first"], len(r["slots"])
            slot = r["start"] + at // n * r["period"] + r["slots"][at % n]
            assert slot not in slots
            slots.add(slot)
            seen[r["stream"]] += 1
    assert seen == blocks and slots == set(range(sum(blocks.values())))


def test_rows_are_whole_and_sources_keep_their_share(spark):
    rows = [(i, f"t{i}", None, "big" if i % 3 else f"s{i % 5}") for i in range(6000)] + [(9000, "x", None, None)]
    docs = docs_of(spark, rows)
    weights = {"big": 2.0, "s0": 1.0, "s1": 1.0, "s2": 1.0, "s3": 1.0, "s4": 1.0}
    out = mixing.mix(docs, weights=weights, block_rows=10, period=70, ordered=True)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    order = [(r.mix_slot, r.mix_place) for r in got]
    assert order == sorted(order) and len(set(order)) == len(order)
    blocks = {}
    for r in got:
        blocks.setdefault(r.mix_slot, set()).add((r.source, r.mix_block))
    assert all(len(b) == 1 for b in blocks.values()) and set(blocks) == set(range(len(blocks)))
    done = Counter()
    for slot in range(140):
        done[next(iter(blocks[slot]))[0]] += 1
        assert abs(done["big"] - 20 * (slot + 1) / 70) < 1.5
    again = mixing.mix(docs.repartition(7), weights=weights, block_rows=10, period=70).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_odd_tables(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    rows = [(None, "a", None, "s"), (None, "a", None, "s"), (1, None, None, ""), (1, None, None, None), (2, "b", None, "t")]
    schema = "doc_id long, text string, lang string, source string, mix_slot string, row int, stream string"
    out = mixing.mix(docs_of(spark, rows, schema))
    assert out.columns == ["doc_id", "text", "lang", "source", "row", "stream", "mix_block", "mix_slot", "mix_place"]
    assert out.count() == 5
    many = docs_of(spark, [(i, "x", None, f"s{i}") for i in range(300)])
    assert mixing.mix(many, max_sources=16).select("mix_slot", "mix_place").distinct().count() == 300
    assert mixing.mix(many, weights={"zz": 1.0}).count() == 300


@pytest.mark.parametrize(
    "weights", [{"a": 0.5} | {f"s{i:02}": 0.025 for i in range(20)}, {f"s{i:03}": 1.0 / (i + 1) for i in range(200)}, {"a": 2**0.5, "b": 1.0, "c": 0.001}]
)
def test_every_prefix_of_many_periods_follows_the_weights(weights):
    total = sum(weights.values())
    blocks = {s: int(20_000 * w / total) + 40 for s, w in weights.items()}
    rows = {r["stream"]: r for r in mixing.phases(blocks, weights, 1000)}
    least = min(blocks[s] * total / weights[s] for s in weights)
    assert least >= 20_000
    for s, r in rows.items():
        for j in range(r["last"]):
            at, n = j - r["first"], len(r["slots"])
            slot = r["start"] + at // n * r["period"] + r["slots"][at % n]
            if slot < least:
                share = weights[s] / total
                assert abs(j - share * slot) < 1 + 1e-5 and abs(j + 1 - share * (slot + 1)) < 1 + 1e-5


@pytest.mark.parametrize("table_bytes", [64 << 20, 0])
def test_many_sources_keep_their_own_streams_and_weights(spark, monkeypatch, table_bytes):
    monkeypatch.setattr(mixing, "TABLE_BYTES", table_bytes)
    rows = [(i, "x", None, "heavy" if i < 400 else f"s{i % 300}") for i in range(1600)]
    weights = {"heavy": 300.0} | {f"s{i}": 1.0 for i in range(300)}
    got = mixing.mix(docs_of(spark, rows), weights=weights, block_rows=1).collect()
    own = {}
    for r in got:
        own.setdefault(r.source, []).append(r.mix_block)
    assert len(own) == 301 and all(sorted(b) == list(range(len(b))) for b in own.values())
    placed = sorted((r.mix_slot, r.source) for r in got)
    assert [p[0] for p in placed] == list(range(1600))
    done = 0
    for slot, source in placed[:800]:
        done += source == "heavy"
        assert abs(done - (slot + 1) / 2) < 1


def slow_edf(blocks, weights):
    """Source of each slot, by exact fractions and a search of all released blocks in each slot."""
    weights = {s: Fraction(weights[s]) for s in blocks}
    times, at, left = {s: [Fraction(0)] for s in blocks}, Fraction(0), {s: Fraction(blocks[s]) for s in blocks}
    while any(left.values()):
        share = sum(weights[s] for s in left if left[s])
        step = min(left[s] * share / weights[s] for s in left if left[s])
        for s in left:
            if left[s]:
                done = blocks[s] - left[s]
                more = step * weights[s] / share
                for k in range(math.floor(done) + 1, math.floor(done + more) + 1):
                    times[s].append(at + (k - done) * share / weights[s])
                left[s] -= more
        at += step
    placed, order = dict.fromkeys(blocks, 0), []
    for slot in range(sum(blocks.values())):
        ready = [(math.ceil(times[s][k + 1]), s) for s, k in placed.items() if k < blocks[s] and math.floor(times[s][k]) <= slot]
        due, s = min(ready)
        assert due > slot
        order.append(s)
        placed[s] += 1
    return order


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 3, "c": 1, "d": 1}, {"a": 0.5, "b": 0.25, "c": 0.125}, {"zz": 2}])
def test_whole_tables_equal_a_slow_schedule(spark, weights):
    """Ties of weights, sources that run out, sources without a weight, a null source, null and repeated ids."""
    rows = [(i, "x", None, "aabbcd"[i % 6]) for i in range(500)] + [(9000 + i, "y", None, None) for i in range(23)]
    rows += [(None, "n", None, "a")] * 9 + [(7, "again", None, "a")] * 4
    docs = docs_of(spark, rows)
    got = mixing.mix(docs, weights=weights, alpha=1.0, block_rows=4, period=50).collect()
    counts = Counter("" if r[3] is None else "=" + r[3] for r in rows)
    blocks = {s: -(-n // 4) for s, n in counts.items()}
    own = dict(counts) if weights is None else {s: weights.get(s[1:], 0) for s in counts}
    if not sum(own.values()):
        own = dict.fromkeys(own, 1)
    own = {s: w or Fraction(sum(own.values())) / 50 for s, w in own.items()}
    order = slow_edf(blocks, own)
    hashed = {r[0]: r[1] for r in docs.select(F.col("doc_id").cast("string"), F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), 33)).distinct().collect()}
    name = lambda s: "" if s is None else "=" + s
    wanted = []
    for s in blocks:
        slots = [i for i, x in enumerate(order) if x == s]
        ids = sorted((hashed[None if r[0] is None else str(r[0])], "" if r[0] is None else str(r[0])) for r in rows if name(r[3]) == s)
        wanted += [(s, i, k // 4, slots[k // 4], k % 4) for k, (_, i) in enumerate(ids)]
    assert sorted(wanted) == sorted((name(r.source), "" if r.doc_id is None else str(r.doc_id), r.mix_block, r.mix_slot, r.mix_place) for r in got)


def test_rows_that_share_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_ROWS", 1000)
    rows = [(None, f"t{i}", None, "a") for i in range(3000)] + [(5, "same", None, "b")] * 3000 + [(i, "x", None, "c") for i in range(10, 3010)]
    docs = docs_of(spark, rows)
    out = mixing.mix(docs, block_rows=10)
    got = out.collect()
    assert sorted((r.text, r.source) for r in got) == sorted((r[1], r[3]) for r in rows)
    assert sorted((r.mix_slot, r.mix_place) for r in got) == [(i // 10, i % 10) for i in range(9000)]


def test_blocks_are_a_share_of_large_tables(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 8)
    got = mixing.mix(docs_of(spark, [(i, "x", None, "ab"[i % 2]) for i in range(4000)])).collect()
    assert len({r.mix_slot for r in got}) == 8 and max(r.mix_place for r in got) == 499
