import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chartwave.llm import simhash
from tests.llm.helpers import docs_of, partition

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    fps = [(i, slow_fingerprint(t, 3)) for i, t in rows]
    links = [(a, b) for a, x in fps for b, y in fps if a < b and bin(x ^ y).count("1") <= radius]
    parts = partition(links, [i for i, _ in fps])
    return {i: (f"{x:016x}", parts[i]) for i, x in fps}


def test_matches_brute_force_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_texts(docs).collect()}
    assert got == brute(rows)


def test_odd_texts(spark):
    base = "Ein Satz mit Wörtern\tund\x0bmehr Wörtern, der oft kopiert wird. " * 40
    rows = [(5, None), (3, ""), (9, " \n\t "), (11, "one"), (2, "ONE"), (4, "two words"), (7, base), (8, base.upper()),
            (6, base + "ende"), (12, "x" * 200_000), (13, "\u00a0nbsp is a word\u00a0"), (14, "Ä ä Å å")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_texts(docs_of(spark, rows)).collect()}
    assert got == brute(rows)
    assert simhash.near_texts(docs_of(spark, [])).count() == 0
    twice = simhash.near_texts(docs_of(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in twice) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def near_codes(rng, n):
    codes = [int(x) for x in rng.integers(0, 2**64, n, dtype=np.uint64)]
    for c in list(codes[: n // 2]):
        for bit in rng.choice(64, size=int(rng.integers(1, 5)), replace=False):
            c ^= 1 << int(bit)
        codes.append(c)
    return np.unique(np.array(codes, dtype=np.uint64))


def test_gray_index_finds_every_pair():
    rng = np.random.default_rng(2)
    codes = near_codes(rng, 400)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    a, b = simhash.GrayIndex(ordered).search(ordered, 3)
    distance = np.bitwise_count(ordered[:, None] ^ ordered[None, :])
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= 3))))


def test_gray_rank_orders_the_reflected_code():
    i = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(i ^ (i >> np.uint64(1))) == i).all()


@pytest.mark.parametrize("run_rows", [4096, 3])
def test_dealt_runs_lose_no_link(spark, monkeypatch, run_rows):
    monkeypatch.setattr(simhash, "RUN_ROWS", run_rows)
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**64, dtype=np.uint64))
    ball = {centre ^ (1 << i) ^ (1 << j) for i in range(0, 40, 3) for j in range(1, 40, 7)}
    codes = np.unique(np.r_[near_codes(rng, 200), np.array(sorted(ball), dtype=np.uint64)])
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    links = [(r.src, r.dst) for r in simhash.link_fingerprints(frame, 2).collect()]
    distance = np.bitwise_count(codes[:, None] ^ codes[None, :])
    wanted = [(int(codes.view(np.int64)[a]), int(codes.view(np.int64)[b])) for a, b in zip(*np.nonzero(distance <= 2)) if a != b]
    nodes = codes.view(np.int64).tolist()
    assert partition(links, nodes) == partition(wanted, nodes)


def test_fingerprint_hash_is_spark_xxhash64(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h % 2**64 == simhash.fingerprint(b"a b c", 3)


def shingle_set(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.mark.parametrize("run_rows, set_bytes", [(4096, 24 << 20), (4, 1500)])
def test_similar_texts_against_exact_similarity(spark, monkeypatch, run_rows, set_bytes):
    monkeypatch.setattr(simhash, "RUN_ROWS", run_rows)
    monkeypatch.setattr(simhash, "SET_BYTES", set_bytes)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows, sets = [], []
    for i in range(60):
        own = [words[j] for j in rng.integers(0, 3000, 300)]
        rows.append((10 * i, " ".join(own)))
        for c in range(1, 4):
            changed = list(own)
            for at in rng.choice(300, size=(0, 2, 4, 40)[c], replace=False):
                changed[at] = "x" + str(rng.integers(10**9))
            rows.append((10 * i + c, " ".join(changed)))
    rows += [(5000, None), (5001, ""), (5002, "short"), (5003, "Short"), (None, rows[0][1])]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs_of(spark, rows)).collect()}
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    assert set(got) == set(sets) and got[5001] == 5000 and got[5003] == 5002
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    wanted = [(a, b) for a in sets for b in sets if a < b and alike(a, b) >= 0.8]
    assert got == partition(wanted, list(sets))
    assert simhash.similar_texts(docs_of(spark, [])).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(9)
    for s in (0.5, 0.8, 0.95):
        n = 400
        shared = int(2 * n * s / (1 + s))
        common = rng.integers(0, 2**63, shared).astype(np.uint64)
        sides = [np.r_[common, rng.integers(0, 2**63, n - shared).astype(np.uint64)] for _ in range(2)]
        a, b = (np.array([simhash.majority(simhash.mixed(x, k)) for k in range(64)], dtype=np.uint64) for x in sides)
        share = np.bitwise_count(a ^ b).sum() / 4096
        assert abs(share - simhash.differing_share(s)) < 0.02


def test_similar_texts_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    wanted = partition([(a, b) for a in sets for b in sets if a < b and alike(a, b) >= 0.8], list(sets))
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()} == wanted


def test_repeated_ids_hold_several_texts(spark):
    base = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [(1, base), (1, other), (1, base), (2, base + " end"), (3, other + " end"), (4, "alone")]
    got = sorted((r.doc_id, r.component_id) for r in simhash.similar_texts(docs_of(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


@pytest.mark.parametrize("run_rows", [4096, 3])
def test_small_similar_sets_are_always_found(spark, monkeypatch, run_rows):
    monkeypatch.setattr(simhash, "RUN_ROWS", run_rows)
    rows, sizes = [], [8] * 80 + [9, 13, 17, 25, 36, 37, 40, 44]
    for i, n in enumerate(sizes):
        own = [f"d{i}w{j}" for j in range(n)]
        rows += [(10 * i, " ".join(own)), (10 * i + 1, " ".join([*own, "more"]))]
        rows.append((10 * i + 2, " ".join([*own, *(f"e{i}x{j}" for j in range(-(-n // 5)))])))
    common = [f"c{j}" for j in range(34)]
    rows += [(9000 + i, " ".join([*common, f"z{i}", f"y{i}"])) for i in range(12)]
    sets = {i: shingle_set(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    wanted = partition([(a, b) for a in sets for b in sets if a < b and alike(a, b) >= 0.8], list(sets))
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs_of(spark, rows)).collect()}
    assert got == wanted and all(got[10 * i + 1] == 10 * i for i in range(80))


def test_sketch_bounds_hold_for_the_worst_sizes():
    assert simhash.uneven_share(4, 0, 1) == 0.1875
    share = simhash.largest_share(0.8)
    assert 0.155 < share < 0.156
    bits, bands, _ = simhash.sketch_plan(3_000_000, 0.8, 0.9999)
    lost = (1 - (1 - share) ** bits) ** bands
    for width in (64, 512):
        most = simhash.open_bits(width, 0.8)
        lost += sum(math.comb(width, k) * share**k * (1 - share) ** (width - k) for k in range(most + 1, width + 1))
    assert lost < 1e-4


def exact_groups(sets, share=0.8):
    """Smallest id reachable over pairs of sets of at least that similarity, by an inverted index of each set's rarest members."""
    seen = Counter(h for own in sets.values() for h in own)
    held, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets, key=lambda i: (len(sets[i]), i)):
        n = len(sets[i])
        rare = sorted(sets[i], key=lambda h: (seen[h], h))[: n - math.ceil(share * n - 1e-9) + 1] if n else [None]
        for j in {j for h in rare for j in held[h] if len(sets[j]) >= share * n}:
            both = len(sets[i] & sets[j])
            if not n or both >= share * (n + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for h in rare:
            held[h].append(i)
    return {i: root(i) for i in sets}


def test_no_near_copy_of_a_whole_table_is_missed(spark):
    """All documents of sf0.01 get the group that exact comparison of their five-word shingle sets gives."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in docs.collect()}
    want = exact_groups(sets)
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()} == want
    assert len(set(want.values())) < len(want) > 500
