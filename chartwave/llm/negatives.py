"""Hard negatives by one-dimensional distance keys.

A vector x of integers gets one more coordinate, sqrt(M^2 - |x|^2), M being the greatest
length, and a query q gets a zero: then |x' - q'|^2 = M^2 + |q|^2 - 2 <x, q>, and the highest
inner products are the nearest neighbours.  Each x' is keyed by its nearest pivot and its
distance to it, and stored in blocks in the order of (pivot, distance).  The distances of a
pivot are cut into rings, the unit of scans.  By the triangle inequality a ring [lo, hi] of a
pivot p lies at least max(d(q, p) - hi, lo - d(q, p)) from q.  A query scans its nearest rings
first and widens the intervals round by round, until no ring left can hold a score that
reaches the k-th it has: its result is then certain.  Scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_table

#: Rows that pivots and rings are fitted on (a sample by hash; all rows are indexed).
SAMPLE_ROWS = 2048
PIVOTS, RINGS = 32, 16
#: Vectors of a stored block, queries that meet it at a time, blocks of a ring that meet them in one place.
BLOCK_ROWS, PACK_QUERIES, SALT_BLOCKS = 1024, 256, 16
#: Queries of one ring that are packed in one place.
DEALT_QUERIES = 4096
#: Rings that a query scans in the first round, and by what they grow each round.
FIRST_RINGS, GROWTH = 8, 8
#: Components beyond this (after scaling) are set to it, so that scores fit into 64 bits.
MOST = 1 << 24
FAR = (1 << 62) - 1


def scaled_rows(batch: pa.RecordBatch, scale: int) -> pa.RecordBatch:
    """(vec_id, label, dim, norm2, vector) of the usable rows of (vec_id, label, list of doubles)."""
    column = batch.column(2)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.array([x or 0 for x in column.value_lengths().to_pylist()], dtype=np.int64)
    ends = np.cumsum(lengths)
    whole = np.clip(np.floor(scale * np.nan_to_num(values, nan=0.0, posinf=0.0, neginf=0.0)), -MOST, MOST).astype("<i4")
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    usable = (bad[ends] == bad[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False)
    usable &= batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(usable)
    own = [whole[ends[i] - lengths[i] : ends[i]] for i in at]
    norms = [int((v.astype(np.int64) ** 2).sum()) for v in own]
    take = pa.array(at)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(take), batch.column(1).take(take), pa.array(lengths[at], pa.int32()), pa.array(norms, pa.int64()),
         pa.array([v.tobytes() for v in own], pa.binary())],
        names=["vec_id", "label", "dim", "norm2", "vector"],
    )


def stacked(raw: list[bytes] | bytes, dim: int) -> np.ndarray:
    raw = raw if isinstance(raw, bytes) else b"".join(raw)
    return np.frombuffer(raw, dtype="<i4").reshape(-1, dim) if dim else np.zeros((0, 0), dtype="<i4")


def augmented(vectors: np.ndarray, most2: int) -> np.ndarray:
    v = vectors.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(most2 - np.square(v).sum(axis=1), 0))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    gap = np.square(points).sum(axis=1)[:, None] + np.square(pivots).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(gap, 0))


def fit_pivots(points: np.ndarray, n: int, seed: int = 0, steps: int = 8) -> np.ndarray:
    """Centres of n clusters of the points."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    centres = points[rng.choice(len(points), min(n, len(points)), replace=False)]
    for _ in range(steps):
        own = distances(points, centres).argmin(axis=1)
        centres = np.stack([points[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
    return centres


class Space:
    """The vectors of one dimension: pivots, the inner edges of their rings, and later the rings that hold rows."""

    def __init__(self, vectors: np.ndarray, most2: int):
        self.most2 = most2
        points = augmented(vectors, most2)
        self.pivots = fit_pivots(points, max(1, min(PIVOTS, len(points) // 16)))
        away = distances(points, self.pivots)
        near = away.argmin(axis=1)
        shares = np.arange(1, RINGS) / RINGS
        self.edges = [np.quantile(away[near == i, i], shares) if (near == i).any() else np.zeros(0) for i in range(len(self.pivots))]
        self.rings = np.zeros((0, 4))

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pivot, distance, ring) of each vector."""
        away = distances(augmented(vectors, self.most2), self.pivots)
        pivot = away.argmin(axis=1)
        own = away[np.arange(len(away)), pivot]
        ring = np.array([np.searchsorted(self.edges[p], d) for p, d in zip(pivot, own)], dtype=np.int64)
        return pivot, own, ring

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(highest, lowest) score that each query can have in each ring."""
        q = queries.astype(np.float64)
        own = np.square(q).sum(axis=1)[:, None] + self.most2
        away = distances(np.column_stack([q, np.zeros(len(q))]), self.pivots)[:, self.rings[:, 1].astype(int)]
        # Distances of equal points cancel to about 1e-8 of their lengths, which the slack covers.
        slack = 1e-6 * np.sqrt(own) + 1e-6
        gap = np.maximum(np.maximum(away - self.rings[:, 3], self.rings[:, 2] - away) - slack, 0)
        return (own - np.square(gap)) / 2 + 1, (own - np.square(away + self.rings[:, 3] + slack)) / 2 - 1


class Index:
    """Stored blocks (cell, salt, dim, ids, labels, vectors) and what says where they lie; of a bounded size."""

    def __init__(self, blocks: DataFrame, spaces: dict[int, Space], salts: dict[int, int], few: int):
        self.blocks, self.spaces, self.salts, self.few = blocks, spaces, salts, few


def cell_of(dim: int, pivot: int, ring: int) -> int:
    """The number of a ring of a pivot; dimensions without pivots have one cell each."""
    return (dim * PIVOTS + pivot) * RINGS + ring if pivot >= 0 else -dim - 1


def usable_rows(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """Rows (vec_id, label, dim, norm2, vector), one for each vec_id; written."""
    bounded_batches(vectors.sparkSession)
    narrow = vectors.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>"))
    rows = narrow.mapInArrow(lambda batches: (scaled_rows(b, scale) for b in batches), "vec_id long, label long, dim int, norm2 long, vector binary")
    return cut(rows.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "norm2", "vector")).alias("row")).select("vec_id", "row.*"))


def build(rows: DataFrame) -> Index:
    """Indexes all rows; pivots come from a sample of about SAMPLE_ROWS."""
    n = rows.count()
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec_id", "dim", "vector").collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in sorted(drawn, key=lambda r: r.vec_id)[: 2 * SAMPLE_ROWS]:
        by_dim.setdefault(r.dim, []).append(bytes(r.vector))
    by_dim.pop(0, None)
    most2 = dict(tuple(r) for r in rows.where(F.col("dim").isin(list(by_dim))).groupBy("dim").agg(F.max("norm2")).collect())
    spaces = {d: Space(stacked(v, d), most2[d]) for d, v in by_dim.items()}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            pivot, ring, away = np.full(len(dims), -1, dtype=np.int32), np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                if d in spaces:
                    own = np.flatnonzero(dims == d)
                    pivot[own], away[own], ring[own] = spaces[d].keys(stacked(batch.column(4).take(pa.array(own)).to_pylist(), d))
            extra = [pa.array(pivot), pa.array(ring), pa.array(away)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), *extra], names=["vec_id", "label", "dim", "vector", "pivot", "ring", "away"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def block() -> pa.RecordBatch:
            own = sorted(held)
            dim, pivot, ring = last
            away = [r[3] for r in own]
            columns = [
                pa.array([cell_of(dim, pivot, ring)], pa.int64()), pa.array([dim], pa.int32()), pa.array([pivot], pa.int32()), pa.array([min(away)]), pa.array([max(away)]),
                *(pa.array([np.array([r[i] for r in own], dtype="<i8").tobytes()], pa.binary()) for i in (0, 1)),
                pa.array([b"".join(r[2] for r in own)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["cell", "dim", "pivot", "low", "high", "ids", "labels", "vectors"])

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["dim"], r["pivot"], r["ring"])
                if held and (key != last or len(held) == BLOCK_ROWS):
                    yield block()
                    held.clear()
                last = key
                held.append((r["vec_id"], r["label"], r["vector"], r["away"]))
        if held:
            yield block()

    order = ["dim", "pivot", "ring", "away", "vec_id"]
    placed = rows.mapInArrow(keyed, "vec_id long, label long, dim int, vector binary, pivot int, ring int, away double")
    blocks = cut(
        placed.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(pack, "cell long, dim int, pivot int, low double, high double, ids binary, labels binary, vectors binary")
    )
    found = blocks.where("cell >= 0").groupBy("cell", "dim", "pivot").agg(F.min("low"), F.max("high"), F.count(F.lit(1))).collect()
    salts = {r[0]: -(-r[5] // SALT_BLOCKS) for r in found}
    for d, space in spaces.items():
        space.rings = np.array(sorted((r[0], r[2], r[3], r[4]) for r in found if r[1] == d), dtype=np.float64).reshape(-1, 4)
    # Dimensions outside the sample hold few rows.
    return Index(blocks, spaces, salts, max(1, n // (100 * BLOCK_ROWS * SALT_BLOCKS)))


def salts_column(index: Index) -> Column:
    known = F.create_map(*[F.lit(x) for kv in index.salts.items() for x in kv]) if index.salts else F.create_map().cast("map<bigint,int>")
    return F.coalesce(F.try_element_at(known, F.col("cell")), F.lit(index.few))


def wanted(index: Index, queries: DataFrame, done: DataFrame | None, k: int, skip: int, until: int) -> DataFrame:
    """Requests (cell, and all of the query) of the rings of rank skip to until that may still improve a query's result.

    queries: (qid, label, dim, vector, lows, highs); done: (qid, floors), the k-th score of each range so far.
    """
    spaces = index.spaces

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                if d not in spaces:
                    rows += own.tolist() if not skip else []
                    cells += [cell_of(int(d), -1, 0)] * len(own) if not skip else []
                    continue
                space = spaces[d]
                top, least = space.bounds(stacked(batch.column(3).take(pa.array(own)).to_pylist(), d))
                order = np.argsort(-top, axis=1, kind="stable")
                for i, at in enumerate(own.tolist()):
                    some = order[i, skip:until]
                    need = np.maximum(*(np.array(batch.column(c)[at].as_py(), dtype=np.float64) for c in (4, 6)))
                    high = np.array(batch.column(5)[at].as_py(), dtype=np.float64)
                    use = ((top[i, some, None] >= need) & (least[i, some, None] <= high) & (need <= high)).any(axis=1)
                    cells += space.rings[some[use], 0].astype(np.int64).tolist()
                    rows += [at] * int(use.sum())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *(c.take(take) for c in batch.columns)], names=["cell", *batch.schema.names])

    if done is None:
        joined = queries.withColumn("floors", F.col("lows"))
    else:
        joined = queries.join(done, "qid", "left").withColumn("floors", F.coalesce("floors", "lows"))
    schema = "qid long, label long, dim int, vector binary, lows array<long>, highs array<long>, floors array<long>"
    return joined.select("qid", "label", "dim", "vector", "lows", "highs", "floors").mapInArrow(ask, f"cell long, {schema}")


PACKED = "cell long, dim int, qids binary, labels binary, vectors binary, n_ranges int, lows binary, highs binary, floors binary"


def packed_requests(requests: DataFrame, n_queries: int) -> DataFrame:
    """Requests of one ring, PACK_QUERIES in a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def row() -> pa.RecordBatch:
            # Ranges that a query lacks are empty.
            most = max(len(r["lows"]) for r in held)
            padded = lambda name, fill: np.array([r[name] + [fill] * (most - len(r[name])) for r in held], dtype="<i8").tobytes()
            columns = [
                pa.array([last], pa.int64()), pa.array([held[0]["dim"]], pa.int32()),
                *(pa.array([np.array([r[c] for r in held], dtype="<i8").tobytes()], pa.binary()) for c in ("qid", "label")),
                pa.array([b"".join(r["vector"] for r in held)], pa.binary()), pa.array([most], pa.int32()),
                *(pa.array([padded(*x)], pa.binary()) for x in (("lows", FAR), ("highs", -FAR), ("floors", FAR))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["cell"] != last or len(held) == PACK_QUERIES):
                    yield row()
                    held.clear()
                last = r["cell"]
                held.append(r)
        if held:
            yield row()

    part = F.pmod(F.xxhash64("qid"), F.lit(-(-n_queries // DEALT_QUERIES)))
    return requests.withColumn("part", part).repartition("cell", "part").sortWithinPartitions("cell", "part").drop("part").mapInArrow(pack, PACKED)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact."""
    top = lambda v: int(np.abs(v).max(initial=0))
    if top(a) * top(b) * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_of_block(row: dict, same: bool, k: int) -> list[tuple[int, int, int, int]]:
    """(qid, range, score, vec_id): the first k of a block for each query and range that reach the query's floor."""
    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
    qids, q_labels = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["q_labels"], "<i8")
    lows, highs, floors = (np.frombuffer(row[c], "<i8").reshape(len(qids), -1) for c in ("lows", "highs", "floors"))
    d = row["dim"]
    scores = exact_scores(stacked(row["q_vectors"], d), stacked(row["vectors"], d)) if d else np.zeros((len(qids), len(ids)), dtype=np.int64)
    fits = (labels == q_labels[:, None]) == same
    fits &= (ids != qids[:, None]) & (scores >= np.maximum(lows, floors).min(axis=1)[:, None]) & (scores <= highs.max(axis=1)[:, None])
    out = []
    for i in np.flatnonzero(fits.any(axis=1)).tolist():
        at = np.flatnonzero(fits[i])
        own = scores[i, at]
        for j in range(lows.shape[1]):
            use = (own >= max(lows[i, j], floors[i, j])) & (own <= highs[i, j])
            # Ids rise within a block, so a stable order breaks ties by them.
            first = np.argsort(-own[use], kind="stable")[:k]
            out += [(int(qids[i]), j, s, x) for s, x in zip(own[use][first].tolist(), ids[at[use]][first].tolist())]
    return out


def scan(index: Index, packs: DataFrame, same: bool, k: int) -> DataFrame:
    """Candidates (qid, range, score, vec_id) of the packed requests."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                found += best_of_block(batch.slice(i, 1).to_pylist()[0], same, k)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(kinds)], names=["qid", "range", "score", "vec_id"])

    salts = salts_column(index)
    blocks = index.blocks.select("cell", F.pmod(F.xxhash64("ids"), salts).cast("int").alias("salt"), "ids", "labels", "vectors")
    asked = packs.withColumnsRenamed({"labels": "q_labels", "vectors": "q_vectors"})
    spread = asked.select("*", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("salt"))
    spark = packs.sparkSession
    bounded_batches(spark)
    met = spread.join(blocks, ["cell", "salt"])
    return met.mapInArrow(look, "qid long, range int, score long, vec_id long")


def search(index: Index, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """The first k rows, by score and then vec_id, for each query and each of its ranges: (qid, range, score, vec_id, rank); written.

    queries: (qid, label, dim, vector, lows, highs), where range j admits scores from lows[j] to
    highs[j].  Rows of the query's own label are looked for if same, else the others; never the
    row whose vec_id is qid.
    """
    n = queries.count()
    rings = max([0, *(len(s.rings) for s in index.spaces.values())])
    best = done = None
    skip, until = 0, FIRST_RINGS
    while n and (not skip or skip < rings):
        requests = cut(packed_requests(wanted(index, queries, done, k, skip, until), n))
        if not requests.isEmpty():
            found = scan(index, requests, same, k)
            before = found if best is None else found.union(best.select(found.columns))
            first = F.row_number().over(Window.partitionBy("qid", "range").orderBy(F.desc("score"), "vec_id"))
            after = cut(before.withColumn("rank", first).where(F.col("rank") <= k))
            for spent in (best, done):
                if spent is not None:
                    drop_table(spent)
            best = after
            kth = best.where(F.col("rank") == k).select("qid", "range", "score")
            widths = queries.select("qid", F.posexplode("lows").alias("range", "low"))
            floors = widths.join(kth, ["qid", "range"], "left").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("range", F.coalesce("score", "low").alias("floor")))).alias("all"))
            done = cut(floors.select("qid", F.col("all.floor").alias("floors")))
        drop_table(requests)
        skip, until = until, until * GROWTH
    if best is None:
        return queries.sparkSession.createDataFrame([], "qid long, range int, score long, vec_id long, rank int")
    return best


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """Hard negatives of the anchors: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: (vec_id, embedding, label).  Components become floor(scale * x); a score is the integer
    inner product with the anchor, and among equal scores the smaller vec_id comes first.  An
    anchor's positives are its first `positives` other rows of the same label.  For each, the first
    `negatives` rows of another label with low * positive <= 100 * negative <= high * positive are
    returned, all if there are fewer.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part.
    Of rows that share a vec_id the one with the smallest (label, vector) does.  Vectors of
    different lengths never meet.  Scaled components beyond 2^24 count as 2^24.  An empty table
    gives an empty result.
    """
    rows = usable_rows(vectors, F.col("label") if label is None else label, scale)
    index = build(rows)
    chosen = rows.where(anchors).select(F.col("vec_id").alias("qid"), "label", "dim", "vector")
    every = lambda x: F.array(F.lit(x).cast("long"))
    near = search(index, chosen.select("*", every(-FAR).alias("lows"), every(FAR).alias("highs")), True, positives)
    # Whole numbers: the lowest score not below low % and the highest not above high % of the positive's.
    at_least, at_most = F.expr(f"({low} * score + pmod(-{low} * score, 100)) div 100"), F.expr(f"({high} * score - pmod({high} * score, 100)) div 100")
    ranges = near.select("qid", F.struct(F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), at_least.alias("low"), at_most.alias("high")).alias("range"))
    pairs = cut(ranges.groupBy("qid").agg(F.sort_array(F.collect_list("range")).alias("ranges")))
    hard = search(index, cut(chosen.join(pairs.select("qid", F.col("ranges.low").alias("lows"), F.col("ranges.high").alias("highs")), "qid")), False, negatives)
    named = pairs.select("qid", F.posexplode("ranges").alias("range", "own"))
    drop_table(index.blocks)
    return hard.join(named, ["qid", "range"]).select(
        F.col("qid").alias("anchor_id"), "own.positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "own.positive_score", F.col("score").alias("negative_score"),
    )
