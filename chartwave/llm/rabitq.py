"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is rotated at random and each coordinate is reduced to its sign.
The code c (entries +-1/sqrt(d)) is stored with its correction factor a = <c, o>.
For another unit vector q the quotient <c, q> / a estimates <o, q> without bias,
because the rotation spreads what the code misses evenly over all directions; its
standard error is sqrt((1 - a^2) (1 - <o, q>^2) / (d - 1)) / a.  The rotated q travels
as 4-bit numbers, which add a little known error.  A pair whose estimate lies more
than epsilon0 standard errors below the threshold is dropped; only vectors of pairs
that this confidence bound leaves open are fetched and compared in double precision.

Pairs are looked for inside buckets: groups of code bits ("bands") of several
independent rotations.  The number of bands follows from the wanted recall at
the threshold itself, so closer pairs are found more surely still.  Equal vectors
are one class from the start, whose size counts in the numbers of links.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop_table, map_batches, merge_labels

#: Rows of one bucket compared in one task; larger buckets are dealt out in blocks.
BLOCK_ROWS = 2048
#: Rows that a bucket should hold, from which the bits of a band follow.
BUCKET_ROWS = 1024
STRIP = 128


@lru_cache(maxsize=8)
def rotation(d: int, r: int, seed: int) -> np.ndarray:
    """The r-th random rotation of d dimensions (orthogonal, from a Gaussian matrix)."""
    q, up = np.linalg.qr(np.random.default_rng([seed, d, r]).standard_normal((d, d)))
    return q * np.sign(np.diag(up))


def bands_for(n_rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits of a band, bands): a pair at the threshold shares a band with the wanted probability."""
    bits = min(24, max(6, math.ceil(math.log2(max(1, n_rows) / BUCKET_ROWS + 1))))
    share = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - share))


def unit_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(positions of usable vectors, their unit vectors in double precision).

    Usable: not null, not empty, all components finite, not all zero.
    """
    kept, units = [], []
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.array([x or 0 for x in column.value_lengths().to_pylist()], dtype=np.int64)
    ends = np.cumsum(lengths)
    for i, (n, end) in enumerate(zip(lengths, ends)):
        v = values[end - n : end]
        if n and np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
            v = v / top
            kept.append(i)
            units.append(v / np.sqrt(v @ v))
    return np.array(kept, dtype=np.int64), units


def codes(units: np.ndarray, rotations: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of all rotations, side by side, the correction factor of the first, the first rotated vectors)."""
    d = units.shape[1]
    turned = [units @ rotation(d, r, seed).T for r in range(rotations)]
    bits = np.concatenate([z >= 0 for z in turned], axis=1)
    return bits, np.abs(turned[0]).sum(axis=1) / math.sqrt(d), turned[0]


def quantised(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-bit numbers, step): a coordinate is (number - 7.5) * step to half a step, and keeps its sign."""
    step = np.abs(turned).max(axis=1) / 7.5
    return np.clip(np.floor(turned / step[:, None]) + 8, 0, 15).astype(np.uint8), step


def estimate(bits: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of <o_i, q_j> from the codes of o and the rotated q."""
    signs = np.where(bits, 1.0, -1.0).astype(turned.dtype) / math.sqrt(bits.shape[1])
    return (signs @ turned.T) / factor[:, None]


def least_estimate(factor: np.ndarray, step: np.ndarray | float, cosine: float, d: int, epsilon0: float) -> np.ndarray:
    """The estimate below which a pair hardly reaches the cosine: epsilon0 standard errors below it.

    Pairs above the threshold err less than those at it, and their estimates are higher.
    """
    a = np.clip(factor, 1e-9, 1.0)
    spread = (1 - a * a) * (1 - cosine * cosine) / max(d - 1, 1) + np.square(step) / 12
    return cosine - epsilon0 * np.sqrt(spread) / a - 1e-6


def epsilon_for(recall: float) -> float:
    """Standard errors that an estimate of a pair at the threshold falls short by with probability 1 - recall."""
    return NormalDist().inv_cdf(recall)


def pack(bits: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> list[bytes]:
    """What travels of each vector: factor, step, 4-bit rotated vector (its signs are the first code), further code bits."""
    numbers, step = quantised(turned)
    d = turned.shape[1]
    numbers = np.pad(numbers, ((0, 0), (0, d % 2)))
    halves = numbers[:, 0::2] << 4 | numbers[:, 1::2]
    more = np.packbits(bits[:, d:], axis=1)
    head = np.stack([factor, step], axis=1).astype("<f4").view(np.uint8)
    return [row.tobytes() for row in np.concatenate([head, halves, more], axis=1)]


def unpack(packed: list[bytes], d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits, factor, step, rotated vectors) of packed rows."""
    raw = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
    head = raw[:, :8].copy().view("<f4")
    halves = raw[:, 8 : 8 + (d + 1) // 2]
    numbers = np.stack([halves >> 4, halves & 15], axis=2).reshape(len(raw), -1)[:, :d]
    more = np.unpackbits(raw[:, 8 + (d + 1) // 2 :], axis=1)
    bits = np.concatenate([numbers >= 8, more.astype(bool)], axis=1)
    return bits, head[:, 0], head[:, 1], (numbers.astype(np.float32) - 7.5) * head[:, 1:]


def encode(vectors: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """Rows (rid, vec_id, embedding, dim, digest, packed, bands) of the usable vectors."""

    def work(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        at, units = unit_rows(batch.column(2))
        for d in sorted({len(u) for u in units}):
            own = [k for k, u in enumerate(units) if len(u) == d]
            flags, factor, turned = codes(np.array([units[k] for k in own]), max(1, -(-bits * bands // d)), seed)
            keys = flags[:, : bits * bands].reshape(len(own), bands, bits) @ (1 << np.arange(bits))
            rows = batch.take(pa.array(at[own]))
            raw = [np.array(v, dtype=np.float64).tobytes() for v in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns, pa.array([d] * len(own), pa.int32()), pa.array([xxhash.xxh3_128_digest(v) for v in raw], pa.binary()),
                    pa.array(pack(flags, factor, turned), pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int32())),
                ],
                names=["rid", "vec_id", "embedding", "dim", "digest", "packed", "bands"],
            )

    kind = vectors.schema["embedding"].dataType.simpleString()
    return map_batches(vectors, work, f"rid long, vec_id long, embedding {kind}, dim int, digest binary, packed binary, bands array<int>")


def first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs agree on none of the earlier bands' keys."""
    out = np.ones(len(a), dtype=bool)
    for s in range(0, len(a), 1 << 16):
        part = slice(s, s + (1 << 16))
        out[part] = ~(keys[a[part]] == keys[b[part]]).any(axis=1)
    return out


def band_keys(bits: np.ndarray, band: int, band_bits: int) -> np.ndarray:
    """Keys of the bands before this one."""
    return bits[:, : band_bits * band].reshape(len(bits), band, band_bits) @ (1 << np.arange(band_bits))


def open_rows(
    bits: np.ndarray, factor: np.ndarray, step: np.ndarray, turned: np.ndarray, own: np.ndarray, band: int, band_bits: int,
    same: bool, cosine: float, epsilon0: float,
) -> np.ndarray:
    """Rows of one block in a pair that the estimates leave open and that shares no earlier band.

    own: rows of the block's first part; with same they are all rows.
    """
    n, d = turned.shape
    left, right = (np.arange(n), np.arange(n)) if same else (np.flatnonzero(own), np.flatnonzero(~own))
    keys = band_keys(bits, band, band_bits)
    hit = np.zeros(n, dtype=bool)
    for s in range(0, len(left), STRIP):
        rows = left[s : s + STRIP]
        least = least_estimate(factor[rows], step[right].max(initial=0), cosine, d, epsilon0)
        near = estimate(bits[rows, :d], factor[rows], turned[right]) >= least[:, None]
        if same:
            near &= right[None, :] > rows[:, None]
        a, b = np.nonzero(near)
        a, b = rows[a], right[b]
        fresh = ~(hit[a] & hit[b])
        a, b = a[fresh], b[fresh]
        fresh = first_shared(keys, a, b)
        hit[a[fresh]] = hit[b[fresh]] = True
    return hit


def exact_links(
    units: np.ndarray, keys: np.ndarray, sizes: np.ndarray, reps: np.ndarray, own: np.ndarray, same: bool, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """(linked vectors of each row, label of each row) of one block, in double precision.

    A pair counts in the first band that it shares only, with the size of the other class.
    Classes of the same repeated id (reps, 0: none) do not link.
    """
    n = len(units)
    left, right = (np.arange(n), np.arange(n)) if same else (np.flatnonzero(own), np.flatnonzero(~own))
    count, parent = np.zeros(n, dtype=np.int64), np.arange(n)
    for s in range(0, len(left), STRIP):
        rows = left[s : s + STRIP]
        near = units[rows] @ units[right].T >= cosine
        if same:
            near &= right[None, :] > rows[:, None]
        a, b = np.nonzero(near)
        a, b = rows[a], right[b]
        fresh = first_shared(keys, a, b) & ((reps[a] == 0) | (reps[a] != reps[b]))
        a, b = a[fresh], b[fresh]
        merge_labels(parent, a, b)
        np.add.at(count, a, sizes[b])
        np.add.at(count, b, sizes[a])
    return count, parent


def near_vectors(
    vectors: DataFrame, cosine: float = 0.95, recall: float = 0.9999, epsilon0: float | None = None, seed: int = 7,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Links vectors of at least the given cosine; one row per input row.

    Returns the id, n_links (linked vectors), component_id (smallest id reachable)
    and kept (id = component_id).  Every reported link is exact.  A pair is found
    with at least the given probability (over the rotations) at the threshold, closer
    ones more surely: half of what may be lost is left to the bands, half to epsilon0,
    the half-width of the confidence interval in standard errors (by default from recall).

    Null, empty, zero and non-finite vectors and null ids link with nothing (a null
    id has a null component and is not kept).  Vectors of different lengths never
    link.  Rows that repeat an id do not link with each other; their links are
    added up on each of them.  Further columns are left out.  An empty table gives
    an empty result.

    Buckets get codes only.  The vectors themselves travel where a bucket's estimates
    leave them in an open pair, in the first band that the pair shares.  A bucket of over
    BLOCK_ROWS classes is compared by pairs of blocks.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    half = 1 - (1 - recall) / 2
    epsilon0 = epsilon_for(half) if epsilon0 is None else epsilon0
    bits, bands = bands_for(rows.count(), cosine, half)
    usable = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    coded = cut(encode(usable.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "embedding"), bits, bands, seed))
    repeated = coded.groupBy("vec_id").count().where("count > 1").select("vec_id", F.col("vec_id").alias("rep"))
    of_class = ["digest", "dim", "rep"]
    members = cut(coded.select("rid", "vec_id", "digest", "dim").join(cut(repeated), "vec_id", "left"))
    classes = cut(
        members.groupBy(*of_class).agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"))
    )
    codes_of = coded.select(F.col("rid").alias("node"), "packed", "bands")
    dealt = classes.join(codes_of, "node").select("dim", "node", "least", "rep", "size", "packed", F.posexplode("bands").alias("band", "key"))
    dealt = cut(dealt)
    hot = cut(
        dealt.groupBy("dim", "band", "key").count().where(F.col("count") > BLOCK_ROWS)
        .select("dim", "band", "key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("parts"))
    )
    block = ["dim", "band", "key", "lo", "hi"]
    carried = "part int, node long, least long, rep long, size long, packed binary"
    blocks = (
        dealt.join(hot, ["dim", "band", "key"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .select(*block, "part", "node", "least", "rep", "size", "packed")
    )

    def still_open(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        dim, band, _, lo, hi = (x.as_py() for x in key)
        own = rows["part"].to_numpy() == lo
        hit = open_rows(*unpack(rows["packed"].to_pylist(), dim), own, band, bits, lo == hi, cosine, epsilon0)
        return rows.filter(pa.array(hit))

    left_open = cut(blocks.groupBy(*block).applyInArrow(still_open, f"dim int, band int, key int, lo int, hi int, {carried}"))
    fetched = left_open.join(coded.select(F.col("rid").alias("node"), "embedding"), "node").select(*left_open.columns, "embedding")

    def compared(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        dim, band, _, lo, hi = (x.as_py() for x in key)
        rows = rows.combine_chunks()
        keys = band_keys(unpack(rows["packed"].to_pylist(), dim)[0], band, bits)
        units = np.array(unit_rows(rows["embedding"].combine_chunks())[1])
        sizes, reps = rows["size"].to_numpy(), rows["rep"].fill_null(0).to_numpy()
        reps = np.where(rows["rep"].is_null().to_numpy(zero_copy_only=False), 0, 2 * np.abs(reps) + 1 + (reps < 0))
        count, label = exact_links(units, keys, sizes, reps, rows["part"].to_numpy() == lo, lo == hi, cosine)
        hit = (count > 0) | (label != np.arange(len(units)))
        least = rows["least"].to_numpy()
        return pa.table({"node": rows["node"].to_numpy()[hit], "n": count[hit], "src": least[hit], "dst": least[label[hit]]})

    found = cut(fetched.groupBy(*block).applyInArrow(compared, "node long, n long, src long, dst long"))
    # A class of different ids also links within itself.
    inside = F.when(F.col("rep").isNull(), F.col("size") - 1).otherwise(0)
    others = found.groupBy("node").agg(F.sum("n").alias("n"))
    per_class = cut(classes.join(others, "node", "left").select(*of_class, "least", (F.coalesce("n", F.lit(0)) + inside).alias("n")))
    on = [members[c].eqNullSafe(per_class[c]) for c in of_class]
    joined = cut(members.join(per_class, on).select(members["vec_id"], per_class["least"], per_class["n"]))
    links = joined.groupBy("vec_id").agg(F.sum("n").alias("n"))
    edges = found.select("src", "dst").union(joined.select(F.col("vec_id").alias("src"), F.col("least").alias("dst")))
    parts = components(edges)
    for spent in (coded, members, classes, dealt, left_open):
        drop_table(spent)
    return (
        rows.select("vec_id").join(links, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            F.col("vec_id").alias(id_col),
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
        )
    )
