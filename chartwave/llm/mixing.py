"""Mixing sources to target weights by Pfair scheduling, in SQL functions only.

Each source's documents are put in a random but fixed order and cut into blocks.
In the ideal order every source advances steadily at its weight, and when one runs
out the others go on with their weights raised in proportion.  There the k-th block
of a source starts and ends at exact times: it is released at the slot in which it
starts and due by the slot in which it ends.  Taking in each slot the released block
that is due first keeps every source within less than one block of its ideal share,
from the first slot to the last.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

PERIOD = 1000
BLOCK_ROWS = 32
#: Blocks of the schedule: beyond BLOCK_ROWS times as many rows a block is that share of the table.
MOST_BLOCKS = 1 << 20
#: Rows of one bucket from which row numbers spread the rows, as they share an id or have none.
HOT_ROWS = 1 << 14
#: Rows ranked in one task at a time, whatever the size of a source.
BUCKET_ROWS = 256
#: Sources up to which the tables by source are always broadcast; where there are more, up to TABLE_BYTES.
MAX_SOURCES = 200
TABLE_BYTES = 64 << 20
#: Blocks of a source in one row of the schedule.
PIECE = 4096


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Shares of the period in proportion to the weights, one at least, by largest remainders."""
    total = sum(weights.values())
    exact = {s: 1 + (period - len(weights)) * w / total for s, w in weights.items()}
    shares = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (shares[s] - exact[s], s))[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, np.ndarray]:
    """Slots of each source's blocks in the whole order, earliest deadline first among the released.

    The weights are taken as they are.  Times within 1e-6 of a slot's edge count as on it.
    """
    names = sorted(blocks)
    n = np.array([blocks[s] for s in names], dtype=np.int64)
    w = np.array([weights[s] for s in names], dtype=np.float64)
    total = int(n.sum())
    if not total:
        return {s: np.zeros(0, dtype=np.int64) for s in names}
    # At progress v a source has placed min(n, w * v) blocks; all of them together give the slot.
    end = n / w
    by_end = np.argsort(end, kind="stable")
    rest = np.r_[np.cumsum(w[by_end][::-1])[::-1][1:], 0.0]
    slot_at = np.r_[0.0, np.cumsum(n[by_end]) + end[by_end] * rest]
    progress, last = np.r_[0.0, end[by_end]], np.r_[np.diff(end[by_end]) > 0, True]
    keep = np.r_[True, last]
    source = np.repeat(np.arange(len(n)), n)
    k = np.arange(total) - np.repeat(np.cumsum(n) - n, n)

    def slot_of(at: np.ndarray) -> np.ndarray:
        slots = np.interp(at / w[source], progress[keep], slot_at[keep])
        near = np.rint(slots)
        return np.where(np.abs(slots - near) < 1e-6, near, slots)

    release, due = np.floor(slot_of(k)).astype(np.int64), np.ceil(slot_of(k + 1)).astype(np.int64)
    order = np.argsort(release, kind="stable")
    release, keys = release[order].tolist(), (due * len(n) + source)[order].tolist()
    taken = np.zeros(total, dtype=np.int64)
    ready: list[int] = []
    at = 0
    for slot in range(total):
        while at < total and release[at] <= slot:
            heapq.heappush(ready, keys[at])
            at += 1
        taken[slot] = heapq.heappop(ready) % len(n)
    slots = np.split(np.argsort(taken, kind="stable"), np.cumsum(n)[:-1])
    return dict(zip(names, slots))


def edf_period(shares: dict[str, int], period: int) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of whole shares."""
    return {s: slots.tolist() for s, slots in schedule(shares, shares).items()}


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[dict]:
    """The whole schedule: the j-th block of a source is in slots[j].

    A source without a weight gets one slot of a period.
    """
    given = sum(w for w in weights.values() if w > 0)
    own = {s: weights[s] if weights[s] > 0 else given / period for s in blocks}
    total = sum(blocks.values())
    return [
        {"stream": s, "first": 0, "last": blocks[s], "start": 0, "period": total, "slots": slots.tolist()}
        for s, slots in schedule(blocks, own).items()
    ]


def tempered(counts: dict[str, int], alpha: float) -> dict[str, float]:
    """Weights in proportion to the sources' sizes to the power alpha."""
    return {s: n**alpha for s, n in counts.items()}


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, block_rows: int | None = None,
    period: int = PERIOD, seed: int = 5, source_col: str = "source", max_sources: int = MAX_SOURCES,
    ordered: bool = False,
) -> DataFrame:
    """The input rows with mix_block (number of the row's block within its source), mix_slot
    (the block's place in the mixed order) and mix_place (the row's place in its block).

    weights: the wanted share of each source, in any unit; a source without one gets
    one slot in `period` (or in four times the number of sources, if more).  Without weights they follow the sources' sizes to the
    power alpha.  In every prefix of the order each source's blocks differ from its share
    by less than one; every row is placed exactly once, and a source's last block may be
    shorter.  A block has block_rows rows; by default BLOCK_ROWS, or a share of
    1 / MOST_BLOCKS of the table if that is more, so the schedule, which the driver
    computes, has a bounded number of blocks at every size.

    A null source is a source of its own.  Rows are ordered by a hash of doc_id, then
    doc_id; repeated and null ids follow each other in any order.  If over HOT_ROWS rows
    of one bucket share an id or have none, the table is written once with row numbers
    and these join the hash, so that no task gets all such rows.  Texts of any length
    only travel along.  Columns of the input named like the new ones are replaced.  An
    empty table gives an empty result.

    Every source is a stream of its own, however many there are.  max_sources: up to so
    many, tables by source are always broadcast; beyond, only small ones are.

    With ordered the rows are also laid out in the mixed order: each partition holds
    an equal range of slots, and its rows are sorted.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), F.col("doc_id").cast("string").alias("id"))
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    spread = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 33)
    rows = rows.select("row", "id", name.alias("stream"), spread.alias("spread"))
    counts = {r.stream: r.n for r in rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = tempered(counts, alpha) if weights is None else {s: weights.get(s[1:], 0.0) for s in counts}
    if weights is not None and not sum(wanted.values()):
        wanted = {s: 1.0 for s in counts}
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // MOST_BLOCKS))
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, wanted, max(period, 4 * len(counts)))

    # A row's rank in its source: its bucket's rows follow those of all earlier buckets.
    spark, few = docs.sparkSession, len(counts) <= max_sources
    names = list(counts)
    buckets = pa.table({"stream": pa.array(names, pa.string()), "buckets": pa.array([-(-counts[s] // BUCKET_ROWS) for s in names], pa.int64())})
    rows = rows.join(by_source(spark, buckets, few), "stream")
    bucket = F.shiftright(F.col("spread") * F.col("buckets"), 31)
    sizes = rows.groupBy("stream", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    if sizes.where(F.col("n") > HOT_ROWS).limit(1).count():
        numbered = cut(rows.withColumn("number", F.monotonically_increasing_id()))
        rows = numbered.withColumn("spread", F.shiftrightunsigned(F.xxhash64("id", "number", F.lit(seed)), 33)).drop("number")
    rows = rows.withColumn("bucket", bucket).drop("buckets")
    sizes = rows.groupBy("stream", "bucket").agg(F.count(F.lit(1)).alias("n"))
    group = F.shiftright("bucket", 10)
    small = Window.partitionBy("stream", group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    large = Window.partitionBy("stream").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("stream", group.alias("group")).agg(F.sum("n").alias("n"))
    groups = groups.select("stream", "group", F.coalesce(F.sum("n").over(large), F.lit(0)).alias("earlier"))
    before = (
        sizes.withColumn("inside", F.coalesce(F.sum("n").over(small), F.lit(0))).withColumn("group", group)
        .join(groups, ["stream", "group"])
        .select("stream", "bucket", (F.col("earlier") + F.col("inside")).alias("before"))
    )
    inside = Window.partitionBy("stream", "bucket").orderBy("spread", "id")
    ranked = (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(before, ["stream", "bucket"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .withColumn("block", F.expr(f"rank div {int(block_rows)}"))
    )
    k = F.col("block")
    placed = ranked.withColumn("piece", F.expr(f"block div {PIECE}")).join(by_source(spark, pieces(plan), few), ["stream", "piece"])
    slot = F.get("slots", F.expr(f"CAST(block % {PIECE} AS INT)"))
    new = ("mix_block", "mix_slot", "mix_place")
    if ordered:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = max(1, sum(-(-n // block_rows) for n in counts.values()))
        placed = placed.withColumn("slot", slot.cast("long")).withColumn("place", F.col("rank") % block_rows)
        placed = placed.repartitionById(parts, F.expr(f"CAST(slot * {parts} div {total} AS INT)"))
        placed = placed.sortWithinPartitions("slot", "place")
        slot = F.col("slot")
    return placed.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new],
        k.alias("mix_block"), slot.cast("long").alias("mix_slot"), (F.col("rank") % block_rows).cast("int").alias("mix_place"),
    )


def pieces(plan: list[dict]) -> pa.Table:
    """The schedule as rows (stream, piece, slots): slots of PIECE blocks of a source."""
    cut = [(r["stream"], i // PIECE, r["slots"][i : i + PIECE]) for r in plan for i in range(0, r["last"], PIECE)]
    kinds = {"stream": pa.string(), "piece": pa.int64(), "slots": pa.list_(pa.int64())}
    return pa.table({n: pa.array([row[i] for row in cut], kind) for i, (n, kind) in enumerate(kinds.items())})


def by_source(spark: SparkSession, table: pa.Table, few: bool) -> DataFrame:
    """A table by source as a frame to join with, broadcast unless it is large."""
    frame = spark.createDataFrame(table)
    return F.broadcast(frame) if few or table.nbytes <= TABLE_BYTES else frame
