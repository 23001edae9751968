"""Line dedup with two Bloom filters for hashes seen once and seen twice.

The hash space is cut into ranges of a bounded number of lines.  Each range has a once
and a twice filter: a hash whose cells are all set in the once filter goes to the twice
filter.  Every document's line hashes travel to their range twice, first to fill the
filters and then to be looked up.  Lines outside the twice filter were certainly seen in
one document only and go no further.  The others are suspected repeats: they alone are
counted exactly, and the largest doc_id that holds them keeps them.

Lines are told apart by a 128-bit cryptographic digest, of which the filters use 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_table, slices, utf8

#: Cells of each of the two filters of a range, and the lines that a range should have: what a task holds
#: at a time has one size for any table.
RANGE_CELLS = 1 << 22
RANGE_LINES = RANGE_CELLS // 8
#: Digests that a task remembers, so that a line met again and again does not travel each time.
REMEMBERED = 10_000


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(b" \t\n\r\x0b\x0c").lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def digest_of(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def document_digests(text: bytes | None, least: int) -> set[bytes]:
    """Digests of the distinct keys of a text that are long enough."""
    keys = {line_key(x) for x in (text or b"").split(b"\n")}
    return {digest_of(k) for k in keys if long_enough(k, least)}


def places(digests: list[bytes], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(range, hash) of each digest."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    part = (words[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return part.astype(np.int32), words[:, 1].view(np.int64)


def cells_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash in the filters of its range."""
    h = hashes.view(np.uint64)
    return (h & np.uint64(RANGE_CELLS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(RANGE_CELLS - 1)).astype(np.int64)


def bit(packed: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


class Memory:
    """How often a task has met a digest, up to REMEMBERED of them; then it starts anew."""

    def __init__(self):
        self.met: dict[bytes, int] = {}

    def count(self, digest: bytes) -> int:
        n = self.met.get(digest, 0)
        if len(self.met) >= REMEMBERED:
            self.met.clear()
        self.met[digest] = n + 1
        return n


def twice_filters(docs: DataFrame, ranges: int, least: int) -> DataFrame:
    """Rows (part, bits): the twice filter of each range of hashes of the column text."""
    bounded_batches(docs.sparkSession)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            for few in slices(batch, 0):
                # Two documents say all that the filters ask about a digest.
                found = [d for text in utf8(few.column(0)) for d in document_digests(text, least) if memory.count(d) < 2]
                part, h = places(found, ranges)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(h)], names=["part", "hash"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        last = None

        def filled() -> pa.RecordBatch:
            bits = pa.array([np.packbits(twice).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), bits], names=["part", "bits"])

        for batch in batches:
            parts, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.r_[0, np.flatnonzero(parts[1:] != parts[:-1]) + 1] if len(parts) else []
            for s, e in zip(starts, [*starts[1:], len(parts)]):
                if parts[s] != last:
                    if last is not None:
                        yield filled()
                    last = int(parts[s])
                    once, twice = np.zeros(RANGE_CELLS, dtype=bool), np.zeros(RANGE_CELLS, dtype=bool)
                own, n = np.unique(rows[s:e], return_counts=True)
                x, y = cells_of(own)
                again = (n > 1) | (once[x] & once[y])
                twice[x[again]] = twice[y[again]] = True
                once[x] = once[y] = True
        if last is not None:
            yield filled()

    dealt = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(hashes, "part int, hash long")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(fill, "part int, bits binary")


def suspected_lines(docs: DataFrame, min_chars: int, ranges: int) -> DataFrame:
    """Rows (digest, doc_id, row), once per document: lines that the twice filters do not rule out.

    row is a hash of the text: it tells rows of one id apart, and spreads those without an id.
    """
    filters = cut(twice_filters(docs, ranges, min_chars))
    schema = "part int, bits binary, digest binary, doc_id long, row long"

    def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            for few in slices(batch, 1):
                yield asked(few, memory)

    def asked(batch: pa.RecordBatch, memory: Memory) -> pa.RecordBatch:
        found, at, sure = [], [], []
        for i, text in enumerate(utf8(batch.column(1))):
            own = document_digests(text, min_chars)
            found += own
            at += [i] * len(own)
            # Met before by this task: a repeat for certain, for any task to pass on.
            sure += [memory.count(d) > 0 for d in own]
        part, h = places(found, ranges)
        sure, at = np.array(sure, dtype=bool), pa.array(at, pa.int64())
        # Of each line's document only the id and the hash are fetched, never the text.
        doc_id, row = batch.column(0).take(at), batch.column(2).take(at)
        part = np.where(sure, (h ^ row.to_numpy()) % ranges, part) if len(found) else part
        known = pa.array([b"" if s else None for s in sure], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), known, pa.array(found, pa.binary()), doc_id, row],
            names=["part", "bits", "digest", "doc_id", "row"],
        )

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, twice = None, None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            starts = np.r_[0, np.flatnonzero(parts[1:] != parts[:-1]) + 1] if len(parts) else []
            for s, e in zip(starts, [*starts[1:], len(parts)]):
                run = batch.slice(s, e - s)
                if parts[s] != last:
                    last, twice = parts[s], None
                if not run.column(2)[0].is_valid:  # the filter of the range comes first
                    twice = np.frombuffer(run.column(1)[0].as_py(), dtype=np.uint8)
                    run = run.slice(1)
                if run.num_rows:
                    x, y = cells_of(places(run.column(2).to_pylist(), ranges)[1])
                    known = run.column(1).is_valid().to_numpy(zero_copy_only=False)
                    stays = known | (True if twice is None else bit(twice, x) & bit(twice, y))
                    yield pa.RecordBatch.from_arrays(run.filter(pa.array(stays)).columns[2:], names=["digest", "doc_id", "row"])

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("row"))
    none = F.lit(None)
    first = filters.select("part", "bits", none.cast("binary").alias("digest"), none.cast("long").alias("doc_id"), none.cast("long").alias("row"))
    both = narrow.mapInArrow(lookups, schema).union(first)
    suspects = cut(both.repartition("part").sortWithinPartitions("part", F.col("digest").isNotNull()).mapInArrow(pass_on, "digest binary, doc_id long, row long"))
    drop_table(filters)
    return suspects


def without_lines(text: pa.Array, drops: pa.Array) -> pa.Array:
    """The text without the lines of the given keys, with its lines counted before."""
    texts, counts, dropped = [], [], []
    for i in range(len(text)):
        t, gone = utf8(text.slice(i, 1))[0], set(drops[i].as_py() or ())
        lines = (t or b"").split(b"\n") if gone else ()
        kept = [x for x in lines if digest_of(line_key(x)) not in gone]
        texts.append(b"\n".join(kept) if gone and t is not None else t)
        counts.append(len(lines) if gone else 1 + (t or b"").count(b"\n"))
        dropped.append(len(lines) - len(kept))
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
        names=["text", "n_lines", "n_dropped"],
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, range_lines: int = RANGE_LINES) -> DataFrame:
    """The input rows with repeated lines dropped from text, plus n_lines and n_dropped.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
    Keys of at least min_chars code points found in at least min_docs documents lose
    all their lines except those in the largest doc_id that holds them.

    A null or empty text is one empty line and stays as it is.  Each input row is a
    document of its own; rows that share the largest doc_id all keep the line, and
    rows that share another doc_id each lose their repeated lines.  Rows with a null
    doc_id count, and lose a repeated line unless no row that holds it has an id.
    Texts of any length are read whole.  Other columns stay; columns named n_lines or
    n_dropped are replaced.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n_lines = docs.select(F.col("text").cast("string").alias("text")).agg(F.sum(breaks + 1)).first()[0] or 0
    suspects = suspected_lines(docs, min_chars, max(1, -(-n_lines // range_lines)))
    # Written first, so that both sides of the join below are plain and a line that very
    # many documents hold can be split over tasks.
    repeated = cut(
        suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .where((F.col("n") >= min_docs) & F.col("keeper").isNotNull())
        .select("digest", "keeper")
    )
    drops = (
        suspects.join(repeated, "digest")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("dropper"), F.col("row").alias("dropping")).agg(F.collect_set("digest").alias("keys"))
    )
    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("own"))
    drop = F.arrow_udf(without_lines, "text string, n_lines long, n_dropped long")
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("dropper")) & (F.col("own") == F.col("dropping")), "left")
    done = joined.select("row", drop(F.col("row.text").cast("string"), "keys").alias("done"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(
        *[(F.col("done.text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in kept],
        "done.n_lines", "done.n_dropped",
    )
