"""Near-duplicate texts by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints within r differing bits of each other agree wholly on some r-free
choice of blocks, so they are dealt out by the values of such choices (the
pigeonhole rule: no pair is lost).  Inside such a run the fingerprints are sorted
by Gray rank, where neighbours tend to share bits.  An index is built bottom-up:
a node stores as a masked pattern the bits that all its members share and that no
node above stores already.  A search goes down from the root, adds up the
differences to the patterns met, and drops a whole group once the sum exceeds r.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, cut, drop_table, map_batches, merge_labels, utf8

SEED = 42
FANOUT = 8
#: Fingerprints of one run searched in one task; longer runs are dealt out again.
RUN_ROWS = 4096
#: Pairs of a query and a code that a search holds at a time.
PAIRS = 1 << 18
#: Fingerprints of a sketch that travel with the bands: 512 bits.
KEPT = 8
#: Shingles of a set up to which its pairs are found by an exact join; sketches of so few hashes vary too much.
SMALL = 32
#: Shingle sets of one block in the exact comparison.
SET_BYTES = 24 << 20


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of the word shingles of a UTF-8 text, repeats included; fewer words are one shingle."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(tokens) - words + 1)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    return np.fromiter((digest(view[s:e], SEED) for s, e in spans), dtype="<u8", count=n)


#: Bit b of byte value v.
BITS_OF = (np.arange(256)[:, None] >> np.arange(8)) & 1


def majority(hashes: np.ndarray) -> int:
    """64-bit code: a bit is 1 if more than half the hashes have it.

    The bytes at each of the eight places are counted by value, and the counts give
    the bits: far fewer steps than one for each bit of each hash.
    """
    values = hashes.view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int64) * 256
    counts = np.bincount(values.ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits((2 * (counts @ BITS_OF) > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int) -> int:
    """64-bit SimHash of the word shingles (repeats count) of a UTF-8 text; no word: 0."""
    hashes = shingle_hashes(text, words)
    return majority(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t, words) for t in utf8(batch.column(1))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """The hierarchical index over fingerprints sorted by Gray rank."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.codes, self.fanout = codes, fanout
        mask, pattern = [np.full(len(codes), 2**64 - 1, dtype=np.uint64)], [codes]
        while len(mask[-1]) > 1:
            at = np.arange(0, len(mask[-1]), fanout)
            every = np.bitwise_and.reduceat(pattern[-1], at)
            any_ = np.bitwise_or.reduceat(pattern[-1], at)
            shared = np.bitwise_and.reduceat(mask[-1], at) & ~(every ^ any_)
            mask.append(shared)
            pattern.append(every & shared)
        #: What a node adds to its parent: bits factored out above are not stored again.
        self.levels = []
        for level in range(len(mask)):
            own = mask[level]
            if level + 1 < len(mask):
                own = own & ~np.repeat(mask[level + 1], fanout)[: len(own)]
            self.levels.append((own, pattern[level]))

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, code position) within the radius."""
        query = np.arange(len(queries))
        node = np.zeros(len(queries), dtype=np.int64)
        total = np.zeros(len(queries), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[level]
            total = total + np.bitwise_count((queries[query] ^ pattern[node]) & mask[node])
            alive = total <= radius
            query, node, total = query[alive], node[alive], total[alive]
            if level:
                below = node[:, None] * self.fanout + np.arange(self.fanout)
                inside = below < len(self.levels[level - 1][0])
                query, total = np.repeat(query, inside.sum(1)), np.repeat(total, inside.sum(1))
                node = below[inside]
        return query, node


def run_stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, another one) that join what is within the radius in one run.

    So few queries are searched at a time that even if all codes were near each other, PAIRS of them would be held.
    """
    strip = max(1, min(512, PAIRS // max(1, len(fps))))
    codes = fps[np.argsort(gray_rank(fps), kind="stable")]
    index = GrayIndex(codes)
    label = np.arange(len(codes))
    for s in range(0, len(codes), strip):
        a, b = index.search(codes[s : s + strip], radius)
        merge_labels(label, a[b > a + s] + s, b[b > a + s])
    hit = label != np.arange(len(codes))
    return codes[hit], codes[label[hit]]


def choices(width: int, radius: int, blocks: int) -> list[int]:
    """Masks over the lowest `width` bits: two codes within the radius agree on one of them."""
    cuts = [width * i // blocks for i in range(blocks + 1)]
    masks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(kept) for kept in combinations(masks, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spread(x: int, over: int) -> int:
    """The lowest bits of x, moved to the places of the ones of `over`."""
    out, at = 0, 0
    for bit in range(64):
        if over >> bit & 1:
            out |= (x >> at & 1) << bit
            at += 1
    return out


def link_fingerprints(distinct: DataFrame, radius: int) -> DataFrame:
    """Star links (src, dst) between distinct fingerprints (column fp) within the radius.

    Runs of over RUN_ROWS fingerprints are dealt out again by further blocks of the
    bits that the run leaves open, by the same rule, so no pair is lost.
    """
    first = choices(64, radius, radius + 2)
    masks = F.array(*[F.lit(signed(m)) for m in first])
    dealt = distinct.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "fp", "choice", F.lit(-1).alias("again"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    )
    sizes = cut(dealt.groupBy("choice", "key").count().where("count > 1"))
    full = 2**64 - 1
    further = [
        [signed(m | spread(c, full & ~m)) for c in choices(bin(full & ~m).count("1"), radius, radius + 2)] for m in first
    ]
    table = F.array(*[F.array(*[F.lit(m) for m in own]) for own in further])
    runs = dealt.join(sizes, ["choice", "key"])
    long_runs = (
        runs.where(F.col("count") > RUN_ROWS)
        .select("fp", "choice", F.posexplode(F.get(table, F.col("choice"))).alias("again", "mask"))
        .select("fp", "choice", "again", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    )
    runs = runs.where(F.col("count") <= RUN_ROWS).select("fp", "choice", "again", "key").union(long_runs)
    bounded_batches(distinct.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def flush() -> pa.RecordBatch:
            src, dst = run_stars(np.concatenate(held), radius)
            return pa.RecordBatch.from_arrays(
                [pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            run = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3)], axis=1)
            fps = batch.column(0).to_numpy().view(np.uint64)
            starts = np.r_[0, np.flatnonzero((run[1:] != run[:-1]).any(axis=1)) + 1]
            for s, e in zip(starts, [*starts[1:], len(fps)]):
                if last is not None and tuple(run[s]) != last:
                    yield flush()
                    held.clear()
                last = tuple(run[s])
                held.append(fps[s:e].copy())
        if held:
            yield flush()

    keys = ["choice", "again", "key"]
    return runs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "src long, dst long")


def near_texts(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Links documents whose SimHash fingerprints differ in `radius` bits or fewer.

    Returns per input row doc_id, fingerprint (16 lowercase hex digits) and
    component_id (the smallest doc_id reachable, itself included).  Texts are
    lower-cased in A-Z; words are runs other than space, tab, LF, VT, FF and CR.
    Fewer words than a shingle has: the whole sequence is one shingle; a null or
    empty text has fingerprint zero and links like any other.

    Copies have one fingerprint, and only distinct fingerprints are compared.  Rows
    that repeat a doc_id are fingerprinted each; a null doc_id is ignored as a
    component's smallest id (a component of nulls only has null).  Further columns
    are left out; an empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, words))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    links = link_fingerprints(classes.select("fp"), radius)
    parts = components(links)
    of = classes.join(parts, classes["fp"] == parts["node"], "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("part")
    )
    of = cut(of)
    least = of.groupBy("part").agg(F.min("least_id").alias("component_id"))
    of = of.join(least, "part").select("fp", "component_id")
    return fps.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of each shingle, from its first one (a 64-bit finaliser)."""
    x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray, parts: int) -> np.ndarray:
    """`parts` SimHash fingerprints of a set of shingle hashes, by independent hashes."""
    if not len(hashes):
        return np.zeros(parts, dtype="<u8")
    return np.array([majority(mixed(hashes, k)) for k in range(parts)], dtype="<u8")


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two sets of that Jaccard similarity, at most (equal sizes)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def uneven_share(common: int, left: int, right: int) -> float:
    """Expected share of differing bits of two sets with so many common and own hashes."""

    def halves(n: int) -> np.ndarray:
        return np.array([math.comb(n, i) for i in range(n + 1)], dtype=np.float64) / 2.0**n

    def set_bit(own: int) -> np.ndarray:
        p = halves(own)
        return np.array([p[[2 * (i + j) > common + own for j in range(own + 1)]].sum() for i in range(common + 1)])

    x, y = set_bit(left), set_bit(right)
    return float((halves(common) * (x * (1 - y) + y * (1 - x))).sum())


@lru_cache
def largest_share(similarity: float) -> float:
    """Largest expected share of differing bits of two sets of over SMALL hashes and at least that similarity.

    The share falls towards differing_share with the size, so sizes up to twice SMALL decide.
    """
    worst = differing_share(similarity)
    for a in range(SMALL + 1, 2 * SMALL + 1):
        for b in range(a, int(a / similarity + 1e-9) + 1):
            for common in range(math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9), a + 1):
                worst = max(worst, uneven_share(common, a - common, b - common))
    return worst


def sketch_plan(n_docs: int, similarity: float, recall: float) -> tuple[int, int, int]:
    """(bits of a band, bands, fingerprints): a pair at the threshold shares a band with the wanted probability.

    Half of what may be lost is left to open_bits.
    """
    bits = min(24, max(8, math.ceil(math.log2(n_docs / 64 + 1))))
    bands = math.ceil(math.log((1 - recall) / 2) / math.log(1 - (1 - largest_share(similarity)) ** bits))
    return bits, bands, max(KEPT, -(-bits * bands // 64))


def open_bits(width: int, similarity: float) -> int:
    """Differing bits out of `width` that hardly any pair at the threshold exceeds."""
    share = largest_share(similarity)
    return min(width, math.ceil(width * share + 4.5 * math.sqrt(width * share * (1 - share))))


def stars(label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each labelled position to the first of its set."""
    hit = label != np.arange(len(ids))
    return ids[hit], ids[label[hit]]


def near_pairs(sketches: np.ndarray, left: np.ndarray, same: bool, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, ordered by the Gray rank of the first fingerprint, that the sketches leave open.

    Candidates come from the Gray-order index over the first fingerprints.  Unless same,
    only pairs across left and the rest count.
    """
    first, most = open_bits(64, similarity), open_bits(64 * KEPT, similarity)
    index = GrayIndex(sketches[:, 0].copy())
    for s in range(0, len(sketches), 512):
        a, b = index.search(sketches[s : s + 512, 0].copy(), first)
        a = a + s
        wanted = (b > a) if same else (left[a] & ~left[b])
        a, b = a[wanted], b[wanted]
        for t in range(0, len(a), 65536):
            x, y = a[t : t + 65536], b[t : t + 65536]
            near = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64) <= most
            yield x[near], y[near]


def open_run(ids: np.ndarray, sketches: np.ndarray, left: np.ndarray, same: bool, similarity: float) -> tuple:
    """Star links that join the rows of one run that the sketches leave open."""
    order = np.argsort(gray_rank(sketches[:, 0]), kind="stable")
    ids, sketches, left = ids[order], sketches[order], left[order]
    label = np.arange(len(ids))
    for a, b in near_pairs(sketches, left, same, similarity):
        merge_labels(label, a, b)
    return stars(label, ids)


def exact_run(
    ids: np.ndarray, sketches: np.ndarray, left: np.ndarray, same: bool, similarity: float, sets: list[np.ndarray]
) -> tuple:
    """Star links that join the rows of one run whose shingle sets are similar, computed exactly.

    A pair that earlier links have joined already is not computed: links decide groups only.
    """
    order = np.argsort(gray_rank(sketches[:, 0]), kind="stable")
    ids, sketches, left, sets = ids[order], sketches[order], left[order], [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets])
    label = np.arange(len(ids))
    for a, b in near_pairs(sketches, left, same, similarity):
        fits = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
        a, b = a[fits], b[fits]
        while len(a):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            now = list(zip(a[:64].tolist(), b[:64].tolist()))
            shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in now])
            near = shared >= similarity * (sizes[a[:64]] + sizes[b[:64]] - shared) - 1e-9 if now else np.zeros(0, dtype=bool)
            merge_labels(label, a[:64][near], b[:64][near])
            a, b = a[64:], b[64:]
    return stars(label, ids)


def small_run(ids: np.ndarray, left: np.ndarray, same: bool, similarity: float, sets: list[np.ndarray]) -> tuple:
    """Star links that join the rows of one run whose shingle sets are similar, from the sets alone."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.split(np.repeat(np.arange(len(ids)), sizes)[np.argsort(codes, kind="stable")], np.cumsum(np.bincount(codes))[:-1])
    label = np.arange(len(ids))
    for i, own in enumerate(np.split(codes, np.cumsum(sizes)[:-1])):
        shared = np.zeros(len(ids), dtype=np.int64)
        for code in own.tolist():
            shared[holders[code]] += 1
        near = shared >= similarity * (sizes + sizes[i] - shared) - 1e-9
        if not same:
            near &= left != left[i]
            near[i] = True
        met = np.unique(label[near])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return stars(label, ids)


def run_links(rows: DataFrame, keys: list[str], with_sets: bool, similarity: float, small: bool = False) -> DataFrame:
    """Star links (src, dst) found in each run of rows (keys, lo, hi, part, node, digest, sketch and, to be exact, shingles).

    Rows that repeat a node with the same text count once.  Small sets are compared without their sketches.
    """
    names = [*keys, "lo", "hi"]
    n = len(names)
    bounded_batches(rows.sparkSession)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, text = None, None

        def flush() -> pa.RecordBatch:
            part, ids = (np.array([row[i] for row in held], dtype=np.int64) for i in (0, 1))
            sketches = np.frombuffer(b"".join(row[2] for row in held), dtype="<u8").reshape(-1, KEPT)
            same, left = last[-1] == last[-2], part == last[-2]
            src, dst = [], []
            if len(held) > 1 and with_sets:
                sets = [np.frombuffer(row[3], dtype="<u8") for row in held]
                src, dst = small_run(ids, left, same, similarity, sets) if small else exact_run(ids, sketches, left, same, similarity, sets)
            elif len(held) > 1:
                src, dst = open_run(ids, sketches, left, same, similarity)
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[:n] != last:
                    if held:
                        yield flush()
                        held.clear()
                    last, text = row[:n], None
                if text != row[n + 1 : n + 3]:
                    text = row[n + 1 : n + 3]
                    held.append((row[n], row[n + 1], *row[n + 3 :]))
        if held:
            yield flush()

    wanted = [*names, "part", "node", "digest", "sketch", *(["shingles"] if with_sets else [])]
    dealt = rows.select(*wanted).repartition(*names).sortWithinPartitions(*names, "node", "digest")
    return dealt.mapInArrow(link, "src long, dst long")


def dealt_in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with a number of blocks `cuts`, once for each pair of blocks (lo, hi) that their own block `part` is in."""
    return (
        rows.withColumn("part", F.pmod(F.xxhash64("node", "digest"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
    )


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """Links documents whose word shingle sets have at least the given Jaccard similarity.

    Every link is confirmed on the exact sets (as 64-bit shingle hashes).  A pair whose
    smaller set has at most SMALL shingles is always found: such sets meet by the shingles
    of smallest hash, of which similar sets share one.  Candidates among larger sets come
    from several SimHash fingerprints: bands of their bits deal documents into runs, where
    a pair at the threshold meets with at least the given probability and closer pairs more
    surely.  In a run the Gray-order index proposes pairs, and 512 bits of the sketch leave
    those open that are within 4.5 standard errors of the threshold.  Groups of open pairs
    get their shingle sets and are compared exactly, large groups in blocks.

    Returns per input row with an id doc_id and component_id (the smallest doc_id
    reachable, itself included).  Rows without an id are left out.  Null texts and texts
    without a word are alike.  Rows that repeat an id are one document with several
    texts.  Further columns are left out; an empty table gives an empty result.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    narrow = narrow.where("doc_id IS NOT NULL")
    bits, bands, parts = sketch_plan(narrow.count(), similarity, recall)
    most = int(SMALL / similarity + 1e-9)

    def work(batch: pa.RecordBatch):
        digests, sizes, rows, small = [], [], [], []
        for text in utf8(batch.column(1)):
            hashes = np.unique(shingle_hashes(text, words))
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            sizes.append(len(hashes))
            rows.append(sketch(hashes if len(hashes) > SMALL else hashes[:0], parts))
            small.append(hashes.tobytes() if len(hashes) <= most else None)
        if rows:
            flags = np.unpackbits(np.array(rows).view(np.uint8), axis=1, bitorder="little")
            keys = flags[:, : bits * bands].reshape(len(rows), bands, bits) @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array([r[:KEPT].tobytes() for r in rows], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int32())),
                    pa.array(small, pa.binary()),
                ],
                names=["doc_id", "digest", "size", "sketch", "bands", "shingles"],
            )

    coded = cut(map_batches(narrow, work, "doc_id long, digest binary, size long, sketch binary, bands array<int>, shingles binary"))
    classes = cut(
        coded.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"),
            F.first("shingles").alias("shingles"),
        )
    )
    dealt = classes.where(F.col("size") > SMALL).select("node", "digest", "sketch", F.posexplode("bands").alias("band", "key"))
    hot = cut(
        dealt.groupBy("band", "key").count().where(F.col("count") > RUN_ROWS)
        .select("band", "key", F.ceil(F.col("count") / RUN_ROWS).cast("int").alias("cuts"))
    )
    rows = dealt.join(hot, ["band", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    candidates_in = cut(run_links(dealt_in_blocks(rows), ["band", "key"], False, similarity))
    candidates = components(candidates_in)
    found = confirmed(narrow, classes.drop("bands", "shingles"), candidates, words, similarity).union(small_links(classes, similarity))

    # Copies share a digest, and a repeated id may hold several.
    same = coded.select("doc_id", "digest").distinct().join(classes.select("digest", "node"), "digest")
    same = same.where("doc_id <> node").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    parts_of = components(found.union(same))
    for spent in (classes, hot, candidates_in):
        drop_table(spent)
    return coded.select("doc_id").join(parts_of.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id")
    )


def small_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Exact star links (src, dst) of the similar pairs of classes whose smaller set has at most SMALL shingles.

    Sets are stored in the order of their hashes.  Similar sets share one of the first
    n - ceil(similarity * n) + 1 of each, so they are dealt by these; long runs in blocks.
    """
    first = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - 1e-9) + 1
    key = F.transform(F.sequence(F.lit(0), (first - 1).cast("int")), lambda i: F.substring("shingles", i * 8 + 1, F.lit(8)))
    dealt = classes.where("shingles IS NOT NULL AND size > 0").select("node", "digest", "sketch", "shingles", F.explode(key).alias("key"))
    met = dealt.groupBy("key").count().where("count > 1")
    met = cut(met.select("key", F.ceil(F.col("count") / RUN_ROWS).cast("int").alias("cuts")))
    return cut(run_links(dealt_in_blocks(dealt.join(met, "key")), ["key"], True, similarity, small=True))


def confirmed(texts: DataFrame, classes: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """Exact star links (src, dst) inside the groups (node, component) of candidates.

    Only texts in such a group are read again.  A group whose shingle sets take over
    SET_BYTES is compared by pairs of blocks.
    """
    members = cut(classes.join(candidates, "node"))
    cuts = members.groupBy("component").agg(F.ceil(F.sum("size") * 8 / SET_BYTES).cast("int").alias("cuts"))
    members = cut(members.join(cuts.withColumn("cuts", F.greatest("cuts", F.lit(1))), "component").drop("size"))

    def work(batch: pa.RecordBatch):
        keep, sets = [], []
        for i, (text, digest) in enumerate(zip(utf8(batch.column(0)), batch.column(1).to_pylist())):
            hashes = np.unique(shingle_hashes(text, words))
            if xxhash.xxh3_128_digest(hashes.tobytes()) == digest:
                keep.append(i)
                sets.append(hashes.tobytes())
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns[1:], pa.array(sets, pa.binary())], names=[*kept.schema.names[1:], "shingles"]
        )

    joined = texts.join(members, texts["doc_id"] == members["node"]).select("text", "digest", "sketch", "node", "component", "cuts")
    rows = map_batches(joined, work, "digest binary, sketch binary, node long, component long, cuts int, shingles binary")
    return cut(run_links(dealt_in_blocks(rows), ["component"], True, similarity))
