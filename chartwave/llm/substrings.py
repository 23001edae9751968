"""Substring dedup with difference-cover anchors: words inside windows that an earlier document holds go.

COVER holds, for each distance modulo PERIOD, two of its members so far apart.  Anchors are
runs of `words - PERIOD + 1` words that start at positions whose remainder is in COVER, so
two equal windows of `words` words, wherever they start, hold an equal anchor at the same
place: only a fifth of all positions is hashed and shipped.  An anchor of a single text
rules out that its windows are shared.  Around the other anchors the match is extended to
all windows that contain one, which are told apart by a 128-bit digest of their words; the
smallest doc_id that holds a window keeps it.

Rows of equal text are one class, whose smallest doc_id stands for all: the others lose
every window.  So a group of copies of any size costs one row each, and what is shipped
grows with the number of windows, never with the pairs of documents that share them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_table, slices, utf8

#: A perfect difference set: each distance from 1 to 30 modulo 31 is that of exactly one ordered pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words whose digests a task remembers; then it starts anew.
REMEMBERED = 100_000
#: Windows of one batch that a task gives back.
WINDOWS = 1 << 17


class Words(dict):
    """Digests (16 bytes) of words, remembered."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = digest = xxhash.xxh3_128_digest(word)
        return digest

    def digests(self, text: bytes | None) -> np.ndarray:
        """Two 64-bit numbers for each word of the text."""
        words = text.split() if text else []
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u8").reshape(-1, 2)


def weights(n: int) -> np.ndarray:
    """Two odd random 64-bit factors for each place of a run of n words."""
    return np.random.default_rng(n).integers(0, 1 << 63, size=(n, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_digests(digests: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for the run of n words at each of the given positions."""
    out = np.zeros((len(at), 2), dtype=np.uint64)
    for i, w in enumerate(weights(n)):
        # Each place has factors of its own, and its product is mixed before it is added.
        part = digests[at + i] * w
        out += part ^ (part >> np.uint64(32))
    return out


def anchor_places(n_words: int, words: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Positions of the anchors of a text, in order."""
    starts = np.arange(0, max(0, n_words - (words - period)), dtype=np.int64)
    return starts[np.isin(starts % period, cover)]


def anchors(digests: np.ndarray, words: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a text that has a window."""
    at = anchor_places(len(digests), words, period, cover) if len(digests) >= words else np.zeros(0, dtype=np.int64)
    return at, run_digests(digests, words - period + 1, at)[:, 0].view(np.int64)


def candidate_windows(at: np.ndarray, n_words: int, words: int, period: int) -> np.ndarray:
    """Starts of the windows that contain one of the anchors at the given positions."""
    low, high = np.maximum(at - (period - 1), 0), np.minimum(at, n_words - words)
    step = np.zeros(n_words + 1, dtype=np.int64)
    fits = low <= high
    np.add.at(step, low[fits], 1)
    np.add.at(step, high[fits] + 1, -1)
    return np.flatnonzero(np.cumsum(step) > 0)


def covered(starts: np.ndarray, n_words: int, words: int) -> np.ndarray:
    """Whether each word lies in one of the windows that start at the given positions."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + words, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_windows(docs: DataFrame, words: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """Rows (first, own, starts): per class of equal texts, the windows that a smaller doc_id holds; written.

    docs: rows (id, text, own), own being a digest of the text; first is the smallest id of the class.
    """
    bounded_batches(docs.sparkSession)

    def all_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for few in slices(batch, 0):
                rows = [np.unique(anchors(known.digests(t), words, period, cover)[1]) for t in utf8(few.column(0))]
                owner = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), few.column(1).take(owner)], names=["anchor", "own"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for few in slices(batch, 0):
                found, pairs = [], []
                for i, text in enumerate(utf8(few.column(0))):
                    digests = known.digests(text)
                    at, hashes = anchors(digests, words, period, cover)
                    shared = few.column(3)[i].values.to_numpy(zero_copy_only=False)
                    found.append(candidate_windows(at[np.isin(hashes, shared)], len(digests), words, period))
                    pairs.append(run_digests(digests, words, found[-1]).view(np.int64))
                owner, start, pair = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found), np.concatenate(pairs)
                for k in range(0, len(start), WINDOWS):
                    part = slice(k, k + WINDOWS)
                    rows = pa.array(owner[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pair[part, 0]), pa.array(pair[part, 1]), pa.array(start[part]), few.column(1).take(rows), few.column(2).take(rows)],
                        names=["h1", "h2", "start", "first", "own"],
                    )

    # Each table that a join reads is written first, so that a hot anchor, window or class can be split over tasks.
    classes = cut(docs.groupBy("own").agg(F.min("id").alias("first")))
    once = cut(docs.select("text", "own").mapInArrow(all_anchors, "anchor long, own binary"))
    shared = cut(once.groupBy("anchor").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("anchor"))
    marks = cut(once.join(shared, "anchor").groupBy("own").agg(F.collect_set("anchor").alias("shared")))
    drop_table(once)
    marked = cut(marks.join(classes, "own").select("own", "first", "shared"))
    drop_table(marks)
    # Rows that repeat id and text give their windows once more: the smallest doc_id of a window is the same.
    holders = docs.join(marked.withColumnRenamed("own", "class"), (F.col("own") == F.col("class")) & F.col("id").eqNullSafe(F.col("first")))
    windows = cut(holders.select("text", "first", "own", "shared").mapInArrow(around, "h1 long, h2 long, start long, first long, own binary"))
    drop_table(marked)
    least = cut(
        windows.groupBy("h1", "h2").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.bool_or(F.col("first").isNull()).alias("nameless"))
        .where("least < most OR (nameless AND least IS NOT NULL)").select("h1", "h2", "least")
    )
    later = windows.join(least, ["h1", "h2"]).where("first IS NULL OR least < first")
    found = cut(later.groupBy("own").agg(F.collect_set("start").alias("starts")))
    for spent in (windows, least, shared):
        drop_table(spent)
    out = cut(classes.join(found, "own", "left"))
    for spent in (found, classes):
        drop_table(spent)
    return out


def without_words(text: pa.Array, starts: pa.Array, copy: pa.Array, words: int) -> pa.StructArray:
    """(kept words, number of words, removed words, removed runs of words) of each text."""
    texts, counts, removed, spans = [], [], [], []
    for i in range(len(text)):
        own = (utf8(text.slice(i, 1))[0] or b"").split()
        gone = np.zeros(len(own), dtype=bool)
        if copy[i].as_py():
            gone[:] = len(own) >= words
        elif starts[i].is_valid:
            gone = covered(starts[i].values.to_numpy(zero_copy_only=False), len(own), words)
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        kept = [w for w, g in zip(own, gone.tolist()) if not g] if len(edges) else own
        texts.append(b" ".join(kept))
        counts.append(len(own))
        removed.append(len(own) - len(kept))
        spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, run)],
        names=["text", "n_words", "n_removed", "removed"],
    )


def dedup_substrings(docs: DataFrame, words: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """The input rows with text as the kept words, joined by single spaces, plus n_words, n_removed and removed.

    A window is `words` consecutive words (runs without ASCII white space) of one text.  Each
    word that lies in a window whose words also start in a text of smaller doc_id is removed;
    windows are judged on the input.  removed lists the removed runs as (start, end) in words,
    end exclusive.  cover must hold two members at every distance modulo period, and period
    must not exceed words.

    A null text counts as empty; an empty result of kept words is an empty text.  Rows of one
    doc_id do not remove from each other.  Rows without a doc_id come after all others: they
    lose what a row with an id holds, and take nothing from any row.  Texts of any length are
    read whole.  Other columns stay; columns named n_words, n_removed or removed are replaced.
    An empty table gives an empty result.
    """
    if period > words or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover has no two members at some distance modulo period, or period is greater than words")
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    own = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), own.alias("own"))
    classes = repeated_windows(narrow, words, period, cover)
    # Per id and text: a copy of a text that a smaller id holds, or the holder with the windows it loses.
    members = cut(narrow.select("id", "own").join(classes.select("own", "first"), "own"))
    copies = members.where("first IS NOT NULL AND NOT id <=> first").select("id", "own", F.lit(True).alias("copy"), F.lit(None).cast("array<long>").alias("starts"))
    losers = classes.where("starts IS NOT NULL").select(F.col("first").alias("id"), "own", F.lit(False).alias("copy"), "starts")
    verdicts = cut(copies.distinct().union(losers).select(F.col("id").alias("judged"), F.col("own").alias("class"), "copy", "starts"))
    drop_table(members)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), own.alias("own"))
    joined = rows.join(verdicts, F.col("id").eqNullSafe(F.col("judged")) & (F.col("own") == F.col("class")), "left")

    def remove(text: pa.Array, starts: pa.Array, copy: pa.Array) -> pa.Array:
        return without_words(text, starts, copy, words)

    kind = "text string, n_words long, n_removed long, removed array<struct<start: long, end: long>>"
    done = joined.select("row", F.arrow_udf(remove, kind)(F.col("row.text").cast("string"), "starts", "copy").alias("done"))
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", "removed")]
    return done.select(
        *[(F.col("done.text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in kept],
        "done.n_words", "done.n_removed", "done.removed",
    )
