"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often corpus-wide.

Both tokenizers encode every text.  Where a token of each ends at the same byte the text is
cut into groups, and within a group every A token is linked with every B token.  The A ids
are dealt out in stripes (id modulo STRIPES), so that frequent ids are spread.  A stripe's
counts are one dense matrix of its A ids by all B ids, of one size for any corpus: each task
first adds up how many of its documents hold a pair, np.add.at adds these sums into the
matrix, and row maxima give the highest count of each A id.  The links lie packed by the
same stripes, so they are scored where their matrix is; hot or not, each stripe's links are
dealt over as many tasks as their volume asks for.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import bounded_batches, cut, drop_table, slices

#: A ids of the same remainder share a count matrix: of 50,257 ids and 32,000 it has 519 rows, 133 MB.
STRIPES = 97
#: Links of a group from which its repeated ids are counted before they are paired.
LARGE_GROUP = 1 << 16
#: Characters from which a text goes to the piece tokenizer in parts.
PART_CHARS = 1 << 16
#: Cells of a matrix that one row of the table of counts holds.
CELLS = 1 << 20
#: Packed rows of a stripe that one task should score.
SCORED_ROWS = 4000
#: A space between two other characters that are no white space.
LONE_SPACE = regex.compile(r"(?<=\S) (?=\S)")


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves, the other bytes take, in order, the letters from U+0100.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """The byte-level vocabulary of a tokenizer file (JSON), run by the tiktoken library.

    Merging by rank is what the file describes only if its merges make ids in rising order; that is checked.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            file = json.load(file)
        vocab, special = file["model"]["vocab"], {t["content"] for t in file["added_tokens"]}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.size, self.lengths = len(self.table), np.array([len(t) for t in self.table])
        self.coder = tiktoken.Encoding("byte_level", pat_str=bpe.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.one = tiktoken.Encoding("one_match", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= bpe.RUN_CHARS:
            return self.coder.encode_ordinary(text)
        return [i for part, one in bpe.parts(text) for i in (self.one if one else self.coder).encode_ordinary(part)]


class Pieces:
    """A piece model, run by the sentencepiece library, with the bytes of every piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.table = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
            for i, n in enumerate(names)
        ]
        self.lengths = np.array([len(t) for t in self.table])
        # The model puts a space before the text.  Where no piece goes on after a space within it, a text may be cut
        # at a single space: each part gets the space back.
        self.parts = not any("▁" in n.lstrip("▁") for n in names) and self.table[self.model.encode("a b")[-1]] == b" b"

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.parts or all(len(t) <= PART_CHARS for t in texts):
            return self.model.encode(texts, num_threads=1)
        return [[i for ids in self.model.encode(text_parts(t), num_threads=1) for i in ids] for t in texts]


def text_parts(text: str, least: int = PART_CHARS) -> list[str]:
    """The text cut at single spaces, which are left out, into parts of at least `least` characters."""
    out, start = [], 0
    while len(text) - start > least and (found := LONE_SPACE.search(text, start + least)):
        out.append(text[start : found.start()])
        start = found.end()
    return [*out, text[start:]]


@lru_cache(maxsize=2)
def vocabularies(a_file: str, b_file: str) -> tuple[ByteLevel, Pieces, list[bytes]]:
    """(A, B, how ids are written: A ids within and at the end of a group, then B ids likewise)."""
    a, b = ByteLevel(a_file), Pieces(b_file)
    written = [b"%d%b" % (i, mark) for v, marks in ((a, b",|"), (b, b",;")) for mark in (marks[:1], marks[1:]) for i in range(v.size)]
    return a, b, written


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width that holds them all, which the first byte says."""
    top = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w) or w == 8)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


class Aligned:
    """The texts of one slice, aligned: per text ids and groups, and the links of all of them."""

    def __init__(self, texts: list[str | None], a: ByteLevel, b: Pieces):
        some = [(i, t) for i, t in enumerate(texts) if t]
        own_a, own_b = [a.encode(" " + t) for _, t in some], b.encode([t for _, t in some]) if some else []
        kept = []
        for k, (_, t) in enumerate(some):
            raw = b" " + t.encode()
            if b"".join(map(a.table.__getitem__, own_a[k])) == raw and b"".join(map(b.table.__getitem__, own_b[k])) == raw:
                kept.append(k)
        self.n, self.at = len(texts), np.array([some[k][0] for k in kept], dtype=np.int64)
        self.n_a = np.array([len(own_a[k]) for k in kept], dtype=np.int64)
        self.n_b = np.array([len(own_b[k]) for k in kept], dtype=np.int64)
        flat = lambda ids, n: np.fromiter((i for k in kept for i in ids[k]), dtype=np.int64, count=int(n.sum()))
        self.a, self.b = flat(own_a, self.n_a), flat(own_b, self.n_b)
        # Texts have as many bytes in A as in B, so offsets may run on from text to text.
        end_a, end_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        self.last_a, self.last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        self.group_a, self.group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        groups = int(self.last_a.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        self.to_a, self.to_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        self.text_a = np.repeat(np.arange(len(kept)), self.n_a)
        self.text_of = self.text_a[self.last_a]
        self.n_groups = np.bincount(self.text_of, minlength=len(kept))
        links = np.zeros(len(kept), dtype=np.int64)
        np.add.at(links, self.text_of, self.in_a * self.in_b)
        self.n_links = links

    def written(self, table: list[bytes], size_a: int, size_b: int) -> list[str]:
        """The groups of each text: a1,a2|b1;a3|b2."""
        merged = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        merged[np.arange(len(self.a)) + (self.to_b - self.in_b)[self.group_a]] = self.a + size_a * self.last_a
        merged[np.arange(len(self.b)) + self.to_a[self.group_b]] = 2 * size_a + self.b + size_b * self.last_b
        codes, ends = merged.tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(map(table.__getitem__, codes[s:e]))[:-1].decode() for s, e in zip([0, *ends], ends)]

    def links(self, pair_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, position of the text, how often) of every distinct linked pair of each text, by pair and position."""
        large = self.in_a * self.in_b > LARGE_GROUP
        times = np.where(large[self.group_a], 0, self.in_b[self.group_a])
        i = np.repeat(np.arange(len(self.a)), times)
        first = (self.to_b - self.in_b)[self.group_a]
        j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + first[i]
        keys, counts = np.unique(pair_of(self.a[i], self.b[j]) * self.n + self.at[self.text_a[i]], return_counts=True)
        if large.any():
            keys, counts = [keys], [counts]
            for g in np.flatnonzero(large):
                x, n_x = np.unique(self.a[self.to_a[g] - self.in_a[g] : self.to_a[g]], return_counts=True)
                y, n_y = np.unique(self.b[self.to_b[g] - self.in_b[g] : self.to_b[g]], return_counts=True)
                keys.append((pair_of(x[:, None], y) * self.n + self.at[self.text_of[g]]).ravel())
                counts.append(np.outer(n_x, n_y).ravel())
            keys, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(keys), dtype=np.int64)
            np.add.at(total, where, np.concatenate(counts))
            counts = total
        return keys // max(self.n, 1), keys % max(self.n, 1), counts


ENCODED = (
    "batch long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
    "stripe int, pairs binary, held binary, texts binary, times binary"
)


def encoded(docs: DataFrame, a_file: str, b_file: str, groups: bool) -> DataFrame:
    """One row per document, and rows (batch, stripe) with the packed links of some documents; written."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, table = vocabularies(a_file, b_file)
        height = -(-a.size // STRIPES)
        schema = arrow_schema()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for few in slices(batch, 1):
                found = Aligned(few.column(1).to_pylist(), a, b)
                yield document_rows(few, found, number, table, a, b, schema)
                pair, at, times = found.links(lambda x, y: (x % STRIPES * height + x // STRIPES) * b.size + y)
                yield link_rows(pair, at, times, number, height * b.size, schema)
                number += 1

    def arrow_schema() -> pa.Schema:
        kind = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        return pa.schema([(n, kind[t]) for n, t in (c.split() for c in ENCODED.split(", "))])

    def filled(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def document_rows(few, found, number, table, a, b, schema) -> pa.RecordBatch:
        text = [""] * found.n
        for i, t in zip(found.at.tolist(), found.written(table, a.size, b.size)):
            text[i] = t

        def spread(own):
            out = np.zeros(found.n, dtype=np.int64)
            out[found.at] = own
            return out

        columns = {n: spread(getattr(found, n)) for n in ("n_a", "n_b", "n_groups", "n_links")}
        columns |= {"batch": np.full(found.n, number), "at": np.arange(found.n, dtype=np.int32), "doc_id": few.column(0)}
        columns |= {"groups_sha256": [t and hashlib.sha256(t.encode()).hexdigest() for t in text]} | ({"groups": text} if groups else {})
        return filled(columns, found.n, schema)

    def link_rows(pair, at, times, number, cells, schema) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[len(pair) > 0, pair[1:] != pair[:-1]])
        own = pair[starts]
        held = np.diff(np.r_[starts, len(pair)])
        stripe, first = np.unique(own // cells, return_index=True)
        out = {k: [] for k in ("pairs", "held", "texts", "times")}
        for s, e in zip(first, [*first[1:], len(own)]):
            low, high = starts[s], starts[e] if e < len(own) else len(pair)
            for name, values in (("pairs", own[s:e] % cells), ("held", held[s:e]), ("texts", at[low:high]), ("times", times[low:high])):
                out[name].append(packed(values))
        return filled(out | {"batch": np.full(len(stripe), number), "stripe": stripe.astype(np.int32)}, len(stripe), schema)

    return cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, ENCODED))


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]]).tolist()
    return zip(starts, [*starts[1:], len(keys)])


def counted(links: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Rows (stripe, pairs, counts, best), packed: in how many documents each pair is linked, and whether that is its A id's highest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, _ = vocabularies(a_file, b_file)
        height, last, block = -(-a.size // STRIPES), None, None

        def cells() -> Iterator[pa.RecordBatch]:
            grid = block.reshape(height, b.size)
            best = grid.max(axis=1)
            own = np.flatnonzero(block)
            for s in range(0, len(own), CELLS):
                few = own[s : s + CELLS]
                top = block[few] == best[few // b.size]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([last], pa.int32())] + [pa.array([packed(x)], pa.binary()) for x in (few, block[few], top.astype(np.int64))],
                    names=["stripe", "pairs", "counts", "best"],
                )

        for batch in batches:
            stripes = batch.column(0).to_numpy()
            for s, e in runs(stripes):
                if stripes[s] != last:
                    if last is not None:
                        yield from cells()
                    last, block = int(stripes[s]), np.zeros(height * b.size, dtype=np.int64)
                for k in range(s, e):
                    np.add.at(block, unpacked(batch.column(1)[k].as_py()), unpacked(batch.column(2)[k].as_py()))
        if last is not None:
            yield from cells()

    dealt = links.select("stripe", "pairs", "held").repartition("stripe").sortWithinPartitions("stripe")
    return cut(dealt.mapInArrow(rows, "stripe int, pairs binary, counts binary, best binary"))


def scored(links: DataFrame, counts: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Rows (batch, at, n_best, count_sum): the links of each document scored beside their stripe's counts."""
    salts = max(1, -(-links.count() // (STRIPES * SCORED_ROWS)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, _ = vocabularies(a_file, b_file)
        size, last, count, best = -(-a.size // STRIPES) * b.size, None, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (key := (row["stripe"], row["salt"])) != last:
                    last, count, best = key, np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
                pairs = unpacked(row["pairs"])
                if row["batch"] is None:  # the counts of the stripe come first
                    count[pairs], best[pairs] = unpacked(row["held"]), unpacked(row["best"]).astype(bool)
                    continue
                held, texts, times = (unpacked(row[x]) for x in ("held", "texts", "times"))
                own, where = np.unique(texts, return_inverse=True)
                n_best, total = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
                np.add.at(n_best, where, times * np.repeat(best[pairs], held))
                np.add.at(total, where, times * np.repeat(count[pairs], held))
                out.append((row["batch"], packed(own), packed(n_best), packed(total)))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["batch", "texts", "n_best", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, {}

        def done() -> pa.RecordBatch:
            at = sorted(sums)
            return pa.RecordBatch.from_arrays(
                [pa.array([last] * len(at), pa.int64()), pa.array(at, pa.int32())] + [pa.array([sums[x][i] for x in at], pa.int64()) for i in (0, 1)],
                names=["batch", "at", "n_best", "count_sum"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if row["batch"] != last:
                    if last is not None:
                        yield done()
                    last, sums = row["batch"], {}
                for at, n, total in zip(*(unpacked(row[x]).tolist() for x in ("texts", "n_best", "total"))):
                    own = sums.setdefault(at, [0, 0])
                    own[0] += n
                    own[1] += total
        if last is not None:
            yield done()

    null = F.lit(None)
    blocks = counts.select(
        "stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), null.cast("long").alias("batch"), "pairs",
        F.col("counts").alias("held"), null.cast("binary").alias("texts"), null.cast("binary").alias("times"), "best",
    )
    own = links.select("stripe", (F.hash("batch") % salts + salts).cast("int").alias("salt"), "batch", "pairs", "held", "texts", "times", null.cast("binary").alias("best"))
    own = own.withColumn("salt", F.col("salt") % salts)
    dealt = blocks.union(own).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("batch").isNotNull())
    partial = dealt.mapInArrow(score, "batch long, texts binary, n_best binary, total binary")
    return partial.repartition("batch").sortWithinPartitions("batch").mapInArrow(add, "batch long, at int, n_best long, count_sum long")


def align(docs: DataFrame, a_file: str, b_file: str, groups: bool = True) -> DataFrame:
    """Aligns the tokens of each text under two tokenizers and scores the links by the whole corpus.

    a_file is a byte-level BPE tokenizer (JSON) that encodes space + text, b_file a piece
    model that puts the space there itself.  Strings of special tokens are plain text.
    Returns, per input row, doc_id, n_a and n_b (tokens), n_groups, n_links (pairs of an A
    and a B token in one group), n_best (links whose pair is linked in as many documents as
    any pair of its A id), count_sum (those numbers of documents over all links),
    groups_sha256 and, with groups, the groups as text (`a1,a2|b1;a3|b2`).

    Null and empty texts, and texts that either tokenizer changes, have no tokens: zeros and
    empty strings.  Each row counts as a document, also with a repeated or null doc_id.
    Texts of any length are encoded whole; a group costs the product of its distinct ids.
    Further columns are left out; an empty table gives an empty result.

    Both files must be readable under the same path on every executor.
    """
    table = encoded(docs, a_file, b_file, groups)
    links = table.where("stripe IS NOT NULL").select("batch", "stripe", "pairs", "held", "texts", "times")
    counts = counted(links, a_file, b_file)
    scores = cut(scored(links, counts, a_file, b_file))
    drop_table(counts)
    rows = table.where("stripe IS NULL").join(scores, ["batch", "at"], "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256", *(["groups"] if groups else []))


def lexicon(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Rows (a_id, b_id, n_docs, best): every id pair linked in some document, and whether its count is its A id's highest.

    Rows of docs are treated as in align(); an empty table gives no pair.
    """
    table = encoded(docs, a_file, b_file, False)
    counts = counted(table.where("stripe IS NOT NULL"), a_file, b_file)
    drop_table(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, b, _ = vocabularies(a_file, b_file)
        for batch in batches:
            for row in batch.to_pylist():
                pair = unpacked(row["pairs"])
                columns = [pair // b.size * STRIPES + row["stripe"], pair % b.size, unpacked(row["counts"])]
                flags = pa.array(unpacked(row["best"]).astype(bool))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), flags], names=["a_id", "b_id", "n_docs", "best"])

    return counts.mapInArrow(rows, "a_id long, b_id long, n_docs long, best boolean")
