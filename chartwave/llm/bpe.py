"""Byte-level BPE encoding and decoding with the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Characters that a piece of a long text holds at least, before the next safe boundary.
PIECE_CHARS = 1 << 16
#: White space characters in a row from which a run is encoded without the pattern.
RUN_CHARS = 1 << 15
#: The pattern that the rules below hold for.  Texts under any other pattern are never split.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as that pattern has it (Unicode's property; Python's own \s has four characters more).
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Before white space that follows something else: no match of the pattern spans it,
#: and white space runs, the only matches that look ahead, start at it.
SAFE = regex.compile(rf"(?<=[^{SPACES}])(?=[{SPACES}])")
LONG_RUN = regex.compile(rf"(?<![{SPACES}])[{SPACES}]{{{RUN_CHARS},}}+")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def whole(rank_file: str) -> tiktoken.Encoding:
    """The encoding that takes any text as one match."""
    ranks = encoding(rank_file, SPLIT_PATTERN)._mergeable_ranks
    return tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, least: int = PIECE_CHARS) -> list[str]:
    """The text cut at safe boundaries into pieces of at least `least` characters."""
    out, start = [], 0
    while len(text) - start > least and (cut := SAFE.search(text, start + least)):
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def parts(text: str, least: int = PIECE_CHARS, run: regex.Pattern = LONG_RUN) -> Iterator[tuple[str, bool]]:
    """Pieces of the text, each with whether it is one match of the pattern.

    A run of white space is one match but for its last character, which goes with what
    follows; at the end of the text it is one match whole.  Long runs are told apart
    because the library's matcher gives up on them.
    """
    start = 0
    for found in run.finditer(text):
        yield from ((p, False) for p in pieces(text[start : found.start()], least))
        start = found.end() - (found.end() < len(text))
        yield text[found.start() : start], True
    yield from ((p, False) for p in pieces(text[start:], least))


def encode(rank_file: str, pattern: str, text: str) -> list[int]:
    """Token ids of the whole text, each match of the pattern separately."""
    coder = encoding(rank_file, pattern)
    if len(text) <= RUN_CHARS or pattern != SPLIT_PATTERN:
        return coder.encode_ordinary(text)
    ids: list[int] = []
    for piece, one in parts(text):
        ids += (whole(rank_file) if one else coder).encode_ordinary(piece)
    return ids


def tokenize(docs: DataFrame, rank_file: str, pattern: str, ids: bool = True) -> DataFrame:
    """Encodes each whole text and decodes it again; one row per input row.

    Returns doc_id, n_tokens, ids (array, with ids), decoded (bytes, with ids),
    ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and
    decoded_sha256.  Special tokens are ordinary text.  A null text counts as
    empty and has no token.  Texts of any length are encoded, long runs of white space
    and single words of millions of characters too; under a pattern other than
    SPLIT_PATTERN a text goes to the library in one piece.  Repeated and null ids are
    kept, further columns left out; an empty table gives an empty result.

    rank_file must be readable under the same path on every executor.
    """

    def work(batch: pa.RecordBatch):
        coder = encoding(rank_file, pattern)
        tokens = [encode(rank_file, pattern, t or "") for t in batch.column(1).to_pylist()]
        raw = [coder.decode_bytes(t) for t in tokens]
        packed = [np.array(t, dtype="<u4").tobytes() for t in tokens]
        columns = [batch.column(0), pa.array([len(t) for t in tokens], pa.int64())]
        names = ["doc_id", "n_tokens"]
        if ids:
            columns += [pa.array(tokens, pa.list_(pa.int64())), pa.array(raw, pa.binary())]
            names += ["ids", "decoded"]
        columns += [pa.array([hashlib.sha256(x).hexdigest() for x in column]) for column in (packed, raw)]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    more = "ids array<long>, decoded binary, " if ids else ""
    return map_batches(narrow, work, f"doc_id long, n_tokens long, {more}ids_sha256 string, decoded_sha256 string")
