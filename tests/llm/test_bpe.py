import hashlib
import random

import numpy as np
import public_tokenizers
import regex

from chartwave.llm import bpe
from chartwave.llm.queries import RANK_FILE
from tests.llm.helpers import docs_of

PATH = public_tokenizers.path(RANK_FILE)
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n  \n", "<|endoftext|> is text", "a  b   c \u00a0\u2003 d\r\n\t x", "don't we'll", "\U0001f600é漢字 123 456", "x" * 3000, " " * 3000 + "y"]


def wanted(text):
    coder = bpe.encoding(PATH, public_tokenizers.PATTERN)
    ids = coder.encode_ordinary(text or "")
    packed = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_texts_equal_the_library_and_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "no id"), (10_000, "again")]
    out = bpe.tokenize(docs_of(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    number = lambda i: -1 if i is None else i
    got = sorted((number(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out)
    assert got == sorted((number(i), *wanted(t)) for i, t in rows)
    assert all(len(r.ids) == r.n_tokens for r in out)


def test_safe_boundaries_change_no_token():
    assert bpe.SPLIT_PATTERN == public_tokenizers.PATTERN
    rng = random.Random(3)
    alphabet = ["a", "b", " ", "  ", "\n", "1", "!", "'s", "\u00a0", "é", "\t", "漢", "'", "\x1c", "\x1f", "\x85", "\u2029", "   \n "]
    coder, whole = bpe.encoding(PATH, public_tokenizers.PATTERN), bpe.whole(PATH)
    run = regex.compile(rf"(?<![{bpe.SPACES}])[{bpe.SPACES}]{{3,}}+")
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(200)))
        assert "".join(bpe.pieces(text, 7)) == text
        ids = [i for piece, one in bpe.parts(text, 7, run) for i in (whole if one else coder).encode_ordinary(piece)]
        assert ids == coder.encode_ordinary(text)


def matches(text):
    """Matches of the pattern by Python's own regular expressions, white space by Unicode's property."""
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}", rf"[^{bpe.SPACES}\p{{L}}").replace(r"(?!\S)", rf"(?![^{bpe.SPACES}])").replace(r"\s+", f"[{bpe.SPACES}]+")
    return regex.findall(pattern, text)


LONG = [
    "word " + " " * 2_000_000 + "word", "\n" * 2_000_000, "a\t" + "\t" * 2_000_000 + "!", (" \n\t" * 700_000) + "end.", "x" * 5_000_000,
    "a  b " * 100_000 + " " * 100_000 + "\nc" + "\n" * 70_000,
]


def test_long_runs_equal_an_independent_split(spark):
    docs = docs_of(spark, list(enumerate(LONG)))
    out = {r.doc_id: r for r in bpe.tokenize(docs, PATH, public_tokenizers.PATTERN).collect()}
    single = bpe.whole(PATH)
    for i, text in enumerate(LONG):
        ids = [t for m in matches(text) for t in single.encode_ordinary(m)]
        assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and bytes(out[i].decoded) == text.encode()


def test_other_patterns_are_not_split(spark):
    text = "ab\n\n" * 20_000
    row = bpe.tokenize(docs_of(spark, [(1, text)]), PATH, r"[a-z]+\n*|\s+").first()
    assert list(row.ids) == bpe.encoding(PATH, r"[a-z]+\n*|\s+").encode_ordinary(text)


def test_empty_table(spark):
    assert bpe.tokenize(docs_of(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
