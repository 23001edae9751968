import hashlib
import random

import numpy as np
import pytest

from chartwave.llm import substrings
from tests.llm.helpers import docs_of

SF = "/root/testdata/sf0.001"


def split(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def brute(rows, words=50):
    least = {}
    for i, t in rows:
        ws = split(t)
        for k in range(len(ws) - words + 1):
            w = tuple(ws[k : k + words])
            least[w] = min(least.get(w, (True, 0)), (i is None, i or 0))
    out = []
    for i, t in rows:
        ws, gone = split(t), set()
        for k in range(len(ws) - words + 1):
            no_id, low = least[tuple(ws[k : k + words])]
            if not no_id and (i is None or low < i):
                gone.update(range(k, k + words))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()), key=str)


def test_every_pair_of_offsets_shares_an_anchor():
    digests = substrings.Words().digests(" ".join(f"w{i}" for i in range(50)).encode())
    filler = substrings.Words().digests(" ".join(f"f{i}" for i in range(80)).encode())
    for i in range(31):
        for j in range(31):
            x, y = (np.concatenate([filler[:k], digests]) for k in (i, j))
            at, hashes = substrings.anchors(x, 50, substrings.PERIOD, substrings.COVER)
            inside = set(hashes[at >= i].tolist())
            at, hashes = substrings.anchors(y, 50, substrings.PERIOD, substrings.COVER)
            assert inside & set(hashes[at >= j].tolist())


def test_a_cover_is_needed(spark):
    with pytest.raises(ValueError):
        substrings.dedup_substrings(docs_of(spark, []), cover=(0, 1, 2))


def test_matches_brute_force_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = substrings.dedup_substrings(docs)
    wanted = brute(rows)
    assert result(out) == wanted and any(r[2] for r in wanted)
    for r in out.where("n_removed > 0").limit(50).collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


@pytest.mark.parametrize("words, period, cover", [(8, 7, (1, 2, 4)), (3, 3, (0, 1)), (1, 1, (0,))])
def test_random_texts(spark, words, period, cover):
    rng = random.Random(words)
    rows = []
    for i in range(120):
        own = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        if rows and rng.random() < 0.5:
            other = split(rng.choice(rows)[1])
            own[rng.randint(0, len(own)) :] = other[rng.randint(0, len(other)) :]
        rows.append((rng.choice([None, *range(60)]), rng.choice([" ", "\n", "  "]).join(own)))
    out = substrings.dedup_substrings(docs_of(spark, rows), words, period, cover)
    assert result(out) == brute(rows, words)


def test_odd_texts_and_columns(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, long), (6, long.replace(" ", "\n")), (7, "x " + long + " y"), (7, "z"), (None, long),
            (None, long), (8, " ".join(["same"] * 3000)), (9, " ".join(["same"] * 51) + " other"), (10, long[: len(long) // 2] + "\x85 " + long[len(long) // 2 :]),
            (11, " ".join(long.split()[:49])), (12, "ä" * 100_000)]
    schema = "doc_id long, text string, own int, n_words string, removed int, id int, row string"
    out = substrings.dedup_substrings(docs_of(spark, rows, schema))
    assert out.columns == ["doc_id", "text", "own", "id", "row", "n_words", "n_removed", "removed"]
    assert result(out) == brute(rows)
    assert substrings.dedup_substrings(docs_of(spark, [])).collect() == []
    nameless = substrings.dedup_substrings(docs_of(spark, [(None, long)] * 3))
    assert [r.n_removed for r in nameless.collect()] == [0] * 3
