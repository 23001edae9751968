import hashlib

import pytest

from chartwave.llm import lines
from tests.llm.helpers import docs_of

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    holders = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(i)
    keeper = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    out = {}
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if keeper.get(key(x), i) == i]
        out[i] = (len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("range_lines, remembered", [(lines.RANGE_LINES, lines.REMEMBERED), (700, 50)])
def test_matches_brute_force_on_a_table(spark, monkeypatch, range_lines, remembered):
    monkeypatch.setattr(lines, "REMEMBERED", remembered)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(lines.dedup_lines(docs, range_lines=range_lines)) == brute(rows)


def test_odd_texts_and_full_filter(spark, monkeypatch):
    monkeypatch.setattr(lines, "cells_of", lambda hashes: [lines.np.zeros(len(hashes), dtype=int)] * 2)
    same = "This line is long enough to count"
    rows = [(1, None), (2, ""), (3, f" {same.upper()}\r\nown line of the third text\n"), (4, f"{same}\n{same}\t"),
            (9, f"a\n{same}\n\nb"), (7, "ÄÖÜ" * 7 + "\n" + "x" * 19), (8, "äöü" * 7), (5, "ÄÖÜ" * 7 + "x" * 90_000)]
    out = lines.dedup_lines(docs_of(spark, rows))
    assert result(out) == brute(rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert {r.doc_id: r.text for r in out.collect()}[1] is None


def test_ids_and_clashing_columns(spark):
    same = "This line is long enough to count"
    schema = "doc_id long, text string, keys int, n_lines string, row int"
    rows = [(None, same), (None, same), (1, same), (2, same), (2, same + "\nmore")]
    out = lines.dedup_lines(docs_of(spark, rows, schema))
    assert out.columns == ["doc_id", "text", "keys", "row", "n_lines", "n_dropped"]
    got = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert got == [(0, ""), (0, ""), (1, ""), (2, same), (2, same + "\nmore")]
    none = lines.dedup_lines(docs_of(spark, [(None, same)] * 3))
    assert [r.text for r in none.collect()] == [same] * 3
    assert lines.dedup_lines(docs_of(spark, [])).count() == 0


def test_most_lines_of_one_document_are_ruled_out(spark):
    own = [(i, "\n".join(f"line {j} of document {i} is its own" for j in range(30))) for i in range(300)]
    shared = [(i, "a line that all of these documents hold") for i in range(1000, 1400)]
    docs = docs_of(spark, own + shared)
    got = lines.suspected_lines(docs, 20, 3)
    by = {}
    for r in got.collect():
        by.setdefault(bytes(r.digest), []).append(r.doc_id)
    # The shared line is suspected in each of its documents, of the others few by chance.
    assert sorted(by.pop(lines.digest_of(b"a line that all of these documents hold"))) == list(range(1000, 1400))
    assert len(by) < 90


def test_rows_of_one_id_are_told_apart(spark):
    same = "This line is long enough to count"
    rows = [(None, f"{same}\nnull {i} and some more of it") for i in range(40)] + [(1, f"{same}\n{i}") for i in range(3)] + [(2, same)] * 2
    got = sorted((r.doc_id or 0, r.text, r.n_dropped) for r in lines.dedup_lines(docs_of(spark, rows)).collect())
    wanted = [(0, f"null {i} and some more of it", 1) for i in range(40)] + [(1, str(i), 1) for i in range(3)] + [(2, same, 0)] * 2
    assert got == sorted(wanted)
