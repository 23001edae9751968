import hashlib
from collections import Counter

import numpy as np
import pytest

from chartwave.llm import alignment
from tests.llm.helpers import docs_of

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows):
    """Straight from the rule, with the libraries that the files belong to."""
    a, b = libraries()
    letters = alignment.byte_of_letter()
    raw_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for doc_id, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            whole = b" " + text.encode()
            if b"".join(map(raw_a, x)) == whole == b"".join(map(raw_b, y)):
                ends_x, ends_y = np.cumsum([len(raw_a(i)) for i in x]), np.cumsum([len(raw_b(i)) for i in y])
                low = 0
                for end in sorted(set(ends_x.tolist()) & set(ends_y.tolist())):
                    groups.append(([i for i, e in zip(x, ends_x) if low < e <= end], [i for i, e in zip(y, ends_y) if low < e <= end]))
                    low = end
        found.append((doc_id, groups))
    links = [[(i, j) for g in groups for i in g[0] for j in g[1]] for _, groups in found]
    count = Counter(p for own in links for p in set(own))
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (doc_id, groups), own in zip(found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(own),
                    sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, count, best


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def short(text):
    return text[:600] if text else text


def test_matches_brute_force_on_a_table(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SCORED_ROWS", 2)
    rows = [(r.doc_id, short(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = docs_of(spark, rows)
    wanted, count, best = brute(rows)
    assert result(alignment.align(docs, A, B)) == sorted(wanted, key=str)
    pairs = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.lexicon(docs, A, B).collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in count.items()}


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<s> </s> <unk> <|endoftext|> <0x41>"), (6, "café 漢字 \U0001f600\n\tx  y"),
    (7, " 　\u0000z"), (8, "x" * 3000), (9, "q9Zk" * 700), (9, "the same id"), (None, "no id"), (None, "no id"), (10, "ﬁ Å"),
]


@pytest.mark.parametrize("large", [alignment.LARGE_GROUP, 3])
def test_odd_texts(spark, monkeypatch, large):
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    schema = "doc_id long, text string, batch int, at string, stripe int, groups int"
    assert result(alignment.align(docs_of(spark, ODD, schema), A, B)) == sorted(brute(ODD)[0], key=str)


def test_empty_table_and_groups(spark):
    assert alignment.align(docs_of(spark, []), A, B).collect() == []
    row = alignment.align(docs_of(spark, [(1, "hello world")]), A, B).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.n_groups == row.groups.count(";") + 1


def test_large_groups_count_like_small_ones():
    a, b, _ = alignment.vocabularies(A, B)
    texts = ["unbelievably interoperable antidisestablishmentarianism", None, "unbelievably " * 40]
    pair = lambda x, y: x * b.size + y
    plain = alignment.Aligned(texts, a, b).links(pair)
    alignment.LARGE_GROUP, kept = 1, alignment.LARGE_GROUP
    try:
        counted = alignment.Aligned(texts, a, b).links(pair)
    finally:
        alignment.LARGE_GROUP = kept
    assert all((x == y).all() for x, y in zip(plain, counted))


def test_libraries_agree_on_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    a, b, _ = alignment.vocabularies(A, B)
    own_a, own_b = libraries()
    letters = "  \t\n\x0b\x85\xa0　abcXYZé漢'stvre19²٣!?<|>\U0001f600​́"

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.text(alphabet=letters, max_size=60)).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
    def same(text):
        assert a.encode(" " + text) == own_a.encode(" " + text, add_special_tokens=False).ids
        parts = alignment.text_parts(text, 3)
        assert [i for ids in own_b.encode(parts) for i in ids] == own_b.encode(text)

    same()


def test_long_texts_in_parts():
    a, b, _ = alignment.vocabularies(A, B)
    own_a, own_b = libraries()
    text = ("Some words of a long text, and\n\n more  of them. " * 9000) + " " * 40_000 + "z"
    assert a.encode(" " + text) == own_a.encode(" " + text, add_special_tokens=False).ids
    assert b.parts and b.encode([text]) == [own_b.encode(text)]
