import re
from collections import Counter

from chartwave.llm import quality
from tests.llm.helpers import docs_of

SF = "/root/testdata/sf0.001"


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup, full = set(), 0, 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            full += 1
            dup += line in seen
            seen.add(line)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(tri)
    covered = {i + j for i, x in enumerate(tri) if count[x] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), full, dup, len(covered), t.count("!"))


def test_measurements_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    odd = ["", None, " \n ", "a a a a a", "x y z\nx y z\n x y z", "Ä Ö\x0bÜ &|<>", "a b a b a b a b", "#" * 50_000, "\u2003 wide"]
    rows += [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "a"), (3, "a")]
    book = quality.ledger(docs_of(spark, rows)).collect()
    got = sorted((r.doc_id or -1, *[r[m] for m in quality.MEASURES]) for r in book)
    assert got == sorted((i or -1, *brute(t)) for i, t in rows)
    for r in book:
        fails = eval("[" + ",".join(e.replace(" OR ", " or ") for _, e in quality.RULES) + "]", None, {m: r[m] for m in quality.MEASURES})
        assert r.failed == sum(1 << i for i, f in enumerate(fails) if f)


def test_policies_and_ablation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    book = quality.ledger(docs)
    policy = quality.POLICIES["v1"]
    failed = [r.failed for r in book.collect()]
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablation(book, policy).collect()}
    assert got == {
        n: (sum(f & b > 0 for f in failed), sum(f == b for f in failed), sum(f & ~b == 0 for f in failed)) for n, b in quality.BIT.items()
    }
    assert book.where(quality.passes(policy)).count() == sum(f == 0 for f in failed)


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    base, v1 = quality.passes(quality.POLICIES["base"]), quality.passes(quality.POLICIES["v1"])
    rows = quality.ledger(docs).where(base).withColumn("kept", v1).join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) == len(clean) and sum(junk) < 0.2 * len(junk)


def test_empty_table(spark):
    assert quality.ledger(docs_of(spark, [])).count() == 0
