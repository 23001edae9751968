"""Quality rules as a bitmask ledger.

Every document is measured once and every rule is evaluated once; the ledger keeps
the measurements and one bit for each failed rule.  A policy is a versioned mask
over the rules, so changing a policy, or asking what each of its rules costs, reads
the ledger only.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs")

#: Rule i is bit i; an expression over the measurements that is true where the rule fails.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("bangs", "2 * n_bangs > n_words"),
    ("dup_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version: the rules that a document must not fail.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    count, covered = 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            count += i + 3 - max(i, covered)
            covered = i + 3
    return count


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        sum(text.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        text.count(b"!"),
    )


def ledger(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Rows (doc_id, the measurements, failed): bit i of failed is set where rule i fails.

    Words are runs other than space, tab, LF, VT, FF and CR.  A null or empty text
    has no word and measures zero.  Each input row gives one row, repeated or null
    ids too; further columns are left out.  An empty table gives an empty ledger.
    """

    def work(batch: pa.RecordBatch):
        rows = [measure(t) for t in utf8(batch.column(1))]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *MEASURES])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    measured = map_batches(narrow, work, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(rules):
        failed = failed.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def passes(policy: int, failed="failed"):
    return F.col(failed).bitwiseAND(F.lit(policy)) == 0


def ablation(book: DataFrame, policy: int, rules: tuple = RULES) -> DataFrame:
    """What each rule of the policy costs, in one pass over the ledger.

    Rows (rule, n_failed, n_only, n_kept_without): documents that fail the rule,
    that fail it and no other rule of the policy, and that the policy would keep
    without it.
    """
    own = [(name, 1 << i) for i, (name, _) in enumerate(rules) if policy >> i & 1]
    hit = F.col("failed").bitwiseAND(F.lit(policy))
    masks = book.groupBy(hit.alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    bit = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in own]))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    has = F.col("mask").bitwiseAND(F.col("b.bit"))
    return masks.withColumn("b", bit).groupBy(F.col("b.rule").alias("rule")).agg(
        total(has != 0).alias("n_failed"),
        total(F.col("mask") == F.col("b.bit")).alias("n_only"),
        total(F.col("mask").bitwiseAND(F.bitwise_not(F.col("b.bit"))) == 0).alias("n_kept_without"),
    )
