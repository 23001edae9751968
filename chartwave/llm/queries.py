"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, html_tree, langid, lines, mixing, negatives, quality, rabitq, secret_scan, simhash, substrings, urls
from .common import cut, table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: The list of blocked hosts: each of these names in each of these zones, and numbered mirrors of them, most of
#: which no corpus holds; hosts that only resemble one are not listed.
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_ZONES = ("com", "net", "org", "example.com", "example.net", "example.org")
BLOCKED_HOSTS = [f"{name}.{zone}" for name in BLOCKED_NAMES for zone in BLOCKED_ZONES]
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCKED_MIRRORS = 120_000
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op2_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_texts(table(spark, sf_dir, "documents"), words=3, radius=2)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    kinds = [b[0] for b in secret_scan.BASE]
    count = {f"n_{k}": F.size(F.expr(f"filter(base, s -> s.ord = {i})")).cast("long") for i, k in enumerate(kinds)}
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    base = F.expr(f"array_join(transform(base, s -> concat({names}[s.ord], ':', s.start, ':', s.end)), ',')")
    every = F.expr("array_join(transform(spans, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")
    return found.select(
        "doc_id", *[c.alias(n) for n, c in count.items()],
        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), "n_live", "n_copied", "n_shared",
        "most_owners", "most_repositories",
    )


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.POLICIES["base"])).alias("base_failed"),
        quality.passes(quality.POLICIES["v1"]).alias("kept"), "n_lines", "n_bangs", "failed",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy costs over all documents, from the stored ledger."""
    book = cut(quality.ledger(table(spark, sf_dir, "documents")))
    return quality.ablation(book, quality.POLICIES["v1"])


def blocked_hosts(spark: SparkSession) -> DataFrame:
    """Rows (host) of the list, made by rule."""
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    n, zones = len(BLOCKED_NAMES), len(BLOCKED_ZONES)
    mirror = F.concat(pick(BLOCKED_NAMES, F.col("id") % n), F.expr(f"id div {n * zones} + 1").cast("string"), F.lit("."), pick(BLOCKED_ZONES, F.expr(f"id div {n} % {zones}")))
    plain = F.concat(pick(BLOCKED_NAMES, F.col("id") % n), F.lit("."), pick(BLOCKED_ZONES, F.expr(f"id div {n}")))
    return spark.range(BLOCKED_MIRRORS).select(mirror.alias("host")).union(spark.range(n * zones).select(plain.alias("host")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES, blocked_hosts(spark))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.tokenize(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, ids=False)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_place")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10, low=30, high=90)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(table(spark, sf_dir, "documents"), words=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path(BYTE_FILE), public_tokenizers.path(PIECE_FILE), groups=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_vectors, op2_near_texts, op3_line_dedup, op4_secret_scan, op5_main_text, op6_quality_rules,
        op7_url_filter, op8_language_id, op9_byte_bpe, op10_source_mix,
        op11_hard_negatives, op12_substring_dedup, op13_tokenizer_alignment, quality_ablation,
    )
}
