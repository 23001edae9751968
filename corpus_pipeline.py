"""A training-corpus pipeline: each stage reads what the one before it has written.

language_id      documents whose language is not recognised go
line_dedup       lines repeated in three documents or more stay in one of them
near_dedup       one document of each group of near copies stays
source_mix       the documents are laid out so that sources interleave by target weight
byte_bpe         token ids of every document, and the check of their round trip
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartwave.llm import bpe, langid, lines, mixing, simhash
from chartwave.llm.common import cut, drop_table, shared_folder
from chartwave.llm.queries import RANK_FILE

#: Mean probability that a language needs to be accepted.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language of at least LEAST_SCORE, go.

    So null and empty texts go.  Null and repeated ids and all other columns stay as they
    are, also such as are named like the operator's own; texts of any length are judged
    whole; an empty table stays empty, and where nothing is labelled every document goes.
    """
    judged = langid.identify(docs.select(F.struct("*").alias("all"), "doc_id", "text", "lang"))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("all.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, with n_chars counted again.

    Null texts stay null.  Rows of one id are documents of their own, rows without an id
    lose repeated lines that a row with an id keeps.  Other columns stay as they are; an
    empty table stays empty.
    """
    kept = lines.dedup_lines(docs.select("doc_id", "text", F.struct("*").alias("all")))
    chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("all.n_chars"))
    own = {"text": F.col("text")} | ({"n_chars": chars.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.select(*[own.get(c, F.col(f"all.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of five-word similarity 0.8 or more stays, once.

    Rows without an id cannot be named and stay.  Where several texts share an id, each is
    a document of its own, named by a hash of id and text instead; of rows that repeat id and
    text one stays.  Null texts and texts without a word are alike.  Other columns stay as
    they are; an empty table stays empty.
    """
    named = docs.where("doc_id IS NOT NULL").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("own"))
    repeated = cut(named.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("again")))
    key = F.when(F.col("again"), F.xxhash64("id", "own")).otherwise(F.col("id"))
    keyed = named.join(repeated, "id", "left").withColumn("key", key)
    near = simhash.similar_texts(keyed.select(F.col("key").alias("doc_id"), F.col("own").alias("text")), words=5, similarity=0.8)
    kept = near.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    found = keyed.join(kept, "key", "left_semi")
    once = found.where("again IS NULL").select("row.*")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    again = found.where("again").withColumn("place", first).where("place = 1").select("row.*")
    return once.union(again).union(docs.where("doc_id IS NULL"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the mixed order.

    A null source is one source, null and repeated ids follow each other in any order, and
    every row is placed once with all its columns; an empty table stays empty.
    """
    mixed = mixing.mix(docs.select("doc_id", "source", F.struct("*").alias("all")), ordered=True)
    return mixed.select("all.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digests of ids and decoded bytes.

    A null text counts as empty and has no token.  Null and repeated ids are kept, each
    row is encoded whole, further columns are left out; an empty table stays empty.
    """
    import public_tokenizers

    done = bpe.tokenize(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The language model and the fingerprints have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written as Parquet and read again.

    A stage's output is deleted once the next one is written.
    """
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if spent is not None:
            drop_table(spent)
        docs = spent = spark.read.parquet(path)
    return docs
