"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them in turn, writing what each stage returns to
the shared folder before the next reads it. All stages but the last return the columns of documents; n_chars follows the
text. Rows without doc_id stay and come after all others. Columns other than those of documents are left out. An empty table goes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm import op1_mix, op7_bpe, op8_ordermin, op9_suffix, op10_langid
from penprint.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like one of the table's languages; others (and null texts) go."""
    return op10_langid.identify(docs.select(COLUMNS), op10_langid.profiles(docs)).where("accepted").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id and then by a hash of its text, of each group of near copies.

    Null texts stay, each on its own. Rows without doc_id stay unless they are near copies of others; they come last. Rows that repeat
    doc_id and text become one, with the least (lang, source, n_chars) of theirs, nulls first.
    """
    kept = op8_ordermin.near_groups(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("row").alias("same")).distinct()
    docs = docs.select(COLUMNS).withColumn("row", F.xxhash64(F.col("text").cast("string")))
    docs = docs.join(kept, (F.col("row") == F.col("same")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return docs.groupBy("doc_id", "row").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("d")).select("doc_id", "d.*").select(COLUMNS)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing remains go."""
    cut = op9_suffix.dedup_substrings(docs, carry=["lang", "source"])
    return cut.where("words > removed or words = 0").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes."""
    return op1_mix.mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy."""
    return op7_bpe.encode(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "tokens", F.size("tokens").alias("n_tokens"))


STAGES = [
    ("language", known_language),
    ("near copies", one_of_each),
    ("repeated passages", no_repeats),
    ("mix", mixed),
    ("tokens", encoded),
]

#: SQL has no way to a byte-level BPE vocabulary or to order MinHash; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
