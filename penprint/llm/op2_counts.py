"""Operator 2: exact token counts for every context limit, from one histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_files import RANKS, fast_encoding
from .common import Scratch, cached, read

#: Lengths in one block of the two-level suffix sums; no window holds more rows than this or than there are blocks.
BLOCK = 4096


def length_histogram(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(n_tokens, docs): how many rows of docs encode to so many tokens.

    Whole texts are encoded. Null and empty texts have 0 tokens; repeated rows count each time; an empty table gives no rows;
    columns other than text are never read. Strings of special tokens in a text are ordinary text.
    """

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        code = cached(("encoding", ranks), lambda: fast_encoding(ranks)).encode_to_numpy
        for batch in batches:
            lengths = [len(code(t, disallowed_special=())) if t else 0 for t in batch.column(0).to_pylist()]
            n, docs = np.unique(np.array(lengths, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(docs.astype(np.int64))], ["n_tokens", "docs"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens long, docs long")
    return parts.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def context_table(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each length n that occurs, with suffix sums over the histogram.

    docs, tokens: of exactly this length; docs_ge, tokens_ge: of this length or longer; docs_all, tokens_all: of all;
    truncated_total: tokens left if every document is cut to n tokens; quantile: share of documents of length n or less.
    For a limit c between two rows use the next larger row: tokens_all - tokens_ge + c * docs_ge (see truncated_total).
    """
    h = histogram.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / block).alias("block"))
    # Sums of whole blocks first, so that neither window runs over all lengths; both sides follow from the small histogram.
    sums = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = sums.select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("docs_all"), F.sum("t").over(every).alias("tokens_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(sums, "block")
    out = out.withColumn("docs_ge", F.sum("docs").over(inside) + F.col("d_after")).withColumn("tokens_ge", F.sum("tokens").over(inside) + F.col("t_after"))
    return out.select(
        "n_tokens", "docs", "tokens", "docs_ge", "tokens_ge", "docs_all", "tokens_all",
        (F.col("tokens_all") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        ((F.col("docs_all") - F.col("docs_ge") + F.col("docs")) / F.col("docs_all")).alias("quantile"),
    )


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """One row (limit, total): tokens left if every document is cut to `limit` tokens. No documents: 0."""
    short = F.col("n_tokens") < limit
    total = F.sum(F.when(short, F.col("tokens")).otherwise(F.lit(limit) * F.col("docs")))
    return table.agg(F.lit(limit).alias("limit"), F.coalesce(total, F.lit(0)).cast("long").alias("total"))


def length_quantile(table: DataFrame, q: float) -> DataFrame:
    """One row (q, n_tokens): the least length that at least a share q of the documents doesn't exceed; null without documents."""
    return table.where(F.col("quantile") >= q).agg(F.lit(q).alias("q"), F.min("n_tokens").alias("n_tokens"))


def op2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = Scratch(spark, "counts").write(length_histogram(read(spark, sf_dir, "documents")), "histogram")  # texts are encoded once
    return context_table(histogram)


QUERIES = {"op2_counts": op2_counts}
SQL: dict[str, str] = {}
