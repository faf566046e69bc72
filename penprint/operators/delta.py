"""Burrows' Delta as DataFrames: most frequent words, author frequencies, z-score differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import edge_words

def word_rows(docs: DataFrame, who: str) -> DataFrame:
    """(who, word, cnt): word counts by author or unknown id, words by the Delta rule."""
    words = docs.select(F.coalesce(F.col(who).cast("string"), F.lit("Unknown")).alias(who), F.explode(edge_words(F.col("text"))).alias("word"))
    return words.groupBy(who, "word").agg(F.count(F.lit(1)).alias("cnt"))


def frequencies(docs: DataFrame, who: str, features: DataFrame) -> DataFrame:
    """(who, word, f): share of every feature word among all of the author's words, absent ones 0."""
    counts = word_rows(docs, who)
    authors = docs.select(F.coalesce(F.col(who).cast("string"), F.lit("Unknown")).alias(who)).distinct()
    totals = counts.groupBy(who).agg(F.sum("cnt").alias("n"))
    grid = authors.crossJoin(F.broadcast(features.select("word")))  # a few hundred words
    return grid.join(counts, [who, "word"], "left").join(totals, who, "left").select(who, "word", F.coalesce(F.try_divide("cnt", "n"), F.lit(0.0)).alias("f"))


def top_words(docs: DataFrame, n: int) -> DataFrame:
    """(word, cnt): the n most frequent words; ties by word."""
    words = docs.select(F.explode(edge_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "word").limit(n)


def burrows_delta(corpus: DataFrame, unknown: DataFrame, n_features: int = 300, author: str = "author", unknown_id: str = "unknown_id") -> DataFrame:
    """(unknown_id, rank, author, delta, n_features): authors by mean absolute difference of z-scores, least first.

    Features are the most frequent words of corpus and unknowns together. Deviations are the population's over authors; a
    word without any counts with 1. The mean cancels out of the difference. Ties go by author. n_features is the number found.
    """
    features = top_words(corpus.select("text").unionByName(unknown.select("text")), n_features)
    known = frequencies(corpus, author, features)
    spread = known.groupBy("word").agg(F.stddev_pop("f").alias("s")).select("word", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s"))
    theirs = frequencies(unknown, unknown_id, features).withColumnRenamed("f", "fu")
    pairs = theirs.join(known, "word").join(F.broadcast(spread), "word")  # a row a feature
    delta = pairs.groupBy(unknown_id, author).agg(F.round(F.avg(F.abs(F.col("fu") - F.col("f")) / F.col("s")), 4).alias("delta"), F.count(F.lit(1)).alias("n_features"))
    place = F.row_number().over(Window.partitionBy(unknown_id).orderBy("delta", author))
    return delta.select(unknown_id, place.cast("long").alias("rank"), author, "delta", "n_features")
