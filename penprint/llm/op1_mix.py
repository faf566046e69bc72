"""Operator 1: mix sources to target weights.

Capped water-filling decides how often each source is seen; a seeded draw turns that into copies of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

#: Production parameters of the query and the pipeline. Sources without an entry have the weight 1.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 3.0, "src3": 0.5}
EPOCHS = 4.0
BUDGET = 1.0
SEED = 17

#: Sources up to which their passes are sent to every executor: some 5 MB.
BROADCAST_ROWS = 100_000


def water_fill(sizes: dict[str, float], weights: dict[str, float], budget: float, epochs: float) -> dict[str, float]:
    """Passes over each source: shares of the budget by weight, none over `epochs` passes.

    Sources whose share exceeds the cap are clamped and the excess goes to the others in proportion to their weights, until
    no share exceeds it. If the budget exceeds what all positive-weight sources hold at the cap, all of them are clamped.
    Sources of size 0 or weight 0 get 0 passes.
    """
    open_ = {s for s, n in sizes.items() if n > 0 and weights.get(s, 1.0) > 0}
    passes, left = {s: 0.0 for s in sizes}, float(budget)
    while open_:
        total = sum(weights.get(s, 1.0) for s in sorted(open_))
        share = {s: left * weights.get(s, 1.0) / total for s in open_}
        over = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not over:
            passes |= {s: share[s] / sizes[s] for s in open_}
            break
        passes |= {s: epochs for s in over}
        left -= sum(epochs * sizes[s] for s in sorted(over))
        open_ -= over
    return passes


def draw(doc_id, seed: int):
    """A number in [0, 1) from the document's id and the seed: the first 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, epochs=EPOCHS, seed=SEED, size="text") -> DataFrame:
    """Every column of docs plus copy (0, 1, ...), one row for each copy that the mix takes of a document.

    budget is a multiple of all sources' total size. A document's size is its number of characters (size="text") or the
    named column. A source that is to be passed p times gives floor(p) copies of each document and one more of those
    whose draw is under p's fraction. The draw hangs on doc_id and seed alone: repeated rows with one doc_id are drawn
    alike, null doc_ids draw 0, and partitions, order and executors don't matter. Null sources count as one source named
    "". Null texts have size 0; a source of size 0 in all gives no rows. A column named copy is replaced. An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.drop("copy")
    n = F.length("text") if size == "text" else F.col(size)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    # One row for each source: as many as the mix has weights for, whatever the number of documents.
    sizes = {r[0]: float(r[1] or 0) for r in docs.groupBy(source.alias("s")).agg(F.sum(n.cast("long"))).collect()}
    passes = water_fill(sizes, weights, budget * sum(sizes.values()), epochs)
    kind = T.StructType([T.StructField("__s", T.StringType()), T.StructField("__p", T.DoubleType())])
    table = spark.createDataFrame(sorted((s, float(p)) for s, p in passes.items() if p > 0), kind)
    u = F.coalesce(draw(F.col("doc_id"), seed), F.lit(0.0))
    copies = (F.floor("__p") + (u < F.col("__p") - F.floor("__p")).cast("long")).cast("int")
    if len(passes) <= BROADCAST_ROWS:  # else a shuffle join
        table = F.broadcast(table)
    return (
        docs.join(table, source == F.col("__s"))
        .withColumn("__n", copies)
        .where("__n > 0")
        .withColumn("copy", F.explode(F.expr("sequence(0, __n - 1)")))
        .drop("__s", "__p", "__n")
    )


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "source", "copy")


def _sql() -> str:
    values = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())
    # Clamping as nested rounds: a source once clamped stays so; there are never more rounds than sources.
    return f"""
WITH RECURSIVE weights(source, weight) AS (VALUES {values}),
sizes AS (
  SELECT coalesce(d.source, '') AS source, sum(length(text))::DOUBLE AS size, coalesce(any_value(w.weight), 1.0)::DOUBLE AS weight
  FROM documents d LEFT JOIN weights w ON w.source = coalesce(d.source, '') GROUP BY 1),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY weight / size DESC, source) AS k, {BUDGET} * sum(size) OVER () AS budget
  FROM sizes WHERE size > 0 AND weight > 0),
tried AS (  -- with the k-1 tightest sources clamped, source k's passes
  SELECT source, k, (budget - coalesce(sum({EPOCHS} * size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         * weight / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / size AS p FROM ranked),
free AS (SELECT coalesce(min(k) FILTER (WHERE p <= {EPOCHS}), 1 + count(*)) AS k FROM tried),
level AS (  -- the open sources share what the clamped ones leave
  SELECT r.source, CASE WHEN r.k < f.k THEN {EPOCHS} ELSE
    (r.budget - coalesce((SELECT sum({EPOCHS} * size) FROM ranked c WHERE c.k < f.k), 0)) * r.weight
    / (SELECT sum(weight) FROM ranked o WHERE o.k >= f.k) / r.size END AS p
  FROM ranked r, free f),
drawn AS (
  SELECT d.doc_id, d.source, floor(p)::BIGINT + (CASE WHEN coalesce(('0x' || md5(d.doc_id || ':{SEED}')[1:13])::BIGINT / 4503599627370496.0, 0) < p - floor(p)
    THEN 1 ELSE 0 END) AS n
  FROM documents d JOIN level l ON l.source = coalesce(d.source, ''))
SELECT doc_id, source, unnest(range(n))::INTEGER AS copy FROM drawn
"""


QUERIES = {"op1_mix": op1_mix}
SQL = {"op1_mix": _sql()}
