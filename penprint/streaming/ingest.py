"""Documents that arrive as a stream of files: each batch is analyzed and upserted into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import document_id
from ..operators.vectors import style_vector
from ..plans.profile import analyze
from ..sources.store import Store


def to_rows(docs: DataFrame, analyzers: list[str] | None = None, lang: str = "en") -> DataFrame:
    """Store rows of docs (text, title, author)."""
    docs = docs.where("text is not null").withColumn("doc_id", document_id(F.col("text"))).dropDuplicates(["doc_id"])
    p = analyze(docs, analyzers, lang)
    groups = [c for c in p.columns if c not in ("doc_id", "word_count")]
    p = p.select("doc_id", "word_count", F.to_json(F.struct(*groups)).alias("profile"), style_vector(p).alias("vector"))
    return p.join(docs.select("doc_id", "title", "author"), "doc_id").select(F.col("doc_id").alias("document_id"), "title", "author", F.lit(lang).alias("lang"), "word_count", "profile", "vector")


def ingest(spark: SparkSession, source: str, store: Store, checkpoint: str, analyzers: list[str] | None = None) -> StreamingQuery:
    """Reads JSON lines (title, author, text) as they appear under source. Upserts are by content, so a batch that runs twice
    after a failure changes nothing."""
    lines = spark.readStream.schema("title string, author string, text string").json(source)
    write = lambda batch, _: store.upsert(to_rows(batch, analyzers))
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
