"""The profile store: a Parquet folder of versions that is replaced as a whole; author rows are derived, never stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import vectors

SCHEMA = "document_id string, title string, author string, lang string, word_count long, profile string, vector array<double>, created_at timestamp"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), lambda p: jvm.org.apache.hadoop.fs.Path(p)

    def exists(self) -> bool:
        fs, at = self._fs()
        return fs.exists(at(self.path))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path) if self.exists() else self.spark.createDataFrame([], SCHEMA)

    def _replace(self, rows: DataFrame) -> None:
        """Writes beside the store first, so that a failed job leaves it as it was."""
        fs, at = self._fs()
        staged, old = f"{self.path}.{uuid.uuid4().hex}", f"{self.path}.old"
        rows.write.parquet(staged)
        fs.delete(at(old), True)
        if fs.exists(at(self.path)):
            fs.rename(at(self.path), at(old))
        fs.rename(at(staged), at(self.path))
        fs.delete(at(old), True)

    def upsert(self, new: DataFrame) -> None:
        """Rows by document_id: new ones replace those stored; of several new rows with one id the last created stays."""
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        new = new.withColumns({"created_at": F.current_timestamp()} if "created_at" not in new.columns else {}).select(columns)
        both = self.rows().withColumn("v", F.lit(0)).unionByName(new.withColumn("v", F.lit(1)))
        last = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("v"), F.desc("created_at"), F.desc("profile")))
        self._replace(both.withColumn("k", last).where("k = 1").select(columns))

    def delete(self, ids: DataFrame) -> None:
        self._replace(self.rows().join(ids.select("document_id"), "document_id", "left_anti"))

    def missing(self, docs: DataFrame) -> DataFrame:
        """Documents that aren't stored yet: what a repeated batch has to analyze."""
        return docs.join(self.rows().select("document_id"), "document_id", "left_anti")

    def get(self, document_id: str) -> DataFrame:
        return self.rows().where(F.col("document_id") == document_id)

    def documents(self) -> DataFrame:
        return self.rows().select("document_id", "title", "author", "lang", "word_count").orderBy("title", "document_id")

    def authors(self) -> DataFrame:
        return vectors.centroids(self.rows().where("author is not null"), "author", "vector").orderBy("author")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query, rank, document_id, similarity) for every query (query long, vector)."""
        rows = self.rows().where("vector is not null").withColumn("n", F.xxhash64("document_id"))
        found = vectors.nearest(queries, rows, k, "query", "n", "vector")
        return found.join(rows.select("n", "document_id"), found["neighbour"] == F.col("n")).select("query", "rank", "document_id", "similarity")
