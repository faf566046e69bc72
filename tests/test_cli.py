import json

from pyspark.sql import functions as F

from penprint import cli


def printed(out):
    return sum(line.startswith("|") for line in out.splitlines()) - 1  # without the names of the columns


def test_compare_prints_every_row(spark, monkeypatch, capsys):
    monkeypatch.setattr(cli, "read_files", lambda s, path: s.createDataFrame([("x", "a text")], "path string, text string"))
    monkeypatch.setattr(cli.delta, "burrows_delta", lambda *a: spark.range(150).select(F.col("id").alias("unknown_id"), F.lit(1).alias("rank")))
    assert cli.main(["compare", "corpus", "unknown"]) == 0
    assert printed(capsys.readouterr().out) == 150


def test_search_style_prints_every_row(spark, monkeypatch, capsys):
    monkeypatch.setattr(cli, "read_files", lambda s, path: s.createDataFrame([("x", "a text")], "path string, text string"))
    monkeypatch.setattr(cli, "to_rows", lambda docs, *a: docs.select(F.lit(1).alias("document_id"), F.lit(0.0).alias("vector")))
    monkeypatch.setattr(cli.Store, "__init__", lambda self, *a: None)
    monkeypatch.setattr(cli.Store, "search", lambda self, *a: spark.range(150).select(F.col("id").alias("query"), F.lit(1).alias("rank")))
    assert cli.main(["search-style", "path", "store"]) == 0
    assert printed(capsys.readouterr().out) == 150


def test_report_prints_json(spark, monkeypatch, capsys):
    monkeypatch.setattr(cli, "read_files", lambda s, path: s.createDataFrame([("x", "It is short. “Is it?” Yes!")], "doc_id string, text string"))
    assert cli.main(["report", "path", "-f", "json"]) == 0
    profile = json.loads(capsys.readouterr().out)
    assert profile["doc_id"] == "x" and profile["sentences"]["count"] > 0
