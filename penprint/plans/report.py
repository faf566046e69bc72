"""One collected profile row as text or as a page; series for charts stay DataFrames."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chart_series(profiles: DataFrame) -> DataFrame:
    """(doc_id, series, x, y): readability, sentence histogram, punctuation and function words in long form."""
    parts = []
    for group, fields in (("readability", None), ("punctuation", None)):
        if group in profiles.columns:
            names = [f for f in (fields or profiles.schema[group].dataType.names) if f != "parenthesis"]
            pairs = F.array(*(F.struct(F.lit(n).alias("x"), F.col(f"{group}.{n}").cast("double").alias("y")) for n in names))
            parts.append(profiles.select("doc_id", F.lit(group).alias("series"), F.inline(pairs)))
    if "sentences" in profiles.columns:
        rows = profiles.select("doc_id", F.posexplode("sentences.length_distribution").alias("b", "n"))
        parts.append(rows.select("doc_id", F.lit("sentence_length").alias("series"), (F.col("b") * 5).cast("string").alias("x"), F.col("n").cast("double").alias("y")))
    if "function_words" in profiles.columns:
        rows = profiles.select("doc_id", F.explode("function_words.frequencies").alias("e"))
        parts.append(rows.select("doc_id", F.lit("function_words").alias("series"), F.col("e.key").alias("x"), F.col("e.count").cast("double").alias("y")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bars(series: DataFrame, width: int = 40) -> DataFrame:
    """Each value as a bar of width * y / the series' greatest y, rounded down."""
    most = F.max("y").over(Window.partitionBy("doc_id", "series"))
    return series.withColumn("bar", F.coalesce(F.floor(F.try_divide(F.col("y"), most) * width), F.lit(0)))


def comparison_bars(ranked: DataFrame, width: int = 20) -> DataFrame:
    """Delta's rows with a bar that is longer the nearer the author, and whether the author is the most likely one."""
    most = F.max("delta").over(Window.partitionBy("unknown_id"))
    bar = F.coalesce(F.floor((1 - F.try_divide("delta", most)) * width), F.lit(width)).cast("long")
    return ranked.withColumns({"most_likely": F.col("rank") == 1, "bar": bar})


def text_report(profile: dict, top: int = 10) -> str:
    lines = [f"document {profile.get('doc_id')}: {profile.get('word_count')} words"]
    for group, values in profile.items():
        if isinstance(values, dict):
            lines.append(f"\n{group}")
            for name, v in values.items():
                if isinstance(v, list):
                    v = ", ".join(f"{e['key']} {e['count']}" if isinstance(e, dict) else str(e) for e in v[:top])
                lines.append(f"  {name:28} {v}")
    return "\n".join(lines)


def html_report(profile: dict) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Style report</title></head><body><pre>{escape(text_report(profile, 30))}</pre></body></html>"
