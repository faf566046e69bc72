"""Command line: python -m penprint.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import delta, diff
from .plans.profile import analyze
from .plans.prompt import build_prompt
from .plans.report import html_report, text_report
from .sources.readers import read_files
from .sources.store import Store
from .streaming.ingest import to_rows


def flat_profile(docs, lang: str = "en"):
    """What diff rules and bands read, by document."""
    p = analyze(docs, ["readability", "sentences", "vocabulary", "contractions", "paragraphs", "punctuation", "sentence_openers", "dialogue", "syntax"], lang)
    from_ = lambda g, f: F.col(f"{g}.{f}") if g in p.columns else F.lit(None).cast("double")
    fields = {
        "flesch_reading_ease": ("readability", "flesch_reading_ease"), "mean_length": ("sentences", "mean_length"), "skewness": ("sentences", "skewness"), "ttr": ("vocabulary", "ttr"),
        "contraction_rate": ("contractions", "rate_per_1000"), "one_sentence_ratio": ("paragraphs", "one_sentence_ratio"), "paragraph_median": ("paragraphs", "median_length"),
        "dash": ("punctuation", "dash"), "question": ("punctuation", "question"), "semicolon": ("punctuation", "semicolon"),
        "conjunction_start_rate": ("sentence_openers", "conjunction_start_rate"), "quoted_word_ratio": ("dialogue", "quoted_word_ratio"), "mean_tree_depth": ("syntax", "mean_tree_depth"),
    }
    return p.select("doc_id", *(from_(g, f).alias(name) for name, (g, f) in fields.items()))


def show_all(rows) -> None:
    """Prints every row, however many."""
    rows = rows.cache()
    rows.show(rows.count(), False)
    rows.unpersist()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("penprint")
    sub = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.add_parser(name)] and [sub.choices[name].add_argument(*a, **k) for a, k in args]
    lang = (["--lang"], {"default": "en"})
    add("ingest", (["path"], {}), (["-o", "--output"], {"required": True}))
    add("analyze", (["path"], {}), (["-o", "--output"], {"required": True}), (["--analyzers"], {"default": ""}), lang)
    add("compare", (["corpus"], {}), (["unknown"], {}), (["-n"], {"type": int, "default": 300}))
    add("report", (["path"], {}), (["-f", "--format"], {"default": "text", "choices": ["text", "html", "json"]}), lang)
    add("stylize", (["article"], {}), (["style"], {}), (["--mode"], {"default": "restyle"}), lang)
    add("index", (["path"], {}), (["store"], {}), (["-a", "--author"], {"required": True}), lang)
    add("search-style", (["path"], {}), (["store"], {}), (["-n"], {"type": int, "default": 10}), lang)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    docs = read_files(spark, a.path if hasattr(a, "path") else a.article if a.command == "stylize" else a.corpus)
    if a.command == "ingest":
        docs.write.json(a.output)
    elif a.command == "analyze":
        analyze(docs, [x for x in a.analyzers.split(",") if x] or None, a.lang).write.json(a.output)
    elif a.command == "compare":
        unknown = read_files(spark, a.unknown).select(F.col("path").alias("unknown_id"), "text")
        show_all(delta.burrows_delta(docs.where("text is not null"), unknown, a.n).orderBy("unknown_id", "rank"))
    elif a.command == "report":
        row = analyze(docs, None, a.lang).first()
        as_json = lambda profile: json.dumps(profile, ensure_ascii=False, default=str)
        print({"json": as_json, "html": html_report, "text": text_report}[a.format](row.asDict(True)))
    elif a.command == "stylize":
        style = read_files(spark, a.style)
        rules = diff.profile_diff(flat_profile(docs, a.lang), flat_profile(style, a.lang), "doc_id", "doc_id").first()
        bands = diff.style_bands(flat_profile(style, a.lang)).first()
        print(build_prompt(bands.asDict(), rules.instructions.split(",") if rules.instructions else [], mode=a.mode))
    elif a.command == "index":
        Store(spark, a.store).upsert(to_rows(docs.withColumn("author", F.lit(a.author)), None, a.lang))
    elif a.command == "search-style":
        rows = to_rows(docs, None, a.lang).select(F.xxhash64("document_id").alias("query"), "vector")
        show_all(Store(spark, a.store).search(rows, a.n).orderBy("query", "rank"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
