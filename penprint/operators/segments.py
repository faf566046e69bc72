"""One document to many segments: none, plain blocks, Markdown headers, a pattern, or article titles."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import SPACE
from .local import text_parts

SCHEMA = "doc_id long, at int, title string, text string, char_start long, char_end long"
MARKDOWN = r"^(#{1,2})\s+(.+)$"


def plain_segments(docs: DataFrame) -> DataFrame:
    """(doc_id, at, text, char_start, char_end): blocks between blank lines, stripped, blank ones dropped. A text of one block
    comes whole and unstripped. Offsets come from a running sum of the lengths before each block."""
    cut = docs.select("doc_id", F.split("text", "\n\n+").alias("l"), F.regexp_extract_all(F.col("text"), F.lit("\n\n+"), F.lit(0)).alias("g"))
    rows = cut.select("doc_id", F.size("l").alias("n"), F.posexplode(F.arrays_zip("l", "g")).alias("at", "e")).select("doc_id", "n", "at", "e.l", F.coalesce("e.g", F.lit("")).alias("g"))
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("l") + F.length("g")).over(before), F.lit(0)).cast("long")
    left = F.regexp_replace("l", rf"(?U)^{SPACE}+", "")
    bare = F.regexp_replace(left, rf"(?U){SPACE}+\z", "")
    one = F.col("n") == 1
    rows = rows.select("doc_id", "at", "l", start.alias("s"), one.alias("one"), F.length(left).alias("left"), bare.alias("bare"))
    text = F.when(F.col("one"), F.col("l")).otherwise(F.col("bare"))
    begin = F.when(F.col("one"), F.col("s")).otherwise(F.col("s") + F.length("l") - F.col("left"))
    rows = rows.where(F.length("bare") > 0)
    return rows.select("doc_id", F.col("at").cast("long").alias("at"), text.alias("text"), begin.alias("char_start"), (begin + F.length(text)).alias("char_end"))


def cut_at(text: str, matches: list, title) -> list[tuple]:
    """Segments from each match to the next; what is before the first is left out. Without matches the whole text."""
    if not matches:
        return [(0, None, text, 0, len(text))]
    ends = [m.start() for m in matches[1:]] + [len(text)]
    return [(i, title(m), text[m.start() : e].strip(), m.start(), e) for i, (m, e) in enumerate(zip(matches, ends))]


def by_pattern(text: str, pattern: str) -> list[tuple]:
    return cut_at(text, list(re.finditer(pattern, text, re.MULTILINE)), lambda m: m.group(0).strip() if m.group(0) else None)


def by_markdown(text: str) -> list[tuple]:
    return cut_at(text, list(re.finditer(MARKDOWN, text, re.MULTILINE)), lambda m: m.group(2).strip())


def by_articles(text: str) -> list[tuple]:
    """Segments that begin with a line of 3 to 80 capitals between blank lines; fewer than two such lines give the whole text,
    and segments of 50 characters or less are left out."""
    found = [m for m in re.finditer(r"(?:(?<=\n\n)|\A)([A-Z][A-Z0-9 ,.'\-:&!?]{2,79})(?=\n\n)", text)]
    if len(found) < 2:
        return cut_at(text, [], None)
    return [s for s in cut_at(text, found, lambda m: m.group(1).strip()) if len(s[2]) > 50]


def segments(docs: DataFrame, kind: str = "none", pattern: str | None = None) -> DataFrame:
    """SCHEMA rows of docs (doc_id, text) by kind: none, text, markdown, articles or pattern. Null texts give no rows."""
    if kind == "text":
        return plain_segments(docs).select("doc_id", F.col("at").cast("int").alias("at"), F.lit(None).cast("string").alias("title"), "text", "char_start", "char_end")
    if kind == "none":
        return docs.where("text is not null").select("doc_id", F.lit(0).alias("at"), F.lit(None).cast("string").alias("title"), "text", F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end"))
    if kind == "pattern":
        re.compile(pattern)
    rules = {"markdown": by_markdown, "articles": by_articles, "pattern": lambda t: by_pattern(t, pattern)}
    if kind not in rules:
        raise ValueError(f"unknown kind {kind!r}")
    rule = rules[kind]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("title", pa.string()), ("text", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())])
        for batch in batches:
            ids, texts = batch.columns
            for a, b in text_parts(texts):
                rows = [(d, *s) for d, t in zip(ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist()) if t is not None for s in rule(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
