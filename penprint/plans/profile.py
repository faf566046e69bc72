"""Documents to style profiles: one row a document with a struct for each analyzer asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import LANGUAGES, check
from ..functions.normalize import word_count
from ..operators import features as ft
from ..operators import tokens as tk
from ..operators import within
from ..operators.features import ANALYZERS


def analyze(docs: DataFrame, analyzers: list[str] | None = None, lang: str = "en", backend: str = "regex", tokens: DataFrame | None = None) -> DataFrame:
    """doc_id, word_count and a struct column for each analyzer; unknown names are skipped.

    Readability is left null for languages without rules for it, pos where the backend has no model. Every document has a
    row; a group is null where the document has nothing to measure. With the regex backend most analyzers count within each row and
    need no token table. Those that do, and all of them with other backends, share one: give one that has been written or persisted.
    With the rules backend and no table, all but n-grams are counted in one pass, each row a document of its own.
    """
    check(lang)
    names = [n for n in (analyzers or ANALYZERS) if n in ANALYZERS]
    if LANGUAGES[lang][2] is None:
        names = [n for n in names if n != "readability"]
    if tokens is None and backend == "rules":
        out = in_one_pass(docs, [n for n in names if n == "punctuation" or n in within.GROUPS], lang)
        for name in names:
            if name not in out.columns:
                group = ANALYZERS[name](docs, None, lang)
                out = out.join(group.select("doc_id", F.struct(*(c for c in group.columns if c != "doc_id")).alias(name)), "doc_id", "left")
        return out.select("doc_id", "word_count", *names)
    tokens = tk.annotate(docs, lang, backend) if tokens is None and backend != "regex" else tokens
    out = docs.select("doc_id", F.coalesce(word_count(F.col("text")), F.lit(0)).alias("word_count"))
    for name in names:
        group = ANALYZERS[name](docs, tokens, lang)
        packed = group.select("doc_id", F.struct(*(c for c in group.columns if c != "doc_id")).alias(name))
        out = out.join(packed, "doc_id", "left")
    return out


def in_one_pass(docs: DataFrame, names: list[str], lang: str) -> DataFrame:
    """doc_id, word_count and the structs of these analyzers, without a shuffle."""
    rows = docs.select("doc_id", "text", F.coalesce(word_count(F.col("text")), F.lit(0).cast("long")).alias("word_count"))
    if "punctuation" in names:
        rows = rows.withColumn("punctuation", F.struct(*ft.punctuation_columns(F.coalesce("text", F.lit("")), F.col("word_count"))))
    groups = [n for n in names if n in within.GROUPS]
    rows = within.measure(rows, groups, lang)
    shape = {
        "vocabulary": lambda of: ft.vocabulary_columns(of("n"), of("v"), of("v1"), of("ff")), "readability": lambda of: ft.readability_columns(*(of(k) for k in "wsyhc")),
        "syntax": lambda of: [
            *(of(k).alias(k) for k in ("mean_tree_depth", "median_tree_depth", "stdev_tree_depth", "tense_distribution")),
            F.create_map(*(x for k in ("declarative", "interrogative", "exclamatory") for x in (F.lit(k), of(k)))).alias("sentence_type_mix"),
        ],
    }
    for g in groups:
        fields = [f.split()[0] for f in within.GROUPS[g].split(", ")]
        of = lambda k, g=g: F.col(f"{g}.{k}")
        made = shape[g](of) if g in shape else [of(k).alias(k) for k in fields if k not in within.SUMS.get(g, ())]
        rows = rows.withColumn(g, F.when(F.col(g).isNotNull(), F.struct(*made)))
    return rows
