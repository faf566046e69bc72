"""One annotation pass: documents to the token table that every analyzer aggregates.

tokens(doc_id, sent_id, tok_i, text, lower, lemma, pos, dep, tense, is_punct, is_space, depth). The native backend fills what
regular expressions can decide and leaves lemma, pos, dep, tense and depth null; a backend with a model fills these too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sentence goes up to and with its stops; stops alone are one too, so no token is lost.
SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"
WORDS = r"\p{L}+(?:'\p{L}+)?|\p{N}+"
TOKEN = WORDS + r"|[^\s\p{L}\p{N}]"
WORD = r"^[\p{L}\p{N}]"
EDGES = ".,;:!?\"'()-"
SCHEMA = (
    "doc_id long, sent_id int, tok_i int, text string, lower string, lemma string, pos string, dep string, tense string, "
    "is_punct boolean, is_space boolean, depth int"
)


def sentences(text: Column) -> Column:
    """The text's sentences in order, blank ones dropped."""
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: s.rlike(r"\S"))


def pieces(sentence: Column, elided: bool = False) -> Column:
    """A sentence's tokens; contractions fall in two, the suffix with its apostrophe or, if elided, the prefix with it."""
    found = F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))
    cut = r"^(\p{L}+')(\p{L}+)$" if elided else r"^(\p{L}+?)(n't|N'T|'\p{L}+)$"
    halves = lambda t: F.when(
        F.contains(t, F.lit("'")) & t.rlike(cut), F.array(F.regexp_extract(t, cut, 1), F.regexp_extract(t, cut, 2))
    ).otherwise(F.array(t))
    return F.flatten(F.transform(found, halves))


def annotate(docs: DataFrame, lang: str = "en", backend: str = "regex") -> DataFrame:
    """The token table of docs (doc_id, text). Null and empty texts give no tokens.

    backend: regex leaves tags null and needs no shuffle; rules adds the declared tags of tagging.py; spacy uses a model.
    """
    if backend == "spacy":
        return annotate_with_model(docs, lang)
    if backend == "rules":
        from .tagging import tag

        return tag(annotate(docs, lang), lang)
    from ..functions.languages import ELISION

    cut = F.transform(sentences(F.col("text")), lambda s, i: F.transform(pieces(s, lang in ELISION), lambda t: F.struct(i.alias("sent_id"), t.alias("text"))))
    flat = docs.select("doc_id", F.posexplode(F.flatten(cut)).alias("tok_i", "t"))
    none = lambda kind: F.lit(None).cast(kind)
    return flat.select(
        "doc_id", F.col("t.sent_id").cast("int").alias("sent_id"), "tok_i", F.col("t.text").alias("text"), F.lower("t.text").alias("lower"),
        none("string").alias("lemma"), none("string").alias("pos"), none("string").alias("dep"), none("string").alias("tense"),
        (~F.col("t.text").rlike(r"^'?[\p{L}\p{N}]")).alias("is_punct"), F.lit(False).alias("is_space"), none("int").alias("depth"),
    )


def annotate_with_model(docs: DataFrame, lang: str) -> DataFrame:
    """The token table from a parsing model, loaded once a worker; needs the library on the executors."""
    from ..functions.languages import LANGUAGES, check

    name = LANGUAGES[check(lang)][1]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        try:
            import spacy
        except ImportError:
            raise RuntimeError("backend 'spacy' needs spaCy and its model on every executor; backend 'regex' needs nothing") from None
        model = spacy.load(name)
        for pdf in batches:
            model.max_length = max(model.max_length, int(pdf["text"].str.len().max() or 0) + 1)
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"].fillna("")):
                for s, sentence in enumerate(model(text).sents):
                    root = next((t for t in sentence if t.dep_ == "ROOT"), None)
                    depth, todo = {}, [(root, 0)] if root is not None else []
                    while todo:
                        token, level = todo.pop()
                        depth[token.i] = level
                        todo.extend((child, level + 1) for child in token.children)
                    for t in sentence:
                        tense = (t.morph.get("Tense") or [None])[0]
                        rows.append((doc_id, s, t.i, t.text, t.lower_, t.lemma_, t.pos_, t.dep_, tense, t.is_punct, t.is_space, depth.get(t.i)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def words(tokens: DataFrame) -> DataFrame:
    return tokens.where(~F.col("is_punct") & ~F.col("is_space"))


def visible(tokens: DataFrame) -> DataFrame:
    return tokens.where(~F.col("is_space"))


def edge_words(text: Column) -> Column:
    """Words between white space in lower case without punctuation at either end; empty ones dropped. Used by Delta."""
    from ..functions.normalize import SPACE

    split = F.split(F.lower(text), rf"(?U){SPACE}+")
    bare = F.transform(split, lambda w: F.regexp_replace(w, r"^[.,;:!?\"'()\-]+|[.,;:!?\"'()\-]+$", ""))
    return F.filter(bare, lambda w: w != "")
