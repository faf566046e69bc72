"""Passages of a document that come closest to a target style."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .local import text_parts


def packs(text: str, most: int, short: int) -> list[tuple[str, int]]:
    """(text, words) of each pack of a text's paragraphs, in order."""
    done, held, n = [], [], 0
    for p in text.split("\n\n"):
        p = p.strip(" ")
        k = len(p.split())
        if k < short:
            continue
        if n > 0 and n + k <= most:
            held.append(p)
            n += k
            continue
        if n > 0:
            done.append(("\n\n".join(held), n))
        held, n = [p], k
    return [*done, ("\n\n".join(held), n)] if n > 0 else done


def passages(docs: DataFrame, least: int = 60, most: int = 300, short: int = 10) -> DataFrame:
    """(doc_id, at, text): paragraphs of `short` words or more, packed in order up to `most` words; packs under `least` go.

    A paragraph longer than `most` is a pack of its own.
    """
    return _rows(docs, "at int, text string", lambda text: [(at, t) for at, (t, n) in enumerate(packs(text, most, short)) if n >= least])


def passage_score(text: str, target_length: float, dialogue: bool) -> float:
    """How far a passage is from the style, less being better: relative error of mean sentence length, 0.3 without an
    apostrophe, 0.4 without a quote mark in a dialogue style, and up to 0.3 for even sentences. 999 without a sentence."""
    n = [len(s.split()) for s in text.replace("!", ".").replace("?", ".").split(".") if s.strip(" ")]
    if not n:
        return 999.0
    mean, squares = sum(n) / len(n), 0.0
    for x in n:  # in order, without sum()'s compensation, as the SQL adds
        squares += (x - mean) * (x - mean)
    off = abs(mean - target_length) / target_length if target_length else 0.0
    return off + (0.0 if "'" in text else 0.3) + (0.4 if dialogue and '"' not in text else 0.0) + max(0.0, 0.3 - squares / len(n) / 100)


def candidate_pool(docs: DataFrame, target_length: float, dialogue: bool, n: int = 5, least: int = 60, most: int = 300) -> DataFrame:
    """(doc_id, rank, text, score): the best fifth of each document's passages, 2 n at least; scores equal to 9 digits in order of place."""

    def best(text: str) -> list[tuple]:
        scored = [(t, passage_score(t, float(target_length), dialogue)) for t, words in packs(text, most, 10) if words >= least]
        order = sorted(range(len(scored)), key=lambda i: (round(scored[i][1], 9), i))[: max(len(scored) // 5, 2 * n)]
        return [(rank, *scored[i]) for rank, i in enumerate(order, 1)]

    return _rows(docs, "rank int, text string, score double", best)


def _rows(docs: DataFrame, schema: str, rows_of) -> DataFrame:
    """(doc_id, ...): the rows that rows_of makes of each text, without a shuffle; null texts give none."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, kinds = zip(*(c.split() for c in schema.split(", ")))
        kinds = [{"int": pa.int32(), "string": pa.string(), "double": pa.float64()}[k] for k in kinds]
        for batch in batches:
            for a, b in text_parts(batch.column(1)):
                rows = [(a + i, *r) for i, text in enumerate(batch.column(1).slice(a, b - a).to_pylist()) if text is not None for r in rows_of(text)]
                if rows:
                    at, *columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def select_examples(pool: list[str], n: int = 5, seed: int = 42) -> list[str]:
    """n of a document's pool, drawn with the seed; all if there are no more."""
    return pool if len(pool) <= n else random.Random(seed).sample(pool, n)
