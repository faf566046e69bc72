"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_mix, op2_counts, op3_sentences, op4_quality, op5_neighbours, op6_media, op7_bpe, op8_ordermin, op9_suffix, op10_langid

MODULES = [op1_mix, op2_counts, op3_sentences, op4_quality, op5_neighbours, op6_media, op7_bpe, op8_ordermin, op9_suffix, op10_langid]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
