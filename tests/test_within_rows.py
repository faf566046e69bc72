"""Work that stays within a document's row or a bounded block, and takes no square of its size."""

import math
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from penprint.operators import examples, local, segments, vectors, within
from penprint.operators import features as ft
from penprint.operators import tokens as tk
from penprint.operators.tagging import tag
from penprint.plans import style, tagged
from penprint.plans.profile import analyze

from .test_features import texts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_passages_of_long_paragraphs(spark):
    """A paragraph of many sentences is scored in one pass; a document's passages are ranked in its row. Scores to 9 digits tie by place."""
    rng = random.Random(2)
    long = " ".join(" ".join(["word"] * rng.randint(1, 9)) + "." for _ in range(4000))
    even = " ".join(["a b c d."] * 80)
    d = texts(spark, long, "\n\n".join([even] * 3), None, "", "... !?")
    pool = examples.candidate_pool(d, 12.0, True)
    assert "Exchange" not in plan(pool)
    rows = {(r.doc_id, r["rank"]): r for r in pool.collect()}
    assert [k for k in rows] == [(0, 1), (1, 1), (1, 2), (1, 3)] and rows[1, 1].text == even
    n = [len(s.split()) for s in long.split(".") if s.strip()]
    mean = sum(n) / len(n)
    want = abs(mean - 12) / 12 + 0.7 + max(0, 0.3 - sum((x - mean) ** 2 for x in n) / len(n) / 100)
    assert abs(rows[0, 1].score - want) < 1e-9


PIECES = ["the ", "don't ", "DON'T", "n't", "it's", "a'b'c'd ", "'", "''", " ", "\n", "\x0b", "\xa0", ".", "!?", ". .", '"', "“", "”", "Anna ", "opened ", "singing", " because ", "And ", "was ", "famous ", "quickly", "12", "½", "é", "漢字 ", "İ", "ΣΑΣ ", "Ünï ", "😀", ",", "-", "x"]


def odd_texts(spark):
    rng = random.Random(5)
    return texts(spark, None, "", " \n", "...", *("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60))) for _ in range(300))).repartition(3)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) < 1e-9
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def test_measures_equal_those_over_the_token_table(spark):
    d = odd_texts(spark)
    t = tag(tk.annotate(d)).persist()
    whole = analyze(d, backend="rules").persist()
    for name in ("pos", "sentence_openers", "syntax", "contractions", "dialogue", "function_words", "sentences"):
        theirs = ft.ANALYZERS[name](d, t, "en")
        names = theirs.columns
        want = {r.doc_id: r for r in theirs.collect()}
        ours = {r.doc_id: r for r in whole.where(f"{name} is not null").select("doc_id", f"{name}.*").select(names).collect()}
        assert set(want) == set(ours)
        for i, r in want.items():
            assert close(list(r), list(ours[i])), (name, r, ours[i])
    for name, f in (("vocabulary", ft.vocabulary_of), ("readability", ft.readability_rows), ("paragraphs", lambda d: ft.paragraphs(d, None, "en"))):
        want = {r.doc_id: r for r in f(d).collect()}
        ours = {r.doc_id: r for r in whole.where(f"{name} is not null").select("doc_id", f"{name}.*").collect()}
        assert set(want) == set(ours) and all(close(list(r), list(ours[i])) for i, r in want.items()), name
    french = ft.contractions(d, tk.annotate(d, "fr"), "fr")
    got = {r.doc_id: r for r in within.rows(d, "contractions", "fr").select(french.columns).collect()}
    assert all(close(list(r), list(got[r.doc_id])) for r in french.collect())


def test_vectors_take_one_pass(spark, sf):
    """No shuffle, and a vector's length is taken once, not once a place."""
    assert "Exchange" not in plan(style.QUERIES["style_profile_vectors"](spark, sf))
    v = spark.createDataFrame([([float(i % 7) for i in range(20000)],)], "v array<double>")
    began = time.time()
    got = v.select(vectors.l2_normalize(F.col("v"))).first()[0]
    assert abs(sum(x * x for x in got) - 1) < 1e-9 and time.time() - began < 20


def test_tag_queries_do_not_shuffle(spark, sf):
    for name in ("opener_tags", "conjunction_starts", "pos_rates", "attribution_verbs", "pos_shares", "tense_shares", "tree_depth", "contraction_rates", "contractions_topn", "style_bands"):
        assert "Exchange" not in plan(style.QUERIES[name](spark, sf)), name


def test_rules_read_the_texts_few_times(spark, sf):
    """No window over tokens and no join of texts: sums by source of what each row counts."""
    shown = plan(tagged.source_fields(spark, sf))
    assert "Window" not in shown and shown.count("FileScan parquet") <= 4


def test_nearest_meets_the_store_block_by_block(spark, monkeypatch):
    """Ties, copies, zero, null and NaN vectors, repeated and null ids; no pairs of blocks and no window over neighbours."""
    rng = random.Random(8)
    some = [[rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)] for _ in range(120)]
    rows = [(i, v) for i, v in enumerate(some)] + [(7, some[3]), (None, some[0]), (500, None), (501, [float("nan")] * 4)]
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    monkeypatch.setattr(vectors, "QUERIES", 10)  # 12 groups of queries
    found = vectors.nearest(d, d, 5, "id", "id", "v", same=True, block=7)
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found) and "Window" not in plan(found)
    got = {(r.query, r["rank"]): r.neighbour for r in found.collect()}
    norm = lambda a: math.sqrt(sum(x * x for x in a)) or 1.0
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b), 12) + 0.0
    valid = [(i, v) for i, v in rows if i is not None and i < 500]
    for i in {i for i, _ in valid}:
        want = sorted((-cos(a, b), j) for k, a in valid if k == i for j, b in valid if j != i)[:5]
        assert [got[i, r] for r in range(1, 6)] == [j for _, j in want]


def test_segments_take_few_texts_at_a_time(spark, sf):
    for name in ("markdown_segments", "pattern_segments", "article_segments"):
        assert "MapInPandas" not in plan(style.QUERIES[name](spark, sf)), name
    d = spark.createDataFrame([(i, "# A\nx\n" * 3 if i % 2 else None) for i in range(50)] + [(None, "plain")], "doc_id long, text string")
    got = segments.segments(d, "markdown").collect()
    assert len(got) == 25 * 3 + 1 and [r.text for r in got if r.doc_id is None] == ["plain"]
    rule = pa.array(["ab", None, "c" * 9, "d"])
    assert list(local.text_parts(rule)) == [(0, 4)]


def test_parts_of_texts_are_bounded(monkeypatch):
    monkeypatch.setattr(local, "ITEMS", 5)
    assert list(local.text_parts(pa.array(["ab", None, "c" * 9, "d", "", "e" * 4]))) == [(0, 2), (2, 3), (3, 5), (5, 6)]
