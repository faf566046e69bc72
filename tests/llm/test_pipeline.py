import collections

from pyspark.sql import functions as F

import corpus_pipeline
from penprint.llm import op1_mix, op8_ordermin, op10_langid
from penprint.llm.bpe_files import fast_encoding

from .test_operators import cut_brute


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near copies", "repeated passages", "mix", "tokens"]


def test_run_against_brute_force(spark, sf):
    """Copies and cuts are found by brute force; the first and fourth stage's decisions have SQL of their own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = op10_langid.identify(docs, op10_langid.profiles(docs)).where("accepted").collect()
    texts = {r.doc_id: r.text for r in known}
    group = {i: i for i in texts}
    ids = sorted(texts, key=lambda i: len(texts[i].split()))
    bags = {i: collections.Counter(texts[i].split()) for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            most = op8_ordermin.allowed(bags[b].total(), op8_ordermin.SIMILARITY)
            if bags[b].total() - bags[a].total() > most:
                break
            if bags[b].total() - (bags[a] & bags[b]).total() <= most and op8_ordermin.alike(texts[a], texts[b], op8_ordermin.SIMILARITY):
                x, y = group[a], group[b]
                group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    kept = {i: texts[i] for i in texts if group[i] == i}
    cut = {i: w for i, w in cut_brute(kept, 50).items() if w}
    source = {r.doc_id: r.source for r in known}
    mixed = corpus_pipeline.no_repeats(spark, docs.where(F.col("doc_id").isin(list(kept))), sf)
    rows = {r.doc_id: r for r in mixed.collect()}
    assert {i: r.text.split() for i, r in rows.items()} == cut
    sizes = collections.Counter()
    for i, r in rows.items():
        sizes[source[i]] += len(r.text)
    passes = op1_mix.water_fill(sizes, op1_mix.WEIGHTS, op1_mix.BUDGET * sum(sizes.values()), op1_mix.EPOCHS)
    import hashlib

    want = collections.Counter()
    for i in rows:
        p = passes[source[i]]
        u = int(hashlib.md5(f"{i}:{op1_mix.SEED}".encode()).hexdigest()[:13], 16) / 2**52
        want[i] += int(p) + (u < p - int(p))
    got = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in got) == +want
    code = fast_encoding()
    assert all(r.tokens == code.encode_ordinary(rows[r.doc_id].text) for r in got)


def test_odd_rows_pass_all_stages(spark, odd, nothing, sf):
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in odd.collect()}
    empty = nothing
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
