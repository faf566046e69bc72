"""What the tokenizer's worker remembers is bounded."""

import pyarrow as pa

from penprint.llm import op7_bpe
from penprint.llm.bpe_files import RANKS

from .conftest import passage


def test_few_remembered_words_give_the_same_tokens(monkeypatch):
    texts = [passage(i % 7, 40).split(" ") for i in range(20)]
    words = [[w if k == 0 else " " + w for k, w in enumerate(t)] for t in texts] + [None, []]
    batch = pa.record_batch([pa.array(range(22)), pa.array(words, pa.list_(pa.string()))], ["doc_id", "__words"])
    run = lambda: pa.Table.from_batches(op7_bpe.encoded(iter([batch, batch]), RANKS, "tokens"))
    whole = run().to_pylist()
    for name, few in (("WORDS_AT_ONCE", 60), ("KNOWN_WORDS", 50), ("KNOWN_PIECES", 20), ("WORDS_OUT", 45)):
        monkeypatch.setattr(op7_bpe, name, few)
    assert run().to_pylist() == whole
    known, want = op7_bpe.Pieces(), ["".join(w) if w is not None else None for w in words]
    for _ in range(3):
        got = op7_bpe.readable(op7_bpe.spelled(pa.array([r["tokens"] for r in whole[:22]], pa.list_(pa.int32())), RANKS, known)).to_pylist()
        assert got == want


def test_round_trip_takes_one_worker(spark, sf):
    assert op7_bpe.bpe_round_trip(spark, sf)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
