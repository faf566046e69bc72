import collections
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from penprint.llm import op1_mix, op2_counts, op3_sentences, op4_quality, op5_neighbours, op6_media, op7_bpe, op8_ordermin, op9_suffix, op10_langid
from penprint.llm.common import Words
from penprint.llm.bpe_files import fast_encoding
from penprint.llm.common import Words, chunks

from .conftest import passage


def docs(spark, *texts, **more):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("module", [op1_mix, op3_sentences, op7_bpe, op9_suffix, op10_langid])
def test_query_equals_its_sql(same, module):
    for name, sql in module.SQL.items():
        same(module.QUERIES[name], sql)


def test_words_are_hashed_by_content():
    texts = pa.array(["ab  cd\nab", None, "", " ab", "cd ab é"])
    found = [h for _, some in chunks(texts) for h in [Words(some)]]
    w = found[0]
    assert [w.text(i).stop - w.text(i).start for i in range(5)] == [3, 0, 0, 1, 3]
    assert w.hash[0] == w.hash[2] == w.hash[3] == w.hash[5] and w.hash[1] == w.hash[4] != w.hash[0]
    assert [bytes(w.bytes[a:b]).decode() for a, b in zip(w.first, w.last)] == "ab cd ab ab cd ab é".split()


# 1


@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 1000), min_size=1), st.floats(0.1, 5), st.floats(0.5, 6))
@settings(max_examples=200, deadline=None)
def test_water_fill(sizes, budget, epochs):
    weights = {s: i + 1.0 for i, s in enumerate("abcdef")}
    total = budget * sum(sizes.values())
    passes = op1_mix.water_fill(sizes, weights, total, epochs)
    assert all(0 <= p <= epochs + 1e-9 for p in passes.values())
    used = sum(passes[s] * n for s, n in sizes.items())
    assert used == pytest.approx(min(total, epochs * sum(sizes.values())), abs=1e-6)
    open_ = [s for s in sizes if sizes[s] and passes[s] < epochs - 1e-9]
    assert len({round(passes[s] * sizes[s] / weights[s], 6) for s in open_}) <= 1


def test_mix_of_odd_rows(spark, odd, nothing):
    got = op1_mix.mix_sources(odd, {"src0": 5.0}, budget=2.0)
    assert dict(got.dtypes)["copy"] == "int" and set(odd.columns) == set(got.columns)
    again = op1_mix.mix_sources(odd.repartition(1), {"src0": 5.0}, budget=2.0)
    assert sorted(got.select("doc_id", "copy").collect(), key=repr) == sorted(again.select("doc_id", "copy").collect(), key=repr)
    per = collections.Counter((r.doc_id, r.source, r.text) for r in got.collect())
    assert max(per.values()) <= 8  # 4 passes of a repeated row
    assert op1_mix.mix_sources(nothing).count() == 0


# 2


def test_counts(spark, odd, nothing):
    code = fast_encoding()
    lengths = [len(code.encode_ordinary(r.text)) if r.text else 0 for r in odd.select("text").collect()]
    table = op2_counts.context_table(op2_counts.length_histogram(odd), block=7)
    rows = {r.n_tokens: r for r in table.collect()}
    for n in set(lengths):
        r = rows[n]
        assert (r.docs, r.docs_ge, r.tokens_ge) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.quantile == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for limit in (0, 3, 50, 10**6):
        assert op2_counts.truncated_total(table, limit).first().total == sum(min(x, limit) for x in lengths)
    assert op2_counts.length_quantile(table, 0.5).first().n_tokens == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert op2_counts.context_table(op2_counts.length_histogram(nothing)).count() == 0


# 3


def test_sentence_spans(spark, odd, nothing):
    a, b = "One two. Three four! Five six? ", "Seven eight. "
    d = docs(spark, a + b, b + a + "End.", "Five six? Seven eight.")
    got = {r.doc_id: (r.text, r.removed) for r in op3_sentences.dedup_sentences(d, 3, 0).collect()}
    assert got == {0: (a + b, 0), 1: (b + "End.", 3), 2: ("Five six? Seven eight.", 0)}
    rows = op3_sentences.dedup_sentences(odd)
    assert rows.columns == ["doc_id", "text", "sentences", "removed"]
    out = sorted(((r.doc_id, r.text, r.removed) for r in rows.collect()), key=repr)
    assert len(out) == 16 and [r for r in out if r[0] == 1] == [(1, None, 0)] and [r for r in out if r[0] is None] == [(None, passage(11, 60), 0), (None, None, 0)]
    assert [r[1] for r in out if r[0] == 6] == [""] and [r[1] for r in out if r[0] == 5] == [passage(5, 80)] * 2
    assert [r[2] for r in out if r[0] == 13] == [0]
    assert {r.doc_id: r.removed for r in op3_sentences.dedup_sentences(odd, 3, 0).collect()}[13] == 3
    assert op3_sentences.dedup_sentences(nothing).count() == 0


@given(st.lists(st.lists(st.integers(0, 9), max_size=12), max_size=5), st.integers(1, 4), st.integers(0, 25))
@settings(max_examples=300, deadline=None)
def test_runs_of_sentences(texts, span, least):
    want, at = [], 0
    for words in texts:
        n = len(words)
        for i in range(n):
            found = next((j for j in range(i + span, n + 1) if sum(words[i:j]) >= least), None)
            if sum(words) < least:
                found = n if i == 0 and n >= span else None
            if found is not None:
                want.append((at + i, at + found))
        at += n
    start, end = op3_sentences.ends(np.array(sum(texts, []), np.int64), np.cumsum([0, *map(len, texts)]), span, least)
    assert list(zip(start.tolist(), end.tolist())) == want


def test_short_sentences_are_compared(spark):
    """A long passage of one-word sentences, and a whole text of few words."""
    shouted = " ".join(f"W{i}!!" for i in range(60))
    d = docs(spark, shouted, shouted + " New. End.", "Ay. Bee.", "Ay. Bee.", "Ay. Bee. See.")
    assert {r.doc_id: (r.text, r.removed) for r in op3_sentences.dedup_sentences(d).collect()} == {0: (shouted, 0), 1: ("New. End.", 60), 2: ("Ay. Bee.", 0), 3: ("", 2), 4: ("Ay. Bee. See.", 0)}


# 4


def kneser_ney(sample: list[list[str]]):
    """Brute force: p(w | u, v) from the definitions."""
    tri = collections.Counter()
    for words in sample:
        x = ["<s>", "<s>", *words]
        tri.update(zip(x, x[1:], x[2:]))
    bi = collections.Counter((v, w) for _, v, w in tri)
    uni = collections.Counter(w for _, w in bi)

    def order(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        d = op4_quality.discount(*n)
        return lambda c: d[min(c, 3) - 1]

    d3, d2, d1 = order(tri), order(bi), order(uni)

    def p1(w):
        total = sum(uni.values())
        rest = sum(d1(c) for c in uni.values()) / total
        return (max(uni[w] - d1(uni[w]), 0) if w in uni else 0) / total + rest / (len(uni) + 1)

    def p2(v, w):
        same = {k: c for k, c in bi.items() if k[0] == v}
        total = sum(same.values())
        if not total:
            return p1(w)
        own = same[v, w] - d2(same[v, w]) if (v, w) in same else 0
        return own / total + sum(d2(c) for c in same.values()) / total * p1(w)

    def p3(u, v, w):
        same = {k: c for k, c in tri.items() if k[:2] == (u, v)}
        total = sum(same.values())
        if not total:
            return p2(v, w)
        own = same[u, v, w] - d3(same[u, v, w]) if (u, v, w) in same else 0
        return own / total + sum(d3(c) for c in same.values()) / total * p2(v, w)

    return p3, set(uni)


def test_quality_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(rng.randint(1, 25))) for _ in range(30)] + ["zz aa!", "", None]
    d = docs(spark, *texts)
    labels = spark.createDataFrame([(i, int(i < 20), None if i % 2 else 0) for i in range(33)] + [(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    p3, vocabulary = kneser_ney([t.split() for t in texts[:20]])
    assert sum(p3("aa", "bb", w) for w in vocabulary) + p3("aa", "bb", "new") == pytest.approx(1)
    got = {r.doc_id: r for r in op4_quality.score(d, labels, keep=0.5).collect()}
    for i in range(31):
        x = ["<s>", "<s>", *(texts[i].replace("!", " !").split())]
        lp = [math.log(p3(*x[k : k + 3])) for k in range(len(x) - 2)]
        assert got[i].tokens == len(lp) and got[i].perplexity == pytest.approx(math.exp(-sum(lp) / len(lp)), rel=1e-6)
    known = sorted(got[i].perplexity for i in range(31))
    assert got[0].threshold == known[15] and got[31].perplexity is None and got[32].kept is None


def test_quality_counts_all_trusted_text(spark):
    """The last of 2500 trusted documents counts as much as the first: each has a word of its own."""
    d = docs(spark, *(f"aa bb own{i}" for i in range(2500)))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2500)], "doc_id long, quality int, toxic int")
    assert len({round(r.perplexity, 6) for r in op4_quality.score(d, labels).collect()}) == 1


@pytest.mark.parametrize("slices", [1, 3])
def test_blocks_of_trigrams(slices):
    """Each trigram is in one block, with its text; words that nobody knows are one; a word takes a few bytes, 28 before."""
    rng = np.random.default_rng(4)
    n = np.array([0, 1, 2, 50_000, 0, 150_000])
    w, langs = (op4_quality.mix(x).view(np.int64) for x in (rng.zipf(1.3, n.sum()) % 5000 + 99, np.array([3, 3, 9, 9, 3, 3])))
    t = np.arange(6) * 7
    salted = op4_quality.mix(w.view(np.uint64) ^ np.repeat(langs, n).view(np.uint64))
    start = op4_quality.mix(np.uint64(op4_quality.START) ^ langs.view(np.uint64)).tolist()
    want, at = collections.Counter(), 0
    for k, size in enumerate(n):
        x = [start[k]] * 2 + salted[at : at + size].tolist()
        want.update((t[k], langs[k], *y) for y in zip(x, x[1:], x[2:]))
        at += size

    def read(known):
        got, size = collections.Counter(), 0
        for b in (b for at in range(slices) for b in op4_quality.sent([(t, langs, n, w)], 6, slices, at, known)):
            part, _, lang, *data = (c[0].as_py() for c in b.columns)
            names, (v, *_) = np.frombuffer(data[0], np.uint64), (op4_quality.unpack(x) for x in data[2:3])
            x = [names[op4_quality.unpack(x)].tolist() for x in data[1:4]]
            assert known or (op4_quality.shard_of(names[v], 6) == part).all()
            got.update(zip(np.repeat(np.frombuffer(data[4], np.int64), op4_quality.unpack(data[5])).tolist(), [lang] * len(v), *x))
            size += sum(map(len, data))
        return got, size

    got, size = read(None)
    assert got == want and size < 8 * n.sum()
    none, _ = read(bytes(1 << op4_quality.KNOWN_BITS - 3))
    assert none == _merged(want, set(start))


def _merged(want, kept):
    out = collections.Counter()
    for (t, lang, *words), c in want.items():
        out[(t, lang, *(x if x in kept else op4_quality.UNKNOWN for x in words))] += c
    return out


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    rows = op4_quality.score(odd, labels).collect()
    assert len(rows) == odd.count() and any(r.perplexity is not None for r in rows)
    assert op4_quality.score(nothing, labels).count() == 0
    assert all(r.perplexity is None for r in op4_quality.score(odd, labels.where("false")).collect())


# 5


@pytest.mark.parametrize("rows_a_shard,every", [(100, 1), (8192, 20), (7, 20)])  # several parts, production, parts in pieces
def test_neighbours_recall(spark, sf, rows_a_shard, every):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, 1)[:, :10]
    got = collections.defaultdict(list)
    for r in op5_neighbours.neighbours(e, shard_rows=rows_a_shard, every=every).collect():
        got[r.vec_id].append((r["rank"], r.neighbour, r.distance))
    assert set(got) == {i for i in ids if i % every == 0}
    ids, want, all_ids = ids[ids % every == 0], want[ids % every == 0], ids
    assert np.mean([len({n for _, n, _ in got[i]} & set(all_ids[w])) / 10 for i, w in zip(ids, want)]) >= 0.9
    place = {v: k for k, v in enumerate(all_ids)}
    for i, near in got.items():
        assert [k for k, _, _ in sorted(near)] == list(range(1, len(near) + 1))
        assert all(dist == pytest.approx(math.sqrt(d[place[i], place[n]]), abs=1e-6) for _, n, dist in near)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [0.0, 1.0], 1), (2, [0.0, 1.0], 2), (2, [0.0, 1.0], 2), (3, None, 3), (4, [1.0], 4), (5, [nan, 1.0], 5), (6, [1.0, None], 6), (None, [1.0, 1.0], 7), (8, [0.0, 0.9], 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = {(r.vec_id, r["rank"]): r.neighbour for r in op5_neighbours.neighbours(v, k=2).collect()}
    assert got[1, 1] == 2 and got[2, 1] == 1 and {k for k, _ in got} <= {1, 2, 8}
    assert op5_neighbours.neighbours(v.where("false")).count() == 0


@pytest.mark.parametrize("at_once,rounds", [(1024, 8), (16, 8), (16, 1)])  # exact at once, wider rounds first, several exact passes
def test_sparse_rows_among_tight_groups_are_answered(spark, monkeypatch, at_once, rounds):
    monkeypatch.setattr(op5_neighbours, "EXACT_ROWS", at_once)
    monkeypatch.setattr(op5_neighbours, "ROUNDS", rounds)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((50, 32))
    x = np.concatenate([centres[np.arange(1365) % 50] + 0.01 * rng.standard_normal((1365, 32)), rng.standard_normal((135, 32))])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, 1)[:, :10]
    got = collections.defaultdict(set)
    for r in op5_neighbours.neighbours(v).collect():
        got[r.vec_id].add(r.neighbour)
    assert all(len(got[i]) == 10 for i in range(1500))
    recall = [len(got[i] & set(want[i])) / 10 for i in range(1500)]
    assert np.mean(recall[1365:]) >= 0.9 and np.mean(recall) >= 0.9


# 6


@given(st.integers(1, 40), st.integers(1, 23), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(height, width, seed):
    grey = np.random.default_rng(seed).integers(0, 256, (height, width)).astype(np.uint8)
    assert (op6_media.decode_png(op6_media.encode_png(grey)) == grey).all()


def png(head, raw, extra=b"", idat=None):
    chunk = lambda k, c: struct.pack(">I", len(c)) + k + c + struct.pack(">I", zlib.crc32(k + c))
    return op6_media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + extra + chunk(b"IDAT", zlib.compress(raw) if idat is None else idat) + chunk(b"IEND", b"")


def test_png_kinds():
    decode = op6_media.decode_png
    assert decode(png((2, 1, 8, 2, 0, 0, 0), b"\0" + bytes([255, 0, 0, 0, 255, 0]))).round(3).tolist() == [[76.245, 149.685]]
    assert decode(png((8, 1, 1, 0, 0, 0, 0), b"\0\xa0")).tolist() == [[255, 0, 255, 0, 0, 0, 0, 0]]
    palette = struct.pack(">I", 6) + b"PLTE" + bytes([0, 0, 0, 9, 9, 9])
    palette += struct.pack(">I", zlib.crc32(palette[4:]))
    assert decode(png((2, 1, 4, 3, 0, 0, 0), b"\0\x10", palette)).round(6).tolist() == [[9, 0]]
    assert decode(png((1, 1, 16, 0, 0, 0, 0), b"\0\xff\xff")).round(6).tolist() == [[255]]
    assert decode(png((1, 2, 8, 6, 0, 0, 0), b"\x01\x01\x01\x01\x09\x02\x01\x01\x01\x09")).round(6).tolist() == [[1], [2]]


def plain_png(data):
    """Brute force: grey values of a PNG from the published definitions, byte by byte."""
    at, packed, palette = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        content = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", content[:10])
        packed += content if kind == b"IDAT" else b""
        palette = content if kind == b"PLTE" else palette
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride, step = -(-width * depth * channels // 8), max(1, depth * channels // 8)
    raw, above, out = zlib.decompress(packed), [0] * stride, []
    for y in range(height):
        kind, *row = raw[y * (stride + 1) : (y + 1) * (stride + 1)]
        for i in range(stride):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[i] = (row[i] + [0, a, b, (a + b) // 2, paeth][kind]) % 256
        above = row
        bits = "".join(f"{x:08b}" for x in row)
        v = [int(bits[k * depth : (k + 1) * depth], 2) for k in range(width * channels)]
        px = [v[k * channels : (k + 1) * channels] for k in range(width)]
        top = 2**depth - 1
        mean = lambda r, g, b: 0.299 * r + 0.587 * g + 0.114 * b
        if colour == 3:
            out.append([mean(*palette[3 * q[0] : 3 * q[0] + 3]) for q in px])
        else:
            out.append([255 / top * (mean(*q[:3]) if colour in (2, 6) else q[0]) for q in px])
    return out


def plain_hash(grey):
    """Brute force: area means, cosine sums and their median from the definitions."""
    h, w = len(grey), len(grey[0])

    def share(size, k, i):  # how much of cell k of 32 lies in pixel i
        return max(0.0, min((k + 1) * size / 32, i + 1) - max(k * size / 32, i)) * 32 / size

    rows = [[sum(share(h, k, y) * grey[y][x] for y in range(h) if share(h, k, y)) for x in range(w)] for k in range(32)]
    small = [[sum(share(w, k, x) * r[x] for x in range(w) if share(w, k, x)) for k in range(32)] for r in rows]
    cos = [[math.cos(math.pi * (i + 0.5) * f / 32) for i in range(32)] for f in range(8)]
    half = [[sum(cos[f][i] * small[i][j] for i in range(32)) for j in range(32)] for f in range(8)]
    block = [round(sum(cos[g][j] * half[f][j] for j in range(32)), 6) for f in range(8) for g in range(8)]
    middle = sorted(block[1:])[31]
    return int("".join("0" if k == 0 else str(int(b > middle)) for k, b in enumerate(block)), 2).to_bytes(8, "big")


@given(st.data())
@settings(max_examples=80, deadline=None)
def test_png_against_brute_force(data):
    files = []
    for _ in range(data.draw(st.integers(1, 4))):  # several together
        colour, depth = data.draw(st.sampled_from([(c, d) for c, ds in op6_media.DEPTHS.items() for d in ds]))
        width, height = data.draw(st.integers(1, 9)), data.draw(st.integers(1, 7))
        stride = -(-width * depth * op6_media.CHANNELS[colour] // 8)
        raw = b"".join(bytes([data.draw(st.integers(0, 4))]) + data.draw(st.binary(min_size=stride, max_size=stride)) for _ in range(height))
        palette = data.draw(st.binary(min_size=768, max_size=768))
        files.append(png((width, height, depth, colour, 0, 0, 0), raw, struct.pack(">I", 768) + b"PLTE" + palette + struct.pack(">I", zlib.crc32(b"PLTE" + palette)) if colour == 3 else b""))
    for f, (w, h, found, problem) in zip(files, op6_media.hashed(files, 100)):
        assert np.allclose(op6_media.decode_png(f), plain_png(f)) and problem is None and len(found) == 8


def test_media_query_against_brute_force(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    images = {r.page_id: r.png for r in op6_media.page_images(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    rows = op6_media.op6_media(spark, sf).collect()
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows[:12]:
        raw = list(pages[r.page_id].encode())
        raw += [0] * (-len(raw) % 64 if raw else 64)
        grey = [raw[i : i + 64] for i in range(0, len(raw), 64)]
        assert plain_png(images[r.page_id]) == grey and (r.width, r.height, r.problem) == (64, len(grey), None)
        assert bytes(r.hash) == plain_hash(grey)


@pytest.mark.parametrize("size", [(2**31 - 1, 2**31 - 1, 16, 6), (2**32 - 1, 2**32 - 1, 8, 0), (1 << 13, 1 << 12, 1, 0)])
def test_sizes_that_are_too_large(size):
    assert op6_media.hashed([png((*size, 0, 0, 0), b"\0\0")], op6_media.MOST_PIXELS) == [(None, None, None, "too large")]


def test_media_problems(spark):
    good = op6_media.encode_png(np.arange(100, dtype=np.uint8).reshape(10, 10))
    bad = bytearray(good)
    bad[40] ^= 1
    rows = [good, good, None, b"", good[:-9], bytes(bad), png((1, 1, 8, 0, 0, 0, 1), b"\0\0"), png((1, 1, 8, 0, 0, 0, 0), b"\x07\0"), png((3, 1, 8, 0, 0, 0, 0), b"\0"), png((1, 1, 8, 0, 0, 0, 0), b"", idat=b"zz"), png((0, 1, 8, 0, 0, 0, 0), b"")]
    d = spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "page_id long, png binary, hash string")
    got = [r.problem for r in op6_media.hash_media(d).orderBy("page_id").collect()]
    assert got == [None, None, "missing", "signature", "truncated", "checksum", "interlaced", "filter", "size", "deflate", "header"]
    assert op6_media.hash_media(d.where("false")).count() == 0


def test_hash_survives_scaling():
    image = np.kron(np.random.default_rng(1).integers(0, 256, (8, 12)), np.ones((8, 8)))
    big = np.kron(image, np.ones((2, 2)))
    bits = lambda b: np.unpackbits(np.frombuffer(b, np.uint8))
    assert (bits(op6_media.cosine_hash(image)) == bits(op6_media.cosine_hash(big))).all()
    assert (bits(op6_media.cosine_hash(image)) != bits(op6_media.cosine_hash(image[::-1, ::-1]))).sum() > 10


# 7


def test_bpe_equals_the_library(spark, odd, nothing):
    code = fast_encoding()
    extra = odd.select("doc_id", "text").unionByName(docs(spark, "a" * 3000, "  \n\n x　y \x85 z", "don't WON'T 12345 ½ ñ́ 漢字 \x1c\x1f!").select("doc_id", "text"))
    for d in (odd, extra):
        got = op7_bpe.encode(d)
        assert got.columns[-1] == "tokens"
        for r in got.collect():
            assert r.tokens == (None if r.text is None else code.encode_ordinary(r.text))
    back = op7_bpe.decode(op7_bpe.encode(extra.withColumnRenamed("text", "text")).withColumnRenamed("text", "was"))
    assert all(r.text == r.was for r in back.collect())
    assert op7_bpe.encode(nothing).count() == 0
    t = spark.createDataFrame([(1, None), (2, []), (3, [60000]), (4, [None, 5])], "doc_id long, tokens array<int>")
    assert {r.doc_id: r.text for r in op7_bpe.decode(t).collect()} == {1: None, 2: "", 3: None, 4: None}


def test_bpe_query_round_trip(spark, sf):
    rows = op7_bpe.op7_bpe(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    code = fast_encoding()
    assert {r.doc_id: r.tokens for r in rows} == {i: code.encode_ordinary(t) for i, t in texts.items()} and all(r.same for r in rows)


@given(st.binary(max_size=60))
@settings(max_examples=100, deadline=None)
def test_heap_and_recursion_agree(word):
    merger = op7_bpe.latest("merger", op7_bpe.RANKS, lambda: op7_bpe.Merger(op7_bpe.RANKS))
    want = fast_encoding()._core_bpe.encode_single_piece(word) if word else []
    assert merger._by_heap(word) == want and (not word or merger._contract([word]) == [want])


def test_very_long_words(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    merger, single = op7_bpe.Merger(op7_bpe.RANKS), fast_encoding()._core_bpe.encode_single_piece
    rng = random.Random(7)
    words = [b"a" * 100_000, *(bytes(rng.choice(b"abcdethe") for _ in range(n)) for n in (40_000, 1024, 1023)), *(bytes(rng.choice(b"abcdethe") for _ in range(900)) for _ in range(60))]
    assert merger.words(words) == [single(w) for w in words]
    assert not list(tmp_path.iterdir())  # nothing spilled

@pytest.mark.parametrize("collide", [False, True])
def test_equal_pieces_are_put_together_once(monkeypatch, collide):
    """Every list decodes as the library does, even where all pieces have one hash; unknown ids give null."""
    if collide:
        monkeypatch.setattr(op7_bpe, "polynomial", lambda h, start, end: np.zeros(len(start), np.uint64))
    code, rng = fast_encoding(), random.Random(7)
    texts = [" ".join(rng.choice(["the", "a", "ünï", "xyzzyq", "\n", "12", "😀"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", " ", "  a", "no"]
    lists = [code.encode_ordinary(t) for t in texts] + [[10**7, 5], [5, -1], [2**31 - 1]]
    known = op7_bpe.Pieces()
    for at_once in (7, 500_000):
        monkeypatch.setattr(op7_bpe, "TOKENS_AT_ONCE", at_once)
        got = op7_bpe.spelled(pa.array([*lists, None], pa.list_(pa.int32())), op7_bpe.RANKS, known).to_pylist()
        assert got[: len(texts)] == [t.encode() for t in texts] and got[len(texts) :] == [None] * 4


# 8


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 12))
@settings(max_examples=500, deadline=None)
def test_banded_distance(a, b, most):
    assert op8_ordermin.banded_distance(a, b, most) == min(edit_distance(a, b), most + 1)


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30), st.integers(0, 12))
@settings(max_examples=500, deadline=None)
def test_bounds(a, b, most):
    x, y, d = np.array(a, np.int64), np.array(b, np.int64), edit_distance(a, b)
    least, at_most = op8_ordermin.bounds(x, y, most)
    assert least <= d <= at_most and op8_ordermin.within(x, y, most) == (d <= most)
    laid, extra = op8_ordermin.against(x + 1, y + 1)
    assert (laid != x + 1).sum() + extra >= d and (laid > 0).sum() + extra == len(b)


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=150), st.lists(st.integers(0, 2), max_size=150)), max_size=4), st.integers(0, 150))
@settings(max_examples=150, deadline=None)
def test_many_distances(pairs, most):
    lists = [np.array(x, np.int32) for p in pairs for x in p]
    n = np.array([len(x) for x in lists], np.int64)
    starts = np.cumsum(n) - n
    got = op8_ordermin.many_distances(np.concatenate([np.zeros(0, np.int32), *lists]), starts[::2], n[::2], starts[1::2], n[1::2], most)
    assert [min(x, most + 1) for x in got.tolist()] == [min(edit_distance(a, b), most + 1) for a, b in pairs]


@pytest.mark.parametrize("wide,step", [(1024, 1 << 19), (45, 1 << 8)])  # some pairs too wide, small steps
def test_links_of_a_cluster_are_not_aligned_pair_by_pair(monkeypatch, wide, step):
    """Copies far from each other, which no bound decides: no pair of short texts goes through the slow alignment."""
    monkeypatch.setattr(op8_ordermin, "WIDE", wide)
    monkeypatch.setattr(op8_ordermin, "STEP", step)
    slow = []
    monkeypatch.setattr(op8_ordermin, "banded_distance", lambda a, b, most, f=op8_ordermin.banded_distance: slow.append(max(len(a), len(b))) or f(a, b, most))
    rng = random.Random(4)
    base, lists = [rng.randrange(1, 30) for _ in range(44)], []
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = [rng.randrange(1, 30) for _ in range(rng.randint(0, 2))]
        lists.append(copy)
    near = np.array([[a is not b and edit_distance(a, b) <= op8_ordermin.allowed(max(len(a), len(b)), 0.8) for b in lists] for a in lists])
    arrays = [np.array([hash((x, 5)) for x in a], np.int64) for a in lists]
    assert op8_ordermin.linked(np.zeros(40, int), arrays, 0.8).tolist() == near.sum(1).tolist()
    side = np.array([1] * 15 + [2] * 25)
    assert op8_ordermin.linked(side, arrays, 0.8).tolist() == [*near[:15, 15:].sum(1), *near[15:, :15].sum(1)]
    assert near.any() and not near.all() and (wide == 45 or not slow)


def ascii_words(text):
    return [w for w in re.split(r"[ \t\n\r\f\x0b]+", text) if w]


def near_pairs(texts: dict, similarity=0.8):
    ids = sorted(texts)
    out = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = ascii_words(texts[a]), ascii_words(texts[b])
            if texts[a] == texts[b] or (x and y and edit_distance(x, y) <= op8_ordermin.allowed(max(len(x), len(y)), similarity)):
                out.append((a, b))
    return out


def joined(ids, pairs):
    group = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return group


def test_near_groups(spark):
    rng = random.Random(8)
    texts = {}
    for k in range(6):
        base = passage(k, 60).split()
        texts[k * 10] = " ".join(base)
        for c in range(1, 4):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            texts[k * 10 + c] = " ".join(copy)
    texts[5000] = " ".join(reversed(texts[0].split()))  # the same words, another order
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.group for r in op8_ordermin.near_groups(d).collect()}
    assert got == joined(texts, near_pairs(texts)) and got[5000] == 5000


@pytest.mark.parametrize("block,names", [(256, 1 << 20), (3, 0)])  # one task a group, many; names sent, shuffled
def test_links_and_groups(spark, monkeypatch, block, names):
    """Production parameters; each text's links are those that aligning it with every other finds."""
    monkeypatch.setattr(op8_ordermin, "BLOCK", block)
    monkeypatch.setattr(op8_ordermin, "SENT_NAMES", names)
    rng = random.Random(9)
    texts = {}
    for k in range(4):
        for c in range(9):
            copy = passage(k, 100).split()
            for _ in range(rng.randint(0, 12)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts[k * 10 + c] = " ".join(copy)
    texts[99] = texts[0]
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = near_pairs(texts)
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(texts[b])
        near[b].add(texts[a])
    links = {i: len(near[i] - {texts[i]}) for i in texts}
    got = {r.doc_id: r for r in op8_ordermin.near_groups(d, links=True).collect()}
    assert {i: r.links for i, r in got.items()} == {i: links[i] for i in texts}
    assert {i: r.group for i, r in got.items()} == joined(texts, pairs)


def test_chains_and_hot_buckets(spark):
    base = passage(1, 40).split()
    texts, now = {}, list(base)
    for i in range(40):  # each is near the one before, the last is far from the first
        texts[i] = " ".join(now)
        now[i] = f"new{i}"
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.group for r in op8_ordermin.near_groups(d).collect()} == {0}


def test_short_texts_at_the_threshold(spark):
    """Pairs of 5 to 40 words with as many changed words as are allowed: nearly all are found."""
    rng = random.Random(3)
    rows, k = [], 0
    for n in (5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 40):
        for _ in range(20):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            other = list(words)
            for i in rng.sample(range(n), op8_ordermin.allowed(n, 0.8)):
                other[i] = f"v{rng.randrange(10**9)}"
            rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
            k += 2
    group = {r.doc_id: r.group for r in op8_ordermin.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([group[i] == group[i + 1] for i in range(0, k, 2)]) >= 0.95


def test_words_end_at_ascii_white_space_alone(spark):
    words = [f"w{i}" for i in range(40)]
    texts = {1: " ".join(words), 2: "\u00a0".join(words), 3: "\u3000".join(words), 4: "\n".join(words), 5: " ".join(words[:20]) + "\u00a0" + " ".join(words[20:])}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.group for r in op8_ordermin.near_groups(d).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1} == joined(texts, near_pairs(texts))


def test_near_groups_of_odd_rows(spark, odd, nothing):
    rows = op8_ordermin.near_groups(odd, links=True).collect()
    group = {r.doc_id: r.group for r in rows}
    assert len(rows) == 16 and group[6] == 5 and group[1] == 1 and group[14] == 14 and group[2] == 2 and group[3] == 3
    assert {r.doc_id for r in rows if not r.kept} == {6} and {r.links for r in rows} == {0}
    assert [(r.group, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2
    again = odd.where("doc_id is not null or text is null").unionByName(odd.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    assert [(r.group, r.kept) for r in op8_ordermin.near_groups(again).collect() if r.doc_id is None] in ([(7, False), (None, True)], [(None, True), (7, False)])
    assert op8_ordermin.near_groups(nothing, links=True).count() == 0


# 9


def cut_brute(texts: dict, length: int) -> dict:
    seen, out = set(), {}
    for i in sorted(texts):
        w = (texts[i] or "").split()
        gone = set()
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if key in seen:
                gone |= set(range(k, k + length))
            seen.add(key)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


@pytest.mark.parametrize("length,letters,seed", [(4, "ab", 1), (5, "abc", 2), (7, "a", 3), (12, "ab", 4), (20, "abcdef", 5)])
def test_suffix_array_against_brute_force(spark, monkeypatch, length, letters, seed):
    monkeypatch.setattr(op9_suffix, "ROWS", 150)  # many ranges
    rng = random.Random(seed)
    texts = {i: " ".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for i in range(12)}
    texts |= {100 + i: " ".join(texts[i].split()[3:]) for i in range(6)} | {200: None, 201: texts[3]}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.text or "").split() for r in op9_suffix.dedup_substrings(d, length, 3).collect()}
    assert got == cut_brute(texts, length)


def test_suffixes_of_odd_rows(spark, odd, nothing):
    rows = op9_suffix.dedup_substrings(odd, carry=["row"]).collect()
    assert len(rows) == 16 and rows[0].row is not None
    of = {r.doc_id: r for r in rows}
    shared = passage(99, 60)
    assert shared.split()[5] in of[7].text and of[8].removed >= 60 and of[6].removed == of[6].words and of[5].removed == 0
    assert of[1].text is None and of[2].text == "" and of[3].text == " \n\t " and of[9].removed == 30000 - 1 and of[10].removed == 0
    assert op9_suffix.dedup_substrings(nothing).count() == 0
    with pytest.raises(ValueError):
        op9_suffix.dedup_substrings(odd, 3)


@pytest.mark.parametrize("rows", [400_000, 5])  # a block a part, many
def test_fingerprints_travel_in_blocks(spark, monkeypatch, rows):
    """Runs of equal fingerprints, of one that is everywhere too, and no row of Spark's for each."""
    monkeypatch.setattr(op9_suffix, "ROWS", rows)
    rng = random.Random(8)
    shared = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(12)) for _ in range(4)]
    texts = {i: " ".join([passage(i, 9), shared[0], passage(i + 99, 9), shared[1 + i % 9 % 3] if i % 9 < 5 else passage(i + 500, 9)]) for i in range(40)}
    d = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "doc_id long, row long, text string").repartition(2)
    chosen = {}
    for i, t in texts.items():
        words = Words(pa.array([t], pa.large_string()))
        g, at, _, _ = op9_suffix.winnow(words, 10, 5)
        chosen |= {(i, int(x)): int(g[x]) for x in at}
    times = collections.Counter(chosen.values())
    blocks = op9_suffix.fingerprints(d, 10, 5, 3)
    got = op9_suffix.repeated(blocks, 3).collect()
    assert sorted((r.doc_id, r.at) for r in got) == sorted(k for k, fp in chosen.items() if times[fp] > 1)
    assert max(times.values()) >= 40 and 1 in times.values()
    assert rows == 5 or blocks.count() <= 2 * 3


# 10


def test_languages(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    half = F.col("doc_id") % 2 == 0
    got = op10_langid.identify(d.where(~half), op10_langid.profiles(d.where(half))).where("grams >= 100")
    right, n = got.select(F.avg((F.col("lang") == F.col("predicted")).cast("int")), F.count(F.lit(1))).first()
    assert n > 50 and right > 0.95
    alien = docs(spark, "Съешь ещё этих мягких французских булок, да выпей чаю", "12 34 !!", None)
    assert [r.accepted for r in op10_langid.identify(alien, op10_langid.profiles(d)).orderBy("doc_id").collect()] == [False] * 3


def test_languages_of_odd_rows(spark, odd, nothing):
    known = op10_langid.profiles(odd)
    assert set(known) == {"en", "de"}
    rows = op10_langid.identify(odd.withColumn("grams", F.lit("x")), known).collect()
    assert len(rows) == odd.count() and all(r.predicted == "und" for r in rows if not (r.text or "").strip())
    assert op10_langid.identify(nothing, known).count() == 0 and op10_langid.profiles(nothing) == {}
    assert {r.predicted for r in op10_langid.identify(odd, {}).collect()} == {"und"}
