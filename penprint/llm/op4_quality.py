"""Operator 4: quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

All trusted text counts. Its trigrams go to shards by the hash of their middle word, which every n-gram but the unigrams shares, so a
shard counts its trigrams, bigrams and contexts alone; unigrams are summed over the shards and sent to those that hold the word. Scoring
deals the documents' trigrams to the same shards; where a bigram is unknown and the shard doesn't hold the word, it goes on to the
unigrams by a join. Words travel as places in their block's list of hashes, not as hashes, and words that no trusted text has travel as
one. Scoring runs in SLICES passes over the documents, each for a share of the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, chunks, mix, read, release

#: The share of a language's documents that stays.
KEEP = 0.9

#: Passes over the documents, each of which shuffles its share of their trigrams; characters of text to a shard, and the least number of
#: shards; words that a task gathers before it sends blocks of them.
SLICES = 3
SHARD_CHARS = 1 << 25
LEAST_SHARDS = 6 * SLICES
GATHER = 1 << 22

#: Hashes of doc_id, and bits of known words' hashes, that are broadcast. Both only spare the shuffles; no result depends on them.
ID_HASHES = 1 << 20
KNOWN_BITS = 26

#: Hash that stands for what is before a text; and hash, after mixing, of words that no trusted text has.
START = 1
UNKNOWN = 0


def tokens_text(text):
    """Lower case, with white space around everything that is neither letter nor digit."""
    return F.regexp_replace(F.lower(text), r"([^\p{L}\p{N}\s])", " $1 ")


#: The words of tokens_text, found in the lower-case text.
TOKEN_RE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def lang_hash(langs):
    """int64 of each language name of an Arrow array; null and "" are alike."""
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x or "") for x in langs.to_pylist()], np.uint64).view(np.int64)


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, text) of every document labelled good and not toxic."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    few = F.pmod(F.xxhash64("doc_id"), F.lit(ID_HASHES))  # at most so many rows are broadcast; they spare most other texts the shuffle
    every = every.withColumn("few", few).join(F.broadcast(good.select(few.alias("few")).distinct()), "few", "left_semi")
    return every.join(good, "doc_id", "left_semi").select("lang", "text")


def pack(x) -> bytes:
    """An array of whole numbers from 0 on, by planes of bytes, as many as the greatest needs, compressed."""
    import numpy as np
    import pyarrow as pa

    x = np.ascontiguousarray(x).astype(np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(x), width], np.int64).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes):
    import numpy as np
    import pyarrow as pa

    n, width = np.frombuffer(data[:16], np.int64).tolist()
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[16:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.int64)


BLOCK = "part int, kind int, lang long, a binary, b binary, c binary, d binary, e binary, f binary"
MODEL, ONES, TOKENS = range(3)


def blocks(rows):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["part", "kind", "lang", *"abcdef"])


def shard_of(v, shards: int):
    """The shard of each middle word, in the order of its hash as an unsigned number."""
    import numpy as np

    return ((v.view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def dealt(texts: DataFrame, shards: int, slices: int = 1, at: int = 0, known=None) -> DataFrame:
    """BLOCKs of the trigrams of the texts (t, lang, text) in every slices-th shard from `at` on.

    a: hashes of the block's words, those in the middle first; b, c, d: places there of each trigram's words; e: t of the texts; f: how
    many trigrams are of each. known: known_words' broadcast.
    """
    gather = GATHER

    def send(batches: Iterator) -> Iterator:
        held, size = [], 0
        for batch in batches:
            names, langs = batch.column(0).to_numpy(), lang_hash(batch.column(1))
            for first, some in chunks(batch.column(2)):
                words, here = Words(some), slice(first, first + len(some))
                held.append((names[here], langs[here], words.offsets[1:] - words.offsets[:-1], words.hash))
                size += len(words.hash)
                if size >= gather:
                    yield from sent(held, shards, slices, at, known and known.value)
                    held, size = [], 0
        if size:
            yield from sent(held, shards, slices, at, known and known.value)
        del held
        release()

    return texts.mapInArrow(send, BLOCK)


def sent(held, shards: int, slices: int, at: int, known: bytes | None = None) -> Iterator:
    """The blocks of some texts: (t, language, number of words, hashes of words), each a list of arrays."""
    import numpy as np
    import pyarrow as pa

    t, langs, n, w = (np.concatenate(x) for x in zip(*held))
    names, lang = np.unique(langs, return_inverse=True)
    salted = mix(w.view(np.uint64) ^ np.repeat(langs, n).view(np.uint64))
    coded = pa.array(np.concatenate([mix(np.uint64(START) ^ names.view(np.uint64)), salted])).dictionary_encode()
    words, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    start, w = code[: len(names)], code[len(names) :]
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    ends = np.cumsum(n)
    first = (ends - n)[n > 0]
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    v[first] = u[first] = start[lang[n > 0]]
    u[first[n[n > 0] > 1] + 1] = start[lang[n > 1]]

    none = len(names) * shards  # the group of words that other passes have in the middle
    tongue, part = np.zeros(len(words), np.int64), shard_of(words, shards)
    tongue[w], tongue[start] = lang[owner], np.arange(len(names))
    group = np.where(part % slices == at, tongue * shards + part, none).astype(np.min_scalar_type(none))[v]
    order = np.argsort(group, kind="stable")[: np.count_nonzero(group < none)]

    alike = np.arange(len(words))
    if known is not None:
        bits, place = np.frombuffer(known, np.uint8), words >> np.uint64(64 - KNOWN_BITS)
        held_by_none = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 0
        held_by_none[start] = False
        alike[held_by_none] = len(words)
    words = np.append(words, np.uint64(UNKNOWN))
    counts = np.bincount(alike, np.bincount(code, minlength=len(alike)), len(words))
    often = np.argsort(-counts, kind="stable")  # frequent words get small places
    rank = np.empty(len(words), np.int32)
    rank[often] = np.arange(len(words), dtype=np.int32)
    words, rank = words[often], rank[alike]
    place, middle, near = np.empty(len(words), np.int32), np.zeros(len(words), bool), np.zeros(len(words), bool)
    for i in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
        x, y, z = rank[u[i]], rank[v[i]], rank[w[i]]
        middle[:] = near[:] = False
        middle[y] = near[x] = near[z] = True
        own = np.concatenate([np.flatnonzero(middle), np.flatnonzero(near & ~middle)])
        place[own] = np.arange(len(own), dtype=np.int32)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(owner[i])) + 1])
        g = int(group[i[0]])
        yield blocks([(g % shards, TOKENS, int(names[g // shards]), words[own].tobytes(), pack(place[x]), pack(place[y]), pack(place[z]), t[owner[i][edge]].tobytes(), pack(np.diff(np.append(edge, len(i)))))])


def known_words(ones: DataFrame):
    """A broadcast of one bit for each first KNOWN_BITS bits of a hash: whether a word of the model has them."""
    bits = F.shiftrightunsigned("w", 64 - KNOWN_BITS)
    rows = ones.groupBy(F.shiftright(bits, 15).alias("at")).agg(F.bitmap_construct_agg(bits.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = bytearray(1 << KNOWN_BITS - 3)
    for r in rows:
        out[r["at"] << 12 : (r["at"] + 1) << 12] = r["bits"]
    return ones.sparkSession.sparkContext.broadcast(bytes(out))


def places(known, words):
    """Where each hash is among the sorted known ones; -1 where it isn't."""
    import numpy as np

    if not len(known):
        return np.full(len(words), -1)
    order = np.argsort(words)  # searching in order stays in the cache
    at = np.searchsorted(known, words[order])
    at[at == len(known)] = 0
    out = np.empty(len(words), np.int64)
    out[order] = np.where(known[at] == words[order], at, -1)
    return out


COUNTED = "part int, lang long, words binary, uv binary, w binary, c binary, ends binary, often binary, n array<long>"


def counted(sample: DataFrame, shards: int) -> DataFrame:
    """COUNTED of each shard and language, whose trigrams are sorted by v, u and w.

    words: steps of their sorted hashes; uv: steps of v times the number of words plus u; w; c: how often each occurs; ends and often: each last
    word and how many words are before it; n: how many trigrams and how many bigrams occur 1, 2, 3 and 4 times, bigrams after how many words.
    """

    def count(batches: Iterator) -> Iterator:
        part, held = None, {}
        for batch in batches:
            for p, _, lang, *data in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    yield from tables(part, held)
                    part, held = p, {}
                held.setdefault(lang, []).append(data)
        yield from tables(part, held)
        release()

    def tables(part, held) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for lang in list(held):
            data = held.pop(lang)
            names = [np.frombuffer(x[0], np.uint64) for x in data]
            words = np.unique(np.concatenate(names))
            size = len(words)
            uv, w = [], []
            for own, x in zip(names, data):
                own = np.searchsorted(words, own)
                uv.append(own[unpack(x[2])] * size + own[unpack(x[1])])
                w.append(own[unpack(x[3])])
            del data
            pairs, at = np.unique(np.concatenate(uv), return_inverse=True)
            del uv
            three, c = np.unique(at * size + np.concatenate(w), return_counts=True)
            del at
            uv, w = pairs[three // size], three % size
            two, after = np.unique(uv // size * size + w, return_counts=True)
            ends, often = np.unique(two % size, return_counts=True)
            n = [int(np.count_nonzero(x == k)) for x in (c, after) for k in (1, 2, 3, 4)]
            row = (part, lang, pack(np.diff(words, prepend=np.uint64(0))), pack(np.diff(uv, prepend=0)), pack(w), pack(c), pack(ends), pack(often), n)
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["part", "lang", "words", "uv", "w", "c", "ends", "often", "n"])

    texts = sample.select(F.lit(0).cast("long").alias("t"), "lang", tokens_text(F.col("text")).alias("text"))
    return dealt(texts, shards).repartitionById(shards, F.col("part")).sortWithinPartitions("part").mapInArrow(count, COUNTED)


def unigrams(counts: DataFrame) -> DataFrame:
    """(lang, w, part, c): after how many words each word stands in each shard."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, lang, words, ends, often in zip(*(c.to_pylist() for c in batch.columns)):
                w, c = np.cumsum(unpack(words))[unpack(ends)], unpack(often)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), lang)), pa.array(w), pa.array(np.full(len(w), part, np.int32)), pa.array(c)], ["lang", "w", "part", "c"])

    return counts.select("part", "lang", "words", "ends", "often").mapInArrow(run, "lang long, w long, part int, c long")


def discounts(counts: DataFrame, c: str) -> dict[int, tuple[float, float, float]]:
    """D1, D2 and D3+ of each language from how many n-grams occur 1, 2, 3 and 4 times; a count of 0 gives D = its n - 0.5."""
    kinds = [F.sum((F.col(c) == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    return {r["lang"]: discount(r["n1"], r["n2"], r["n3"], r["n4"]) for r in counts.groupBy("lang").agg(*kinds).collect()}


def discount(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d1 = 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5
    return tuple(min(max(d, 0.01), k) for d, k in ((d1, 1.0), (d2, 2.0), (d3, 3.0)))


def train(sample: DataFrame, shards: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, dict[int, float], dict[int, tuple]]:
    """The model: counts by shard; (lang, w, p, parts), whole p(w) and the shards that hold w; by language p of an unknown word, and the
    discounts of trigrams and bigrams.
    """
    counts = scratch.write(counted(sample, shards), "counts")
    uni = scratch.write(unigrams(counts).groupBy("lang", "w").agg(F.sum("c").alias("c"), F.collect_list("part").alias("parts")), "uni")
    own = discounted(uni)
    whole = own.groupBy("lang").agg(F.sum("c").alias("total"), F.sum("d").alias("off"), F.count(F.lit(1)).alias("n"))
    whole = whole.select("lang", "total", (F.col("off") / F.col("total") / (F.col("n") + 1)).alias("base"))
    base = {r["lang"]: r["base"] for r in whole.collect()}
    own = own.join(F.broadcast(whole), "lang")  # a row a language
    ones = scratch.write(own.select("lang", "w", ((F.col("c") - F.col("d")) / F.col("total") + F.col("base")).alias("p"), "parts"), "ones")
    scratch.drop("uni")
    sums = counts.groupBy("lang").agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(8))).collect()
    return counts, ones, base, {r["lang"]: (discount(*r[1:5]), discount(*r[5:9])) for r in sums}


def discounted(counts: DataFrame) -> DataFrame:
    """Counts (lang, ..., c) with d, the discount of each."""
    rows = [(k, *x) for k, x in discounts(counts, "c").items()]
    table = counts.sparkSession.createDataFrame(rows, "lang long, d1 double, d2 double, d3 double")
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    return counts.join(F.broadcast(table), "lang").withColumn("d", d)  # a row a language


class Shard:
    """What one language's trigrams of one shard give: the shares of n-grams, and what contexts leave to lower order."""

    def __init__(self, model, ones, discounts):
        import numpy as np

        d3, d2 = (np.array([0, *x]) for x in discounts)
        words, uv, w, c = np.cumsum(unpack(model[0])).view(np.uint64), np.cumsum(unpack(model[1])), unpack(model[2]), unpack(model[3])
        self.words, self.size = words, len(words)
        self.p = np.full(self.size, -1.0)
        for names, p in ones:
            self.p[np.searchsorted(words, np.frombuffer(names, np.uint64))] = np.frombuffer(p, np.float64)
        first = np.flatnonzero(np.diff(uv, prepend=-1))
        off, total = d3[np.minimum(c, 3)], np.add.reduceat(c, first)
        self.pairs, self.rest3 = uv[first], np.add.reduceat(off, first) / total
        pair = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(uv))))
        self.three, self.own3 = pair * self.size + w, (c - off) / total[pair]
        self.two, c = np.unique(uv // self.size * self.size + w, return_counts=True)
        v, w, off = self.two // self.size, self.two % self.size, d2[np.minimum(c, 3)]
        total = np.bincount(v, c, self.size)
        self.rest2 = np.where(total > 0, np.bincount(v, off, self.size) / np.maximum(total, 1), 1.0)
        self.own2 = (c - off) / total[v] + self.rest2[v] * self.p[w]

    def look(self, names, u, v, w):
        """p of each trigram, and whether p(w) is still a factor of it; words are places in names."""
        import numpy as np

        own = places(self.words, names)
        u, v, w = own[u], own[v], own[w]
        pair = places(self.pairs, np.where((u >= 0) & (v >= 0), v * self.size + u, -1))
        three = places(self.three, np.where((pair >= 0) & (w >= 0), pair * self.size + w, -1))
        two = places(self.two, np.where((v >= 0) & (w >= 0), v * self.size + w, -1))
        one = np.where(w >= 0, self.p[w], -1.0)
        rest = np.where(pair >= 0, self.rest3[pair], 1.0)
        lower = np.where(two >= 0, self.own2[two], np.where(v >= 0, self.rest2[v], 1.0) * np.where(one >= 0, one, 1.0))
        return np.where(three >= 0, self.own3[three], 0.0) + rest * lower, (two < 0) & (one < 0)


def looked(texts: DataFrame, counts: DataFrame, ones: DataFrame, known, discounts: dict, shards: int, at: int) -> DataFrame:
    """(t, w, lp, n, unknown): sums of logarithms, numbers of words and of words that aren't in the model, of the texts (t, lang, text) in
    every SLICES-th shard from `at` on. Where w isn't null, p(w) is still to be added.
    """

    def send_ones(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            part, lang, w, p = (c.to_numpy() for c in batch.columns)
            order = np.lexsort((lang, part))
            edge = np.flatnonzero((np.diff(part[order]) != 0) | (np.diff(lang[order]) != 0)) + 1
            yield blocks([(int(part[i[0]]), ONES, int(lang[i[0]]), w[i].tobytes(), p[i].tobytes(), *[None] * 4) for i in np.split(order, edge) if len(i)])

    def look(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        part = None
        for batch in batches:
            for p, kind, lang, *data in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, models, words, ready = p, {}, {}, {}
                    release()
                if kind == MODEL:
                    models[lang] = data
                elif kind == ONES:
                    words.setdefault(lang, []).append(data[:2])
                elif lang in discounts:  # else no text of the language is trusted
                    if lang in models:
                        ready[lang] = Shard(models.pop(lang), words.pop(lang), discounts[lang])
                    names, (u, v, w) = np.frombuffer(data[0], np.uint64), map(unpack, data[1:4])
                    t, n = np.frombuffer(data[4], np.int64), unpack(data[5])
                    prob, new = ready[lang].look(names, u, v, w) if lang in ready else (np.ones(len(w)), np.ones(len(w), bool))
                    owner = np.repeat(np.arange(len(t)), n)
                    lost = new & (names[w] == UNKNOWN)
                    sums = np.bincount(owner, np.log(prob), len(t)), n, np.bincount(owner[lost], minlength=len(t))
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.nulls(len(t), pa.int64()), *map(pa.array, sums)], ["t", "w", "lp", "n", "unknown"])
                    new &= ~lost
                    if k := np.count_nonzero(new):
                        zero = pa.array(np.zeros(k, np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(t[owner[new]]), pa.array(names.view(np.int64)[w[new]]), pa.array(np.zeros(k)), zero, zero], ["t", "w", "lp", "n", "unknown"])

    none = F.lit(None).cast("binary")
    mine = F.col("part") % SLICES == at
    model = counts.where(mine).select("part", F.lit(MODEL).alias("kind"), "lang", F.col("words").alias("a"), F.col("uv").alias("b"), F.col("w").alias("c"), F.col("c").alias("d"), none.alias("e"), none.alias("f"))
    own = ones.select(F.explode("parts").alias("part"), "lang", "w", "p").where(mine).mapInArrow(send_ones, BLOCK)
    whole = model.unionByName(own).unionByName(dealt(texts, shards, SLICES, at, known))
    count = -(-shards // SLICES)
    return whole.repartitionById(count, F.floor(F.col("part") / SLICES).cast("int")).sortWithinPartitions("part", "kind").mapInArrow(look, "t long, w long, lp double, n long, unknown long")


def score(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, lang, tokens, perplexity, threshold, kept) for every row of docs.

    perplexity: of the whole text under its language's model; null for null texts, texts without words and languages without
    trusted text. threshold: the `keep` quantile of the perplexities of all of the language's documents (percentile_approx,
    exact to 1 in 100 000); kept: perplexity <= threshold, so ties with it stay; where perplexity is null, kept is null and
    decides nothing. Null and empty languages are one. Repeated rows and rows without doc_id are scored like others. Labels:
    doc_id, quality, toxic (null counts as 0); several labels for one document count once. Other columns are ignored.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    sample = trusted(docs, labels)
    size = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_CHARS))
    counts, ones, base, discounts = train(sample, shards, scratch)
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("")), F.col("text").cast("string")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.xxhash64(lang, text).alias("t"), text.alias("text"))
    known = known_words(ones)
    sums = []
    for at in range(SLICES):  # equal texts add up to the same mean
        part = looked(every.select("t", "lang", tokens_text(F.col("text")).alias("text")), counts, ones, known, discounts, shards, at)
        part = part.groupBy("t", "w").agg(*(F.sum(c).alias(c) for c in ("lp", "n", "unknown")), F.count("w").alias("times"))
        part = scratch.write(part, f"slice{at}")
        spark.sparkContext._jvm.System.gc()  # nothing refers to the blocks any more; they needn't lie beside the join's shuffles
        later = part.where("w is not null").join(ones.select("w", "p"), "w", "left")
        later = later.select("t", F.coalesce(F.log("p") * F.col("times"), F.lit(0.0)).alias("lp"), F.lit(0).cast("long").alias("n"), F.when(F.col("p").isNull(), F.col("times")).otherwise(0).alias("unknown"))
        both = part.where("w is null").select("t", "lp", "n", "unknown").unionByName(later)
        sums.append(scratch.write(both.groupBy("t").agg(*(F.sum(c).alias(c) for c in ("lp", "n", "unknown"))), f"sums{at}"))
        scratch.drop(f"slice{at}")
    known.destroy()
    scratch.drop("counts", "ones")
    whole = sums[0]
    for more in sums[1:]:
        whole = whole.unionByName(more)
    whole = whole.groupBy("t").agg(*(F.sum(c).alias(c) for c in ("lp", "n", "unknown")))
    names = [r["lang"] for r in every.select("lang").distinct().collect()]
    rows = [(x, float(np.log(base[int(h)]))) for x, h in zip(names, lang_hash(pa.array(names, pa.string()))) if int(h) in base]
    bases = spark.createDataFrame(rows, "lang string, base double")
    words = F.coalesce(F.regexp_count(F.lower("text"), F.lit(TOKEN_RE)), F.lit(0)).cast("long")
    out = every.select("doc_id", "lang", "t", words.alias("tokens")).join(whole, "t", "left").join(F.broadcast(bases), "lang", "left")  # a row a language
    perplexity = F.exp(-(F.col("lp") + F.col("unknown") * F.col("base")) / F.col("n"))
    scored = scratch.write(out.select("doc_id", "lang", "tokens", perplexity.alias("perplexity")), "scored")
    scratch.drop(*(f"sums{at}" for at in range(SLICES)))
    limits = scored.groupBy("lang").agg(F.percentile_approx("perplexity", keep, 100_000).alias("threshold"))  # a row a language
    return scored.join(limits, "lang", "left").select("doc_id", "lang", "tokens", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
