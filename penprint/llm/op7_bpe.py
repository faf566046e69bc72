"""Operator 7: byte-level BPE encoding and decoding with DuckDB's recursive queries, partition by partition."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_files import PATTERN, RANKS, load_ranks
from .common import latest, mix, polynomial, read, release

#: Rows that one recursive query may make (a word of n bytes makes n * n / 2 at most), words of texts that are put together at a
#: time, and tokens that are decoded at a time; they bound memory.
ROWS_AT_ONCE = 2_000_000
WORDS_OUT = 200_000
TOKENS_AT_ONCE = 500_000

#: Words that are looked up together, and what a task remembers at most, so that its memory doesn't grow with the partition: different
#: words of late (twice as many with those before), and pieces of token lists.
WORDS_AT_ONCE = 1_000_000
KNOWN_WORDS = 200_000
KNOWN_PIECES = 500_000

#: Bytes from which on a word is contracted by a heap of its pairs, in the same order: a round a pair takes the square of its length.
LONG_WORD = 1024

#: Rows of a word's tokens, each with the token after it. A round finds each word's leftmost pair of least rank, makes it one
#: token and closes the gap; words without a mergeable pair drop out, so that their last rows are the fixpoint.
CONTRACT = """
WITH RECURSIVE s AS (
  SELECT w, i, tok, nxt, 0 AS round FROM cells
  UNION ALL
  (WITH least AS (
     SELECT s.w, min(m.merged::BIGINT * 4294967296 + s.i) AS k
     FROM s JOIN merges m ON m.pair = s.tok::BIGINT * 4294967296 + s.nxt GROUP BY s.w),
   b AS (
     SELECT least.w, (k % 4294967296)::INT AS at, (k // 4294967296)::INT AS tok, s.nxt
     FROM least JOIN s ON s.w = least.w AND s.i = (k % 4294967296) + 1)
   SELECT s.w, (CASE WHEN s.i > b.at THEN s.i - 1 ELSE s.i END)::INT, CASE WHEN s.i = b.at THEN b.tok ELSE s.tok END,
     CASE WHEN s.i = b.at THEN b.nxt WHEN s.i = b.at - 1 THEN b.tok ELSE s.nxt END, s.round + 1
   FROM s JOIN b ON s.w = b.w WHERE s.i <> b.at + 1)
)
SELECT w, list(tok ORDER BY i) AS toks FROM s JOIN (SELECT w, max(round) AS last FROM s GROUP BY w) USING (w)
WHERE round = last GROUP BY w ORDER BY w
"""

JOIN_UP = """
SELECT t.d, list(v.bytes ORDER BY t.i) AS bytes
FROM tokens t LEFT JOIN vocabulary v ON v.tok = t.tok GROUP BY t.d ORDER BY t.d
"""


class Merger:
    """A DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, path: str):
        import duckdb
        import numpy as np
        import pyarrow as pa

        self.ranks = ranks = load_ranks(path)
        rows = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        m = np.array(rows, np.int64).reshape(-1, 3)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = pa.table({"pair": m[:, 0] * 4294967296 + m[:, 1], "merged": m[:, 2].astype(np.int32)})  # noqa: F841
        vocabulary = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.merges = {(a, b): r for a, b, r in rows}
        self.spaced = np.zeros(max(ranks.values()) + 2, bool)
        self.spaced[[r for t, r in ranks.items() if t[:1] == b" "]] = True
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word; a word that is a token is that token."""
        out: list = [[r] if (r := self.ranks.get(w)) is not None else None for w in words]
        some, rows = [], 0
        for k, toks in enumerate(out):
            if toks is not None:
                continue
            n = len(words[k])
            if n >= LONG_WORD:
                out[k] = self._by_heap(words[k])
                continue
            if rows + n * n // 2 > ROWS_AT_ONCE:
                self._fill(out, words, some)
                some, rows = [], 0
            some.append(k)
            rows += n * n // 2
        self._fill(out, words, some)
        return out

    def _fill(self, out: list, words: list[bytes], some: list[int]) -> None:
        if some:
            for k, toks in zip(some, self._contract([words[k] for k in some])):
                out[k] = toks

    def _by_heap(self, word: bytes) -> list[int]:
        """The same contraction: the leftmost pair of least rank is always the heap's least, once those that are gone are passed over."""
        import heapq

        tok = [int(self.byte[b]) for b in word]
        left, right = list(range(-1, len(tok) - 1)), [*range(1, len(tok)), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(tok, tok[1:])) if (r := self.merges.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            merged, i, a, b = heapq.heappop(heap)
            j = right[i]
            if tok[i] != a or j < 0 or tok[j] != b:
                continue
            tok[i], tok[j], right[i] = merged, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := self.merges.get((tok[x], tok[y]))) is not None:
                    heapq.heappush(heap, (r, x, tok[x], tok[y]))
        return [t for t in tok if t >= 0]

    def _contract(self, words: list[bytes]):
        import numpy as np
        import pyarrow as pa

        n = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), n)
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[np.cumsum(n) - 1] = -1
        self.db.register("cells", pa.table({"w": w, "i": i.astype(np.int32), "tok": tok, "nxt": nxt}))
        found = self.db.sql(CONTRACT).to_arrow_table().column("toks").to_pylist()
        self.db.unregister("cells")
        return found

    def texts(self, flat, lengths, known: Pieces | None = None):
        """The bytes of each token list, given flat with the lists' lengths, as an Arrow binary array; null where an id isn't in the
        vocabulary. Lists are cut before each token that begins with a space; equal pieces, which `known` keeps from call to call,
        are put together once.
        """
        import numpy as np
        import pyarrow as pa

        known = known or Pieces()
        parts, ends, at = [], np.cumsum(lengths), 0
        while at < len(lengths):
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + TOKENS_AT_ONCE, side="right")))
            parts.append(self._texts(np.ascontiguousarray(flat[start : ends[to - 1]], np.int32), lengths[at:to], known))
            at = to
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _texts(self, flat, lengths, known: Pieces):
        import numpy as np
        import pyarrow as pa

        if not len(flat):
            return pa.array([b""] * len(lengths), pa.binary())
        n, edge = len(flat), np.concatenate([[0], np.cumsum(lengths)])
        begins = self.spaced[np.clip(flat, -1, len(self.spaced) - 2)]  # the last entry stands for ids below 0
        begins[edge[:-1][lengths > 0]] = True
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, n))
        if len(known.size) > KNOWN_PIECES:
            known.__init__()
        names, sample, kind = np.unique(polynomial(mix(flat.astype(np.int64)), first, first + size), return_index=True, return_inverse=True)
        if len(new := np.flatnonzero(~known.has(names))):
            known.add(names[new], flat, first[sample[new]], size[sample[new]], self.spell)
        which = known.place(names)[kind]
        # Pieces that only share their hash with a known one are put together by themselves.
        like = np.arange(n) + np.repeat(known.start[which] - first, size)
        other = np.logical_or.reduceat(known.tok[np.minimum(like, len(known.tok) - 1)] != flat, first)
        other = np.flatnonzero(other | (size != known.size[which]))
        extra = self.spell(flat, first[other], size[other])
        which[other] = len(known.bytes) + np.arange(len(other))
        joined = pa.concat_arrays([known.bytes, extra]).take(pa.array(which))
        pieces = np.searchsorted(first, edge)
        offsets = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1][pieces]
        unknown = np.concatenate([[0], np.cumsum(joined.is_null().to_numpy(zero_copy_only=False))])[pieces]
        ok = pa.array(np.diff(unknown) == 0)
        return pa.Array.from_buffers(pa.binary(), len(lengths), [ok.buffers()[1], pa.py_buffer(np.ascontiguousarray(offsets)), joined.buffers()[2] or pa.py_buffer(b"")])

    def spell(self, flat, first, size):
        """The bytes of each of some pieces of flat, null where one has an unknown id: their tokens, joined to the vocabulary, in order."""
        import numpy as np
        import pyarrow as pa

        if not len(first):
            return pa.array([], pa.binary())
        tok = flat[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)]
        d = np.repeat(np.arange(len(first), dtype=np.int64), size)
        self.db.register("tokens", pa.table({"d": d, "i": np.arange(len(tok), dtype=np.int64), "tok": tok}))
        lists = self.db.sql(JOIN_UP).to_arrow_table().column("bytes").combine_chunks()
        self.db.unregister("tokens")
        each = lists.flatten()
        edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        lost = np.concatenate([[0], np.cumsum(each.is_null().to_numpy(zero_copy_only=False))])[edge]
        ok = pa.array(np.diff(lost) == 0)
        each = pa.concat_arrays([each.cast(pa.binary())])
        offsets = np.frombuffer(each.buffers()[1], np.int32)[each.offset : each.offset + len(each) + 1][edge]
        return pa.Array.from_buffers(pa.binary(), len(lists), [ok.buffers()[1], pa.py_buffer(np.ascontiguousarray(offsets)), each.buffers()[2] or pa.py_buffer(b"")])


class Pieces:
    """Pieces of token lists that are put together already: their hashes in order, their tokens and their bytes."""

    def __init__(self):
        import numpy as np
        import pyarrow as pa

        self.names, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tok, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes = pa.array([], pa.binary())

    def has(self, names):
        import numpy as np

        at = np.searchsorted(self.names, names)
        at[at == len(self.names)] = 0
        return self.names[at] == names if len(self.names) else np.zeros(len(names), bool)

    def place(self, names):
        import numpy as np

        return self.at[np.searchsorted(self.names, names)]

    def add(self, names, flat, first, size, spell) -> None:
        """Takes in the pieces at `first` in flat; names are their hashes, all new and in order."""
        import numpy as np
        import pyarrow as pa

        where, before = np.searchsorted(self.names, names), len(self.size)
        self.names, self.at = np.insert(self.names, where, names), np.insert(self.at, where, before + np.arange(len(names)))
        tok = flat[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)]
        self.start = np.concatenate([self.start, len(self.tok) + np.cumsum(size) - size])
        self.tok, self.size = np.concatenate([self.tok, tok]), np.concatenate([self.size, size])
        self.bytes = pa.concat_arrays([self.bytes, spell(flat, first, size)])


def encode(docs: DataFrame, ranks: str = RANKS, out: str = "tokens") -> DataFrame:
    """Every column of docs plus `out`: the ids of the text's tokens, as an array of ints.

    Whole texts are encoded. A null text gives null, an empty one an empty array; repeated rows are encoded alike; an empty
    table gives an empty one. A column named like `out` is replaced. The text is read as UTF-8 bytes; strings of special
    tokens in it are ordinary text. Words of LONG_WORD bytes or more are contracted in the same order by a heap.
    """
    docs = docs.drop(out)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out}` array<int>"])
    return with_words(docs).mapInArrow(lambda batches: encoded(batches, ranks, out), schema)


def with_words(docs: DataFrame) -> DataFrame:
    """docs with their texts' words, which are cut in the JVM. (?U) lets \\s mean white space of all scripts, as in the published pattern."""
    return docs.withColumn("__words", F.regexp_extract_all(F.col("text").cast("string"), F.lit("(?U)" + PATTERN), F.lit(0)))


def encoded(batches: Iterator, ranks: str, out: str) -> Iterator:
    """Record batches whose last column, of words, is replaced by `out`, of tokens; each has some WORDS_OUT words or one text."""
    import numpy as np
    import pyarrow as pa

    release()
    merger = latest("merger", ranks, lambda: Merger(ranks))
    known: dict = {}  # words of late and their tokens as bytes; former: those of the time before
    former: dict = {}
    for batch in batches:
        words = batch.column(batch.num_columns - 1)
        rows = words.offsets.to_numpy()
        upto = lambda at, n: max(at + 1, int(np.searchsorted(rows, rows[at] + n, side="right")) - 1)
        begin = 0
        while begin < batch.num_rows:
            end = upto(begin, WORDS_AT_ONCE)
            coded = words.slice(begin, end - begin).flatten().dictionary_encode()
            distinct = coded.dictionary.cast(pa.binary()).to_pylist()
            found = [known.get(w) or former.get(w) for w in distinct]
            new = [i for i, t in enumerate(found) if t is None]
            for i, toks in zip(new, merger.words([distinct[i] for i in new])):
                found[i] = array("i", toks).tobytes()
            known.update(zip(distinct, found))
            flat = np.frombuffer(b"".join(found), np.int32)
            size = np.array([len(t) for t in found], np.int64) // 4
            start, codes, base = np.cumsum(size) - size, coded.indices.to_numpy(zero_copy_only=False), rows[begin]
            if len(known) > KNOWN_WORDS:
                known, former = {}, known
            del coded, distinct, found
            at = begin
            while at < end:
                to = min(end, upto(at, WORDS_OUT))
                which = codes[rows[at] - base : rows[to] - base]
                n = size[which]
                ends = np.concatenate([[0], np.cumsum(n)])
                take = np.arange(ends[-1]) + np.repeat(start[which] - ends[:-1], n)
                offsets = ends[rows[at : to + 1] - rows[at]].astype(np.int32)
                some = batch.slice(at, to - at)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[take]), mask=some.column(batch.num_columns - 1).is_null())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], lists], [*batch.schema.names[:-1], out])
                at = to
            begin = end


def decode(tokens: DataFrame, ranks: str = RANKS, column: str = "tokens", out: str = "text") -> DataFrame:
    """Every column but `column`, plus `out`: the text of the token ids.

    A null array, or one with an id that the vocabulary lacks or a null, gives null; an empty one gives an empty text. Bytes
    that aren't UTF-8 become U+FFFD. A column named like `out` is replaced.
    """
    tokens = tokens.drop(out) if out != column else tokens
    rest = [c for c in tokens.columns if c != column]
    tokens = tokens.select(*rest, F.col(column).cast("array<int>").alias("__tokens"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "__tokens"), f"`{out}` string"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Pieces()
        for batch in batches:
            texts = readable(spelled(batch.column(batch.num_columns - 1), ranks, known))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], out])

    return tokens.mapInArrow(run, schema)


def spelled(lists, ranks: str, known: Pieces):
    """The bytes of each token list of an Arrow array; known: pieces that are put together already."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    merger = latest("merger", ranks, lambda: Merger(ranks))
    flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.if_else(lists.is_valid(), merger.texts(flat, lengths, known), pa.scalar(None, pa.binary()))


def readable(found):
    """Arrow bytes as text; what isn't UTF-8 becomes U+FFFD."""
    import pyarrow as pa

    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in found.to_pylist()], pa.string())


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, same): every document's ids, and whether they decode to its text (null for a null text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known = Pieces()
        for batch in encoded(batches, RANKS, "tokens"):
            ids, text, tokens = batch.columns
            same = pc.equal(text.cast(pa.binary()), spelled(tokens, RANKS, known))
            yield pa.RecordBatch.from_arrays([ids, tokens, same], ["doc_id", "tokens", "same"])

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_words(docs).mapInArrow(run, "doc_id long, tokens array<int>, same boolean")  # one worker encodes and decodes


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents again, encoded and decoded in one worker."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Pieces()
        for batch in encoded(batches, RANKS, "tokens"):
            yield pa.RecordBatch.from_arrays([batch.column(0), readable(spelled(batch.column(1), RANKS, known))], ["doc_id", "text"])

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_words(docs).drop("text").mapInArrow(run, "doc_id long, text string")


QUERIES = {"op7_bpe": op7_bpe, "bpe_round_trip": bpe_round_trip}
SQL = {"bpe_round_trip": "SELECT doc_id, text FROM documents"}
