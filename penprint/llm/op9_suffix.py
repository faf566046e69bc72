"""Operator 9: exact substring dedup by a distributed suffix array, built with the difference cover {1, 2} modulo 3.

Words are the letters of the alphabet. Passages that can't hold a repeat of LENGTH words are set aside first by an exact
test (winnowing), and equal passages are folded into one. Over what remains: sort the triples at places 1 and 2 modulo 3,
recurse on their names, merge the remaining suffixes, and compare the first LENGTH words of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, chunks, forget, mix, read, windows, word_counts

#: Words from which on a repeat is cut, and words in a fingerprint of the test that sets passages aside.
LENGTH = 50
GRAM = 25

#: Suffixes that one task orders, and letters that one batch of rows is made of.
ROWS = 400_000
LETTERS = 200_000

#: Ranges that triples fall into at most (a task orders more rows than ROWS beyond that), and triples sampled for each: together they
#: bound what the driver gathers and sends, to some 25 MB.
RANGES = 1 << 16
SAMPLES = 16

#: Bits of a word's hash that make a letter. Two windows that differ in one word alone are taken for equal with a chance of 2^-BITS.
BITS = 39

#: Id of rows without doc_id: they come last.
LAST = (1 << 63) - 1


def winnow(words: Words, length: int, gram: int):
    """Hashes of all gram-word runs, where they are the least of some window of `length` words within a text, each window's
    least, and which windows lie within a text.

    The least hangs on the window alone, so equal windows have the same.
    """
    import numpy as np

    n = len(words.hash)
    g = windows(words.hash, gram)
    span = length - gram + 1
    starts = n - length + 1
    if starts <= 0:
        return g, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    least = _sliding(g, span, np.minimum)
    room = np.repeat(words.offsets[1:], np.diff(words.offsets)) - np.arange(n)  # words from here to the text's end
    valid = room[:starts] >= length
    least = np.where(valid, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    chosen = np.flatnonzero((g == _sliding(padded, span, np.maximum)) & (g > 0))
    return g, chosen, least, valid


def _sliding(x, span: int, f):
    """f over every `span` consecutive entries, in log2(span) passes."""
    width = 1
    while width * 2 <= span:
        x = f(x[: len(x) - width], x[width:])
        width *= 2
    return f(x[: len(x) - (span - width)], x[span - width :]) if span > width else x


def passages(docs: DataFrame, again: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, row, start, content, letters): longest stretches of windows whose least fingerprint is repeated.

    A window whose least fingerprint was chosen once in the whole table has no equal; all others lie in such a stretch.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            ids, rows, seen = batch.column(0), batch.column(1), batch.column(3)
            for at, some in chunks(batch.column(2)):
                words = Words(some)
                g, _, least, valid = winnow(words, length, gram)
                if not len(valid):
                    continue
                lists = seen.slice(at, len(some))
                owner = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy())
                ok = valid & np.isin(least, g[words.offsets[owner] + lists.flatten().to_numpy()])
                first = np.arange(len(valid))
                text = np.searchsorted(words.offsets, first, side="right") - 1
                edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
                a, b = edge[::2], edge[1::2]
                if not len(a):
                    continue
                # starts of different texts are never neighbours: a text's last length - 1 words start no window
                letters = (mix(words.hash) >> np.uint64(64 - BITS)).astype(np.int64)
                raw = words.hash
                pieces = [letters[x : y - 1 + length] for x, y in zip(a, b)]
                content = [xxhash.xxh3_128_digest(raw[x : y - 1 + length].tobytes()) for x, y in zip(a, b)]
                who = pa.array(at + text[a])
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(who), rows.take(who), pa.array((a - words.offsets[text[a]]).astype(np.int32)), pa.array(content, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces)))],
                    ["doc_id", "row", "start", "content", "letters"],
                )

    lists = again.groupBy("doc_id", "row").agg(F.collect_set("at").alias("seen"))
    return docs.join(lists, ["doc_id", "row"]).select("doc_id", "row", "text", "seen").mapInArrow(run, "doc_id long, row long, start int, content binary, letters array<long>")


class Strings:
    """A batch of (id, letters) as flat arrays: value, string number, place in the string, and length of the string."""

    def __init__(self, ids, lists):
        import numpy as np

        self.value = lists.flatten().to_numpy()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(n) - n
        self.string = np.repeat(np.arange(len(n)), n)
        self.id = ids.to_numpy()[self.string]
        self.place = np.arange(len(self.value)) - np.repeat(starts, n)
        self.left = np.repeat(n, n) - self.place
        self.start = starts[self.string]

    def ahead(self, x, k: int, none: int = -1):
        """x at k places further on in the same string, `none` past its end."""
        import numpy as np

        out = np.full(len(x), none, np.int64)
        ok = np.flatnonzero(self.left > k)
        out[ok] = x[ok + k]
        return out


def slices(batches: Iterator, column: int) -> Iterator:
    """Slices of record batches with about LETTERS list entries each."""
    import numpy as np

    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().to_numpy())
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS)))
            yield batch.slice(at, to - at)
            at = to


def packed(columns: list) -> bytes:
    """Integer columns as bytes, byte plane by byte plane, so that compression finds the empty ones."""
    import numpy as np

    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return b"".join(planes)


def unpacked(blocks: list[bytes], kinds: list) -> list:
    """The columns of several blocks, each one after another."""
    import numpy as np

    width = sum(np.dtype(k).itemsize for k in kinds)
    found = [[] for _ in kinds]
    for block in blocks:
        n, at = len(block) // width, 0
        for out, kind in zip(found, kinds):
            size = np.dtype(kind).itemsize
            planes = np.frombuffer(block, np.uint8, n * size, at).reshape(size, n)
            out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
            at += n * size
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(found, kinds)]


def to_parts(part, columns: list):
    """One row (part, block) for each part that occurs."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    columns = [np.ascontiguousarray(c)[order] for c in columns]
    ends = [*first[1:], len(part)] if len(part) else []
    blocks = [packed([c[x:y] for c in columns]) for x, y in zip(first, ends)]
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32) if len(part) else [], pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])


BLOCKS = "part int, block binary"


def by_part(blocks: DataFrame, parts: int, work, kinds: list, schema: str) -> DataFrame:
    """work(part, columns) for each part with all its rows together; it yields record batches.

    Rows travel as blocks of packed columns, so the shuffle moves few rows; a part has about ROWS of them.
    """

    def run(batches: Iterator) -> Iterator:
        forget()
        part, held = None, []
        for batch in batches:
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part and held:
                    columns, held = unpacked(held, kinds), []  # only one copy of a part's rows is held
                    yield from work(part, columns)
                part = p
                held.append(block)
        if held:
            columns, held = unpacked(held, kinds), []
            yield from work(part, columns)

    return blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def split_points(strings: DataFrame, parts: int) -> list:
    """Three columns of triples, in order, that divide all triples into about `parts` ranges, from a sample of some SAMPLES a range."""
    import numpy as np

    total = strings.agg(F.sum(F.size("letters"))).first()[0] or 0
    step = max(1, total // (SAMPLES * parts))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 1):
            s = Strings(batch.column(0), batch.column(1))
            pick = np.flatnonzero(mix(s.id * 1_000_003 + s.place) % np.uint64(step) == 0)
            columns = [s.value, s.ahead(s.value, 1), s.ahead(s.value, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c[pick]) for c in columns], ["t0", "t1", "t2"])

    found = strings.select("id", "letters").mapInArrow(run, "t0 long, t1 long, t2 long").toArrow()
    sample = np.stack([c.to_numpy() for c in found.columns], 1)
    sample = sample[np.lexsort(sample.T[::-1])]
    points = np.unique(sample[np.arange(1, parts) * len(sample) // parts], axis=0) if len(sample) else sample
    return [np.ascontiguousarray(c) for c in points.T]


def range_of(points: list, t0, t1, t2):
    """How many of the points are at most each triple."""
    import numpy as np

    if not len(points[0]):
        return np.zeros(len(t0), np.int64)
    known = points
    out = np.searchsorted(known[0], t0, side="right")
    unsure = np.flatnonzero(out != np.searchsorted(known[0], t0))

    def text(x, y, z):
        both = np.stack([x, y, z], 1) + (1 << 62)  # order of bytes is order of numbers
        return np.ascontiguousarray(both.astype(">u8")).view("S24").ravel()

    if len(unsure):
        out[unsure] = np.searchsorted(text(*known), text(t0[unsure], t1[unsure], t2[unsure]), side="right")
    return out


def triples(strings: DataFrame, every: bool, points: list) -> DataFrame:
    """Blocks (t0, t1, t2, id, at) by range: triples at all places, or at those of the cover; these belong to child strings
    2 id and 2 id + 1."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in slices(batches, 1):
            s = Strings(batch.column(0), batch.column(1))
            keep = slice(None) if every else np.flatnonzero(s.place % 3)
            ids = s.id if every else s.id * 2 + s.place % 3 - 1
            at = s.place if every else s.place // 3
            t = [c[keep] for c in (s.value, s.ahead(s.value, 1), s.ahead(s.value, 2))]
            yield to_parts(range_of(points, *t), [*t, ids[keep], at[keep].astype(np.int32)])

    return strings.select("id", "letters").mapInArrow(run, BLOCKS)


def named(rows: DataFrame, parts: int) -> DataFrame:
    """Blocks (id, at, name) by hash of id: names of triples, ordered like them; a name is its range's number and a count in it."""

    def work(part, c) -> Iterator:
        import numpy as np

        order = np.lexsort((c[2], c[1], c[0]))
        t = [x[order] for x in c[:3]]
        new = np.ones(len(order), bool)
        new[1:] = (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1]) | (t[2][1:] != t[2][:-1])
        yield from to_strings(c[3][order], c[4][order], (part << 40) + np.cumsum(new), parts)

    return by_part(rows, parts, work, ["i8", "i8", "i8", "i8", "i4"], BLOCKS)


def to_strings(ids, at, name, parts: int) -> Iterator:
    import numpy as np

    yield to_parts((mix(ids) % np.uint64(parts)).astype(np.int64), [ids, at, name])


def assembled(rows: DataFrame, parts: int) -> DataFrame:
    """(id, letters): strings put together from blocks (id, at, name)."""

    def work(part, c) -> Iterator:
        import numpy as np
        import pyarrow as pa

        order = np.lexsort((c[1], c[0]))
        ids, names = c[0][order], c[2][order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(names))
        yield pa.RecordBatch.from_arrays([pa.array(ids[first]), lists], ["id", "letters"])

    return by_part(rows, parts, work, ["i8", "i4", "i8"], "id long, letters array<long>")


def ranked_strings(strings: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, letters, one, two): strings with the ranks at places 1 and 2 modulo 3."""
    one = ranks.where("id % 2 = 0").select(F.expr("id div 2").alias("id"), F.col("letters").alias("one"))
    two = ranks.where("id % 2 = 1").select(F.expr("id div 2").alias("id"), F.col("letters").alias("two"))
    return strings.select("id", "letters").join(one, "id", "left").join(two, "id", "left").select("id", "letters", "one", "two")


#: Columns of a suffix: two letters, the ranks that the merge compares, its string and place, and a hash of its beginning.
SUFFIX = ["i8", "i8", "i8", "i8", "i8", "i8", "i4", "i8"]


def suffixes(strings: DataFrame, points: list, length: int) -> DataFrame:
    """Blocks of every suffix, by range of its triple, from ranked strings.

    length 0: no hash and all suffixes; otherwise a hash of the first `length` letters, and only suffixes that have so many.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow.compute as pc

        for batch in slices(batches, 1):
            s = Strings(batch.column(0), batch.column(1))
            rank = np.full(len(s.value), -2, np.int64)
            for k in (1, 2):
                rank[s.place % 3 == k] = pc.drop_null(batch.column(k + 1)).flatten().to_numpy()
            r1 = np.where(s.place % 3 != 2, s.ahead(rank, 1), -2)
            r2 = np.where(s.place % 3 != 1, s.ahead(rank, 2), -2)
            prefix, keep = np.zeros(len(rank), np.int64), slice(None)
            if length:
                w = windows(s.value, length).view(np.int64)
                prefix[: len(w)] = w
                keep = np.flatnonzero(s.left >= length)
            t = [c[keep] for c in (s.value, s.ahead(s.value, 1), s.ahead(s.value, 2))]
            yield to_parts(range_of(points, *t), [*t[:2], *(c[keep] for c in (rank, r1, r2, s.id)), s.place[keep].astype(np.int32), prefix[keep]])

    return strings.mapInArrow(run, BLOCKS)


def merge_order(t0, t1, r, r1, r2, at):
    """Order of suffixes: those at places 1 and 2 modulo 3 by rank, those at place 0 merged in.

    Place 0 meets place 1 by (letter, rank of the rest), place 2 by (two letters, rank of the rest).
    """
    import numpy as np

    mod = at % 3
    zero, sample = np.flatnonzero(mod == 0), np.flatnonzero(mod)
    zero = zero[np.lexsort((r1[zero], t0[zero]))]
    sample = sample[np.argsort(r[sample], kind="stable")]
    where = np.empty(len(at), np.int64)
    where[zero], where[sample] = np.arange(len(zero)), np.arange(len(sample))
    for k, keys in ((1, (r1, t0)), (2, (r2, t1, t0))):
        other = np.flatnonzero(mod == k)
        both = np.concatenate([zero, other])
        order = np.lexsort([key[both] for key in keys])
        new = np.zeros(len(both), bool)
        for key in keys:
            x = key[both][order]
            new[1:] |= x[1:] != x[:-1]
        dense = np.empty(len(both), np.int64)
        dense[order] = np.cumsum(new)
        a, b = dense[: len(zero)], dense[len(zero) :]
        where[zero] += np.searchsorted(np.sort(b), a)
        where[other] += np.searchsorted(np.sort(a), b)
    return np.argsort(where, kind="stable")


def merged(rows: DataFrame, parts: int) -> DataFrame:
    """Blocks (id, at, name) by hash of id: the rank of every suffix."""

    def work(part, c) -> Iterator:
        import numpy as np

        order = merge_order(*c[:5], c[6])
        yield from to_strings(c[5][order], c[6][order], (part << 40) + np.arange(len(order)), parts)

    return by_part(rows, parts, work, SUFFIX, BLOCKS)


def later_copies(rows: DataFrame, parts: int) -> DataFrame:
    """(id, at): suffixes whose beginning is also that of an earlier suffix, by order of id and place."""

    def work(part, c) -> Iterator:
        import numpy as np
        import pyarrow as pa

        order = merge_order(*c[:5], c[6])
        ids, at, prefix = c[5][order], c[6][order], c[7][order]
        start = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))  # neighbours that differ
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((at, ids))] = np.arange(len(order))
        least = np.minimum.reduceat(rank, start)
        later = rank != np.repeat(least, np.diff(np.append(start, len(order))))
        yield pa.RecordBatch.from_arrays([pa.array(ids[later]), pa.array(at[later])], ["id", "at"])

    return by_part(rows, parts, work, SUFFIX, "id long, at int")


def fingerprints(docs: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """Blocks (fp, doc_id, row, at, known) by hash of fp: the chosen runs of every text of `length` words or more.

    Where a task finds a fingerprint several times, its first has known = 2, the others have 1 and go to any part, so that a
    fingerprint that is everywhere makes no large part.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        forget()
        held, n = [], 0
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, some in chunks(batch.column(2)):
                words = Words(some)
                g, chosen, _, _ = winnow(words, length, gram)
                text = np.searchsorted(words.offsets, chosen, side="right") - 1
                place = (chosen - words.offsets[text]).astype(np.int32)
                held.append((g[chosen].view(np.int64), ids[at + text], rows[at + text], place))
                n += len(chosen)
                if n >= ROWS:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    def sent(held: list):
        import numpy as np

        fp, ids, rows, at = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(fp, kind="stable")
        again = np.zeros(len(fp), bool)
        again[1:] = fp[order][1:] == fp[order][:-1]
        known = np.zeros(len(fp), np.int8)
        known[order[:-1]] = again[1:] * 2
        known[order[again]] = 1
        part = mix(np.where(known == 1, rows ^ at, fp)) % np.uint64(parts)
        return to_parts(part.astype(np.int64), [fp, ids, rows, at, known])

    return docs.where("text is not null").select("doc_id", "row", "text").mapInArrow(run, BLOCKS)


def repeated(blocks: DataFrame, parts: int) -> DataFrame:
    """(doc_id, row, at): runs of fingerprints that were chosen more than once."""

    def work(part, c) -> Iterator:
        import numpy as np
        import pyarrow as pa

        fp, known = c[0], c[4]
        free = np.flatnonzero(known != 1)
        free = free[np.argsort(fp[free])]
        same = fp[free][1:] == fp[free][:-1]
        keep = known > 0
        keep[free[1:][same]] = keep[free[:-1][same]] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in c[1:4]], ["doc_id", "row", "at"])

    return by_part(blocks, parts, work, ["i8", "i8", "i8", "i4", "i1"], "doc_id long, row long, at int")


def suffix_ranks(scratch: Scratch, strings: DataFrame, need: int, level: int = 0) -> DataFrame:
    """(id, letters): for every place of the cover in every string (level 0), or every place (deeper), a rank by which
    suffixes stand in order.

    Suffixes whose first `need` letters differ stand in the order of these; others may stand in any. strings: (id, letters),
    written already, letters 0 or more, id 0 or more.
    """
    parts = parts_for(strings)
    points = split_points(strings, parts)
    if need <= 3:
        return scratch.write(assembled(named(triples(strings, True, points), parts), parts), f"ranks{level}")
    child = scratch.write(assembled(named(triples(strings, False, points), parts), parts), f"strings{level + 1}")
    ranks = suffix_ranks(scratch, child, -(-need // 3), level + 1)
    scratch.drop(f"strings{level + 1}")
    if not level:
        return ranks
    both = scratch.write(ranked_strings(strings, ranks), f"ranked{level}")
    out = scratch.write(assembled(merged(suffixes(both, points, 0), parts), parts), f"ranks{level}")
    scratch.drop(f"ranks{level + 1}", f"ranked{level}")
    return out


def parts_for(strings: DataFrame) -> int:
    letters = strings.agg(F.sum(F.size("letters"))).first()[0] or 0
    return min(RANGES, max(1, -(-letters // ROWS)))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, row, start, n): word ranges to cut, from docs (doc_id, row, text). Ranges of one row may overlap."""
    spark = docs.sparkSession
    if length <= 3:
        raise ValueError("length must be more than 3 words")
    scratch = Scratch(spark, "suffix")
    gram = min(gram, length)
    # one run in (length - gram) / 2 words or more is chosen; a word with its space has some 6 bytes
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(RANGES, 1 + size // (3 * (length - gram + 2) * ROWS))
    again = repeated(fingerprints(docs, length, gram, parts), parts)
    found = scratch.write(passages(docs, again, length, gram), "passages")
    # Equal passages: the first stands for all in the array, the others go whole.
    place = F.struct("doc_id", "row", "start")
    n = F.size("letters").alias("n")
    firsts = found.groupBy("content").agg(F.min(place).alias("first"))
    copies = found.select("content", "doc_id", "row", "start", n).join(firsts, "content").where(place != F.col("first"))
    copies = scratch.write(copies.select("doc_id", "row", "start", "n"), "copies")
    keys = firsts.select("first.*").alias("f")
    heads = found.join(keys, ["doc_id", "row", "start"], "left_semi").dropDuplicates(["doc_id", "row", "start"])
    # Ids in the order of the passages, so that the least id and place is the first occurrence.
    ordered = heads.drop("content").repartitionByRange("doc_id", "row", "start").sortWithinPartitions("doc_id", "row", "start")
    heads = scratch.write(ordered.withColumn("id", F.monotonically_increasing_id()), "heads")
    scratch.drop("passages")
    strings = heads.select("id", "letters")
    parts = parts_for(strings)
    ranks = suffix_ranks(scratch, strings, length)
    rows = suffixes(ranked_strings(strings, ranks), split_points(strings, parts), length)
    later = scratch.write(later_copies(rows, parts), "later")
    scratch.drop("ranks1")
    ranges = later.join(heads.select("id", "doc_id", "row", "start"), "id")
    ranges = ranges.select("doc_id", "row", (F.col("start") + F.col("at")).alias("start"), F.lit(length).alias("n"))
    return ranges.unionByName(copies)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, text, words, removed) and the columns named in carry: each row's text without every run of `length` or more words that occurred before.

    A run's first occurrence, by order of doc_id and then place, stays; what its later ones cover, in any document or further
    on in the same one, goes, each word with the white space before it; a repeat that overlaps its first occurrence (one word
    over and over) takes the words that they share, so at least the first word stays. Words are what white space separates; case and stops
    count. A text that loses nothing comes back unchanged; one that loses all its words keeps the white space at its end.
    Null texts stay null with 0 words; texts under `length` words lose nothing. Rows without doc_id come after all others.
    Words are compared by BITS bits of their hashes.
    Repeated rows (same doc_id and text) count as one document; other rows of one doc_id are told apart by their text. Other
    columns are left out. The ranges are found when this is called, not when its result is read.
    """
    carry = carry or []
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"__{c}") for c in carry))
    wide = wide.withColumns({"id": F.coalesce("doc_id", F.lit(LAST)), "row": F.xxhash64("text")})
    cuts = repeats(wide.select(F.col("id").alias("doc_id"), "row", "text"), length, gram).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            words_n, gone_n = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            cuts = batch.column(2)
            some = np.flatnonzero(pc.is_valid(cuts).to_numpy(zero_copy_only=False))
            new = []
            for at, texts in chunks(batch.column(1)):
                words_n[at : at + len(texts)] = word_counts(texts)
            for at, texts in chunks(batch.column(1).take(pa.array(some))):
                words = Words(texts)
                for i in range(len(texts)):
                    here, row = words.text(i), some[at + i]
                    edge = np.zeros(here.stop - here.start + 1, np.int64)
                    ranges = cuts[row].values
                    start, n = ranges.field("start").to_numpy(), ranges.field("n").to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    gone_n[row] = len(keep) - keep.sum()
                    a, b = words.bounds[i], words.bounds[i + 1]
                    ends = words.last[here]
                    starts = np.concatenate([[a], ends[:-1]])
                    # stretches of kept words, each with the white space before it, and the white space at the end
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
                    pieces = [words.bytes[starts[x] : ends[y - 1]].tobytes() for x, y in zip(turn[::2], turn[1::2])]
                    new.append((b"".join(pieces) + words.bytes[ends[-1] : b].tobytes()).decode())
            texts = batch.column(1)
            if len(some):
                place = np.arange(batch.num_rows)
                place[some] = batch.num_rows + np.arange(len(some))
                texts = pa.concat_arrays([texts, pa.array(new, texts.type)]).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(words_n), pa.array(gone_n), *batch.columns[3:]], ["doc_id", "text", "words", "removed", *carry])

    schema = ", ".join(["doc_id long, text string, words int, removed int", *(f"`{c}` {wide.schema[f'__{c}'].dataType.simpleString()}" for c in carry)])
    cuts = cuts.withColumnRenamed("doc_id", "id")
    joined = wide.join(cuts, ["id", "row"], "left").select("doc_id", "text", "cuts", *(f"__{c}" for c in carry))
    return joined.mapInArrow(run, schema)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix": op9_suffix}
SQL = {
    "op9_suffix": rf"""
WITH cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[ \t\n\r\f\x0b]*[^ \t\n\r\f\x0b]+') AS p, regexp_extract(text, '[ \t\n\r\f\x0b]*$') AS tail
  FROM documents),
plain AS (SELECT doc_id, list_transform(p, lambda x: regexp_replace(x, '^[ \t\n\r\f\x0b]+', '')) AS w FROM cut),
starts AS (SELECT doc_id, unnest(range(len(w) - {LENGTH - 1})) AS i, w FROM plain WHERE len(w) >= {LENGTH}),
keyed AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {LENGTH}], ' ') AS run FROM starts),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM keyed),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS j FROM placed WHERE k > 1),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
pieces AS (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS j FROM cut SEMI JOIN gone USING (doc_id)),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY j) AS t FROM pieces ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN text ELSE coalesce(t, '') || tail END AS text, coalesce(len(p), 0)::INTEGER AS words, coalesce(n, 0)::INTEGER AS removed
FROM cut LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
