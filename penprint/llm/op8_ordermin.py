"""Operator 8: near duplicates by order MinHash, verified by banded alignment.

Each of a text's sketches picks, by a hash function of its own, the PICKED least of the text's k-mers, each labelled with how often it
has occurred before, and keeps them in the order of the text. Texts that agree in a whole sketch are likely to be within a small edit
distance. What their words alone rule out goes; a banded alignment decides the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, chunks, forget, mix, read, windows

#: Words in a k-mer, k-mers in a sketch, sketches of a text, and the edit similarity from which texts are near duplicates.
K = 3
PICKED = 3
SKETCHES = 72
SIMILARITY = 0.8

#: One changed word breaks K k-mers, most of those that a short text has. Texts up to SHORT words get SHORT_SKETCHES more, of single words.
SHORT = 31
SHORT_SKETCHES = 24

#: Counters of a bag: words by hash, up to 255 each. Texts that one task compares with each other, and words that it looks at together.
BAG = 128
BLOCK = 256
CELLS = 12_800_000

#: Counters of a bag where a group's texts are compared with each other; a power of 2.
BINS = 1024

#: Words up to which texts are aligned many pairs at a time, and bits of a step's comparisons: pairs times places.
WIDE = 1024
STEP = 1 << 19

#: Texts to fetch up to which their names (8 bytes each) go to every executor; more are joined by a shuffle.
SENT_NAMES = 1 << 20

#: Id of rows without doc_id: they come last.
LAST = (1 << 63) - 1


def sketches(words: Words, k: int = K, picked: int = PICKED, count: int = SKETCHES):
    """(owner, hash): the sketches of each text, by text. Texts without words have none.

    A text of fewer than `picked` words has one, of all its words; one of at most SHORT words has SHORT_SKETCHES of single words; one
    with `picked` k-mers or more has `count` of k-mers.
    """
    import numpy as np

    length = np.diff(words.offsets)
    owners, found = [], []
    for i in np.flatnonzero((length > 0) & (length < picked)):
        h = words.hash[words.text(i)]
        owners.append([i])
        found.append(mix(windows(h, len(h))).view(np.int64))
    for k_, count_, which in ((1, SHORT_SKETCHES, (length >= picked) & (length <= max(SHORT, k + picked - 2))), (k, count, length - k + 1 >= picked)):
        which = np.flatnonzero(which)
        if len(which) and count_:
            owners.append(np.repeat(which, count_))
            found.append(_picked(words, length, which, k_, picked, count_).ravel())
    owner, found = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (owners, found))
    order = np.argsort(owner, kind="stable")
    return owner[order], found[order]


def _picked(words: Words, length, which, k: int, picked: int, count: int):
    """(texts, count) hashes of the chosen texts, each of `picked` k-mers or more."""
    import numpy as np

    n = length[which] - k + 1
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(which)), n)
    at = np.arange(n.sum())
    g = windows(words.hash, k)[words.offsets[which][owner] + at - starts[owner]]
    # occurrence labels: how often the k-mer came before in its text
    order = np.lexsort((g, owner))
    so, sg = owner[order], g[order]
    run = np.concatenate([[True], (so[1:] != so[:-1]) | (sg[1:] != sg[:-1])])
    label = np.empty(len(order), np.uint64)
    label[order] = at - np.maximum.accumulate(np.where(run, at, 0))
    g = mix(g + label * np.uint64(0x9E3779B97F4A7C15))
    half, at = (g >> np.uint64(32)).astype(np.uint32), at.astype(np.uint64)
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(k))
    out = np.empty((len(which), count), np.int64)
    picks = np.empty((picked, len(which)), np.int64)
    for s, seed in enumerate(seeds):
        h = (half ^ np.uint32(seed >> np.uint64(32))) * np.uint32(seed | np.uint64(1))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x846CA68B)
        key = h.astype(np.uint64)  # the hash above, the place below: the least has both
        key <<= np.uint64(32)
        key |= at
        for j in range(picked):
            picks[j] = np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)
            key[picks[j]] = np.iinfo(np.uint64).max
        x = np.full(len(which), seed)
        for j in np.sort(picks, 0):  # in the order of the text
            x = mix(x * np.uint64(0x100000001B3) ^ g[j])
        out[:, s] = x.view(np.int64)
    return out


def bags(words: Words):
    """(texts, BAG) counters of each text's words, 255 at most."""
    import numpy as np

    owner = np.repeat(np.arange(len(words)), np.diff(words.offsets))
    slot = (words.hash.view(np.uint64) >> np.uint64(57)).astype(np.int64)
    return np.minimum(np.bincount(owner * BAG + slot, minlength=len(words) * BAG), 255).astype(np.uint8).reshape(-1, BAG)


def may_be_near(a, b, n, m, similarity: float):
    """Whether bags a and b (rows) of n and m words allow so few edits: an edit takes one word away, or adds one, or both."""
    import numpy as np

    d = a.astype(np.int16) - b
    least = np.maximum(np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1))
    return np.maximum(least, np.abs(n - m)) <= allowed(np.maximum(n, m), similarity)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, otherwise most + 1.

    Bit-parallel alignment over the diagonals -most..most alone; a column of the band is one integer of 2 * most + 1 bits.
    """
    n, m = 0, min(len(a), len(b))
    while n < m and a[n] == b[n]:
        n += 1
    a, b, m, n = a[n:], b[n:], m - n, 0
    while n < m and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    limit, most = most, min(most, max(len(a), len(b)))
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    # In column j, bit d of the band stands for row j - most + d. From column to column the band slides down a row.
    full = (1 << (2 * most + 1)) - 1
    top = 1 << (2 * most)
    vp, vn = full & ~((1 << most) - 1), 0  # vertical steps up and down: in column -1 each row is one more than the last
    score = min(most, len(a))  # along the lowest diagonal until it leaves the last row, then along that row
    hopeless = most + max(0, len(b) - (len(a) - most))  # the last row takes off one a column at best
    for j, x in enumerate(b):
        word = places.get(x, 0)
        match = (word >> (j - most) if j >= most else word << (most - j)) & full
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j + most < len(a):
            score += not d0 & top
            if score > hopeless:
                return limit + 1
        else:
            row = len(a) - 1 - j + most
            score += (hp >> row & 1) - (hn >> row & 1)
        down = (d0 & full) >> 1
        vp = (hn | ~(down | hp)) & full
        vn = down & hp
    return score if score <= limit else limit + 1


def allowed(words, similarity: float):
    """Edits that two texts may be apart, the longer of them having so many words (a number or an array)."""
    most = words * (1 - similarity) + 1e-9
    return int(most) if isinstance(words, int) else most.astype(int)


def bounds(x, y, most: int) -> tuple[int, int]:
    """What the edit distance of two arrays is at least, by their words alone, and at most, by one alignment."""
    import numpy as np

    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    front = n if same.all() else int(same.argmin())
    x, y, n = x[front:], y[front:], n - front
    if n:
        same = x[-n:][::-1] == y[-n:][::-1]
        back = n if same.all() else int(same.argmin())
        x, y = x[: len(x) - back], y[: len(y) - back]
    if not len(x) or not len(y):
        return (max(len(x), len(y)),) * 2
    found = anchors(x, y, most, True)
    if len(found) == 1:
        return found[0], len(x) + len(y)
    least, i, j = found
    i, j = np.concatenate([[-1], i, [len(x)]]), np.concatenate([[-1], j, [len(y)]])
    wide, high = np.diff(i) - 1, np.diff(j) - 1
    level = np.flatnonzero((wide == high) & (wide > 0))
    at = np.repeat(i[level] + 1 - (np.cumsum(wide[level]) - wide[level]), wide[level]) + np.arange(wide[level].sum())
    cost = np.maximum(wide, high)
    return least, int(cost.sum() - cost[level].sum() + (x[at] != y[at + np.repeat(j[level] - i[level], wide[level])]).sum())


def anchors(x, y, most: int, bound: bool = False):
    """Places (i, j), rising in both, of words that occur once in either array, at most `most` apart and next to another on their
    diagonal. With `bound`, before them what the words alone say the edit distance is at least; that alone if it exceeds `most`.
    """
    import numpy as np

    both = np.concatenate([x, y])
    if not len(both):
        return both, both
    order = np.argsort(both, kind="stable")  # x's before y's
    new = np.concatenate([[True], both[order][1:] != both[order][:-1]])
    first, kind = np.flatnonzero(new), np.cumsum(new) - 1
    of_y = np.bincount(kind[order >= len(x)], minlength=len(first))
    of_x = np.diff(np.append(first, len(both))) - of_y
    least = max(len(x), len(y)) - int(np.minimum(of_x, of_y).sum())
    if bound and least > most:
        return (least,)
    once = first[(of_x == 1) & (of_y == 1)]
    i, j = order[once], order[np.minimum(once + 1, len(both) - 1)] - len(x)
    by = np.argsort(i)
    i, j = i[by], j[by]
    keep = np.abs(i - j) <= most
    i, j = i[keep], j[keep]
    d = j - i
    keep = np.zeros(len(d), bool)  # one that shares its diagonal with neither neighbour may bar the way
    keep[1:] |= d[1:] == d[:-1]
    keep[:-1] |= d[1:] == d[:-1]
    i, j = i[keep], j[keep]
    keep = j > np.concatenate([[-1], np.maximum.accumulate(j)[:-1]]) if len(j) else keep[:0]
    return (least, i[keep], j[keep]) if bound else (i[keep], j[keep])


def within(x, y, most: int) -> bool:
    """Whether the edit distance of two arrays is at most `most`."""
    if abs(len(x) - len(y)) > most:
        return False
    least, at_most = bounds(x, y, most)
    if least > most or at_most <= most:
        return at_most <= most
    return banded_distance(x.tolist(), y.tolist(), most) <= most


def all_within(lists: list, i, j, most):
    """within() of each pair (lists[i], lists[j]) and its `most`; texts of up to WIDE words many pairs at a time."""
    import numpy as np

    n = np.array([len(x) for x in lists])
    wide = np.maximum(n[i], n[j]) > WIDE
    ok = np.zeros(len(i), bool)
    for p in np.flatnonzero(wide):
        ok[p] = within(lists[i[p]], lists[j[p]], int(most[p]))
    some = np.flatnonzero(~wide)
    ok[some] = distances(lists, i[some], j[some], most[some]) <= most[some]
    return ok


def distances(lists: list, i, j, most):
    """many_distances() of each pair (lists[i], lists[j]) and its `most`, some STEP comparisons a step."""
    import numpy as np

    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    n = np.array([len(x) for x in lists])
    used = np.unique([i, j])
    words = np.unique(np.concatenate([lists[x] for x in used]), return_inverse=True)[1]
    words = words.astype(np.int16 if not len(words) or words.max() < 1 << 15 else np.int32)
    starts = np.zeros(len(lists), np.int64)
    starts[used] = np.cumsum(n[used]) - n[used]
    size = np.maximum(n[i], n[j]) + 64
    order = np.argsort(size, kind="stable")
    ends = np.cumsum(size[order])
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP)))
        p = order[at:to]
        out[p] = many_distances(words, starts[i[p]], n[i[p]], starts[j[p]], n[j[p]], int(most[p].max()))
        at = to
    return out


def many_distances(words, x, n, y, m, most):
    """Edit distances of the stretches words[x : x + n] and words[y : y + m] of a row of numbers from 0, for arrays x, n, y and m,
    where they are at most `most` (a number); others come out as more than that.

    The bit-parallel alignment of all pairs; a column of a pair is one column of 64-bit integers, the lowest first. Only integers
    within `most` of the diagonal are looked at: above them each column is taken to be one more than the last, below them each row.
    """
    import numpy as np

    if not len(x):
        return n
    size = max(1, -(-int(n.max()) // 64))
    place = np.arange(64 * size)
    a = np.where(place < n[:, None], words[np.minimum(x[:, None] + place, len(words) - 1)] if len(words) else words.dtype.type(-1), words.dtype.type(-1))
    row, last, end = np.arange(len(x)), np.maximum(n - 1, 0) // 64, (np.maximum(n - 1, 0) % 64).astype(np.uint64)
    one, high = np.uint64(1), np.uint64(63)
    vps, vns = np.full((size, len(x)), ~np.uint64(0)), np.zeros((size, len(x)), np.uint64)
    low, top, score = 0, 0, np.minimum(n, 64)
    for step in range(int(m.max())):
        low = max(0, step - most) // 64
        if low >= size:
            break
        while top < min(size - 1, (step + most) // 64):
            top += 1
            score = score + np.clip(n - 64 * top, 0, 64)
        vp, vn = vps[low : top + 1], vns[low : top + 1]
        b = words[np.minimum(y + step, len(words) - 1)]
        match = np.packbits(a[:, 64 * low : 64 * top + 64] == b[:, None], axis=1, bitorder="little").view("<u8").T.copy()
        total = (match & vp) + vp
        if top > low:  # carries from integer to integer
            over, carry = total < vp, np.zeros(len(x), bool)
            for k in range(1, top + 1 - low):
                carry |= over[k - 1]
                total[k] += carry
                carry &= total[k] == 0
        d0 = (total ^ vp) | match | vn
        hp, hn = vn | ~(d0 | vp), vp & d0
        at, bit = np.clip(last - low, 0, top - low), np.where(last <= top, end, high)
        change = (hp[at, row] >> bit & one).astype(np.int64) - (hn[at, row] >> bit & one).astype(np.int64)
        score = score + np.where(step < m, np.where(last < low, 1, change), 0)
        up, un = hp << one, hn << one
        up[0] |= one
        up[1:] |= hp[:-1] >> high
        un[1:] |= hn[:-1] >> high
        vps[low : top + 1], vns[low : top + 1] = un | ~(d0 | up), up & d0
    else:
        return np.where(n == 0, m, np.where(last > top, most + 1, score))
    return np.where(n == 0, m, np.where((last > top) | (m > step), most + 1, score))


def alike(a: str, b: str, similarity: float) -> bool:
    import pyarrow as pa

    x, y = word_lists(pa.array([a, b]))
    return within(x, y, allowed(max(len(x), len(y)), similarity))


def sketched(docs: DataFrame, k: int, picked: int, count: int) -> DataFrame:
    """(node, words, bag, sketches) of docs (node, text) that have words."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        forget()
        for batch in batches:
            for at, some in chunks(batch.column(1)):
                words = Words(some)
                owner, found = sketches(words, k, picked, count)
                offsets = np.searchsorted(owner, np.arange(len(some) + 1)).astype(np.int32)
                n = np.diff(words.offsets)
                columns = [batch.column(0).slice(at, len(some)), pa.array(n.astype(np.int32)), pa.array([b.tobytes() for b in bags(words)], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "words", "bag", "sketches"]).filter(pa.array(n > 0))

    return docs.select("node", "text").mapInArrow(run, "node long, words int, bag binary, sketches array<long>")


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the bags of their texts don't rule out."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, x, m, y = (batch.column(i) for i in range(2, 6))
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BAG) for c in (x, y))
            ok = may_be_near(x, y, n.to_numpy().astype(int), m.to_numpy().astype(int), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], ["a", "b"])

    of = lambda c, n, x: nodes.select(F.col("node").alias(c), F.col("words").alias(n), F.col("bag").alias(x))
    both = pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b")
    return both.select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def in_tasks(rows: DataFrame, work, schema: str, names: list[str]) -> DataFrame:
    """work(columns) over the rows of each task, in order of side: rows (task, side, node, ...); it yields lists of arrays.

    A task's rows are few enough for one worker's memory.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        forget()
        held, task = [], None
        for batch in batches:
            tasks = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], tasks[1:] != tasks[:-1]])) if len(tasks) else []
            for a, b in zip(edge, [*edge[1:], len(tasks)]):
                if tasks[a] != task and held:
                    yield from map(done, work(pa.Table.from_batches(held)))
                    held = []
                task = tasks[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from map(done, work(pa.Table.from_batches(held)))

    def done(columns):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows.repartition("task").sortWithinPartitions("task", "side").mapInArrow(run, schema)


def across(side, width: int):
    """(i, j) of each pair to compare among rows in order of side, CELLS / width at a time: every two rows of side 0, or each of
    side 1 with each of side 2."""
    import numpy as np

    n, first = len(side), int(np.searchsorted(side, 2))
    begin = np.where(np.arange(n) < first, first, n) if side[0] else np.arange(1, n + 1)
    size = n - begin
    at, ends = 0, np.cumsum(size)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS // width)))
        i = np.repeat(np.arange(at, to), size[at:to])
        yield i, np.repeat(begin[at:to] - (np.cumsum(size[at:to]) - size[at:to]), size[at:to]) + np.arange(len(i))
        at = to


def in_blocks(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(task, side, columns): tasks in which each two rows of equal `by` meet once, with no more than some 2 * BLOCK rows each.

    n of them fall into n / BLOCK blocks by node; each block meets each.
    """
    sizes = rows.groupBy(by).agg((F.count(F.lit(1)) / BLOCK).cast("int").alias("more")).where("more > 0")
    rows = rows.join(sizes, by, "left").withColumn("more", F.coalesce("more", F.lit(0)))
    rows = rows.withColumn("i", F.expr("pmod(xxhash64(node, 7), more + 1)")).withColumn("j", F.explode(F.expr("sequence(0L, cast(more as bigint))")))
    return rows.select(F.xxhash64(by, F.least("i", "j"), F.greatest("i", "j")).alias("task"), F.expr("case when i = j then 0 when i < j then 1 else 2 end").alias("side"), *columns)


def apart(members: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), a < b, of members (bucket, node, words, bag, g) of one bucket and two groups that their bags don't rule out."""

    def work(rows) -> Iterator:
        import numpy as np

        side, node, n, g = (rows.column(i).to_numpy() for i in (1, 2, 3, 5))
        bag = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(-1, BAG)
        for i, j in across(side, BAG):
            other = g[i] != g[j]
            i, j = i[other], j[other]
            ok = may_be_near(bag[i], bag[j], n[i].astype(int), n[j].astype(int), similarity)
            a, b = node[i[ok]], node[j[ok]]
            yield np.minimum(a, b), np.maximum(a, b)

    blocks = in_blocks(members, "bucket", ["node", "words", "bag", "g"])
    return in_tasks(blocks, work, "a long, b long", ["a", "b"]).distinct()


def word_lists(texts):
    """The word hashes of each text of an Arrow array."""
    out = []
    for _, some in chunks(texts):
        words = Words(some)
        out += [words.hash[words.text(i)] for i in range(len(some))]
    return out


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are within the edit similarity. A task has one text a and up to some 2 * BLOCK texts b."""

    def work(rows) -> Iterator:
        import numpy as np

        node, lists = rows.column(2).to_numpy(), word_lists(rows.column(3))
        ok = [within(lists[0], x, allowed(max(len(lists[0]), len(x)), similarity)) for x in lists[1:]]
        b = node[1:][np.array(ok, bool)]
        yield np.full(len(b), node[0]), b

    many = pairs.groupBy("a").agg((F.count(F.lit(1)) / BLOCK).cast("int").alias("more"))
    dealt = pairs.join(many, "a").select("a", "b", F.expr("xxhash64(a, pmod(xxhash64(b), more + 1))").alias("task"))
    rows = dealt.select("task", F.lit(0).alias("side"), F.col("a").alias("node")).distinct().unionByName(dealt.select("task", F.lit(1).alias("side"), F.col("b").alias("node")))
    return in_tasks(rows.join(texts, "node").select("task", "side", "node", "text"), work, "a long, b long", ["a", "b"])


def against(x, y):
    """y laid along x: for each place of x the word of y that one alignment puts there or 0, and how many words of y find no place.

    The alignment is that of equal beginnings and ends and of bounds().
    """
    import numpy as np

    out = np.zeros(len(x), np.int64)
    i, j, level, wide = aligned(x, y)
    inner = np.arange(1, len(i) - 1)
    out[i[inner]] = y[j[inner]]
    at = np.repeat(i[level] + 1 - (np.cumsum(wide[level]) - wide[level]), wide[level]) + np.arange(wide[level].sum())
    out[at] = y[at + np.repeat(j[level] - i[level], wide[level])]
    return out, len(y) - len(inner) - len(at)


def aligned(x, y):
    """Anchors (i, j) of an alignment with (-1, -1) and the ends around them, the gaps as wide as high, and each gap's width."""
    import numpy as np

    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    front = n if same.all() else int(same.argmin())
    same = x[len(x) - n + front :][::-1] == y[len(y) - n + front :][::-1]
    back = n - front if same.all() else int(same.argmin())
    a, b = x[front : len(x) - back], y[front : len(y) - back]
    i, j = anchors(a, b, max(len(a), len(b)))
    i = np.concatenate([[-1], np.arange(front), i + front, np.arange(len(x) - back, len(x) + 1)])
    j = np.concatenate([[-1], np.arange(front), j + front, np.arange(len(y) - back, len(y) + 1)])
    wide, high = np.diff(i) - 1, np.diff(j) - 1
    return i, j, np.flatnonzero((wide == high) & (wide > 0)), wide


def linked(side, lists: list, similarity: float):
    """How many others each text of a task is near, by the rules of across().

    One from their middle is aligned with each. Two whose distances from it are few enough edits in all are near. So are two that
    differ in few enough places when laid along it; two whose words alone are too many edits apart aren't. The others are aligned.
    """
    import numpy as np

    n = np.array([len(x) for x in lists])
    owner = np.repeat(np.arange(len(lists)), n)
    slot = (np.concatenate(lists).view(np.uint64) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    bag = np.minimum(np.bincount(owner * BINS + slot, minlength=len(lists) * BINS), 255).astype(np.uint8).reshape(-1, BINS)
    middle = int(np.abs(bag - np.median(bag, 0)).sum(1).argmin())
    head = lists[middle]
    along, extra = zip(*(against(head, x) for x in lists))
    along, extra = np.stack(along), np.array(extra)
    away = (along != head).sum(1) + extra
    if max(n) <= WIDE:
        every = np.arange(len(lists))
        away = np.minimum(away, distances(lists, np.full(len(lists), middle), every, allowed(np.maximum(n, len(head)), similarity)))
    links = np.zeros(len(lists), np.int64)
    for i, j in across(side, max(1, len(head), BINS)):
        most = allowed(np.maximum(n[i], n[j]), similarity)
        near = away[i] + away[j] <= most
        left = np.flatnonzero(~near)
        left = left[may_be_near(bag[i[left]], bag[j[left]], n[i[left]], n[j[left]], similarity)]
        near[left] = (along[i[left]] != along[j[left]]).sum(1) + extra[i[left]] + extra[j[left]] <= most[left]
        left = left[~near[left]]
        near[left] = all_within(lists, i[left], j[left], most[left])
        links += np.bincount(i[near], minlength=len(lists)) + np.bincount(j[near], minlength=len(lists))
    return links


def counted_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, links): how many other texts of its group each text of members (group, node) is near."""

    def work(rows) -> Iterator:
        side, node = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        yield node, linked(side, word_lists(rows.column(3)), similarity)

    rows = in_blocks(members, "group", ["node"]).join(texts, "node").select("task", "side", "node", "text")
    return in_tasks(rows, work, "node long, links long", ["node", "links"]).groupBy("node").agg(F.sum("links").alias("links"))


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, group): the least node of each node's connected component, for nodes with an edge. edges: (a, b), a <> b.

    Alternating large-star and small-star steps, each written, until the edges stay as they are.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    state, step = None, 0
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("group"))
        state, step = seen, step + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = scratch.write(small.distinct(), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, picked: int = PICKED, count: int = SKETCHES, links: bool = False) -> DataFrame:
    """(doc_id, row, group, kept) for every row of docs; row is a hash of its text. With `links`, also their number.

    group: the least doc_id of the row's group, which joins all texts connected by verified pairs; kept: whether the row is
    the one that stays, the first by doc_id and row. Texts count as near copies if the edit distance of their words is at
    most 1 - similarity of the longer one's words, and are found if they share a whole sketch; equal texts always are. Words are what
    the six white space characters of ASCII separate; others, such as U+00A0, belong to words. Within
    a bucket every text is aligned with the bucket's first; pairs that this leaves in different groups are then all compared
    too, so the groups are those that aligning every pair of every bucket would give, whatever the bucket's size. links: how many
    other texts of the group are near the row's, shared sketch or not; equal texts are one text and no link, and have as many links
    each. Their count compares each two texts of a group, in blocks.

    Null texts are alone in their groups and stay; texts without words are copies only of equal texts. Rows without doc_id come after
    all others; where a group has no others its `group` is null. Repeated rows (same doc_id and text) come
    back alike; a caller that keeps rows drops the repeats. Texts are equal if 128 bits of hashes are; one that shares 64 of
    them with another alone stays, in a group of its own. Other columns are ignored. The groups are found when this is called, not when the result is read.
    """
    scratch = Scratch(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("node", F.xxhash64("text"))
    whole = docs.where("text is not null")
    known = scratch.write(sketched(whole, k, picked, count), "sketches")
    nodes = scratch.write(known.dropDuplicates(["node"]), "nodes")
    scratch.drop("sketches")
    slots = nodes.select("node", F.explode("sketches").alias("bucket"))
    first = slots.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("bucket", "a")
    stars = scratch.write(slots.join(first, "bucket").where("node <> a").select("bucket", "a", F.col("node").alias("b")), "stars")
    nodes = scratch.write(nodes.select("node", "words", "bag"), "bags")
    scratch.drop("nodes")
    pairs = scratch.write(possible(stars.select("a", "b").distinct(), nodes, similarity), "pairs")
    texts = texts_of(scratch, whole, stars)
    edges = scratch.write(verified(pairs, texts, similarity), "edges")
    groups = components(scratch, edges, "first")
    # What the stars left apart: pairs of one bucket and two groups.
    group_of = lambda c: groups.select(F.col("node").alias(c), F.col("group").alias(f"g{c}"))
    g = lambda c: F.coalesce(F.col(f"g{c}"), F.col(c))
    split = scratch.write(stars.join(group_of("a"), "a", "left").join(group_of("b"), "b", "left").select("bucket", "a", "b", g("a").alias("ga"), g("b").alias("gb")), "split")
    scratch.drop("stars")
    open_ = split.where("ga <> gb").select("bucket").distinct()
    others = split.join(open_, "bucket", "left_semi")
    heads = others.select("bucket", F.col("a").alias("node"), F.col("ga").alias("g")).distinct()
    members = heads.unionByName(others.select("bucket", F.col("b").alias("node"), F.col("gb").alias("g")))
    left = scratch.write(apart(members.join(nodes, "node").select("bucket", "node", "words", "bag", "g"), similarity), "left")
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.write(left.join(done, ["a", "b"], "left_anti"), "rest")
    scratch.drop("split", "left", "pairs", "bags")
    more = scratch.write(verified(rest, texts, similarity), "more")
    scratch.drop("rest")
    groups = components(scratch, edges.unionByName(more), "all")
    id_ = F.coalesce("doc_id", F.lit(LAST))
    rows = whole.select("doc_id", "node", F.xxhash64("text", F.lit(1)).alias("check"))
    real = rows.groupBy("node").agg(F.min("check").alias("check"))
    found = rows.join(groups, "node", "left").join(real.select("node", F.col("check").alias("real")), "node")
    found = scratch.write(found.select("doc_id", "node", (F.col("check") == F.col("real")).alias("same"), F.coalesce("group", "node").alias("g")), "found")
    place = F.struct(id_.alias("id"), "node")
    heads = found.where("same").groupBy("g").agg(F.min(place).alias("head"))
    label = F.when(F.col("head.id") < LAST, F.col("head.id"))
    out = found.where("same").join(heads, "g").select("doc_id", F.col("node").alias("row"), label.alias("group"), (place == F.col("head")).alias("kept"))
    alone = found.where("not same").select("doc_id", F.col("node").alias("row")).unionByName(docs.where("text is null").select("doc_id", F.col("node").alias("row")))
    out = out.unionByName(alone.select("doc_id", "row", F.col("doc_id").alias("group"), F.lit(True).alias("kept")))
    if not links:
        scratch.drop("texts")
        return out
    members = groups.unionByName(groups.select(F.col("group").alias("node"), "group").distinct())
    n = scratch.write(counted_links(members, texts, similarity), "links")
    scratch.drop("texts")
    return out.join(n.select(F.col("node").alias("row"), "links"), "row", "left").select("doc_id", "row", "group", F.coalesce("links", F.lit(0)).alias("links"), "kept")


def texts_of(scratch: Scratch, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of each text in the pairs (a, b), written."""
    used = scratch.write(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "used")
    if used.count() <= SENT_NAMES:
        used = F.broadcast(used)
    return scratch.write(docs.join(used, "node", "left_semi").dropDuplicates(["node"]).select("node", "text"), "texts")


def op8_ordermin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), links=True).drop("row")


QUERIES = {"op8_ordermin": op8_ordermin}
SQL: dict[str, str] = {}
