"""Counts within documents. A document is one row, so its counts need no shuffle: an Arrow batch's lists are counted together in numpy."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk

#: Items of lists, or characters of text, that are counted at one time; a longer document is counted on its own.
ITEMS = 1 << 20


def tokens_of(text: Column, elided: bool = False) -> Column:
    """All tokens of a text in order, contractions in two."""
    return F.when(F.contains(text, F.lit("'")), tk.pieces(text, elided)).otherwise(F.regexp_extract_all(text, F.lit(tk.TOKEN), F.lit(0)))


def words_of(text: Column, elided: bool = False) -> Column:
    """The lower-case words of a text in order, contractions in two."""
    low = F.lower(text)
    return F.when(F.contains(text, F.lit("'")), F.filter(tk.pieces(low, elided), lambda t: t.rlike(r"^'?[\p{L}\p{N}]"))).otherwise(F.regexp_extract_all(low, F.lit(tk.WORDS), F.lit(0)))


def sentence_sizes(docs: DataFrame, elided: bool = False) -> DataFrame:
    """(doc_id, sent_id, len): tokens of each sentence."""
    sizes = F.transform(tk.sentences(F.col("text")), lambda s: F.size(tokens_of(s, elided)).cast("long"))
    return docs.select("doc_id", F.posexplode(sizes).alias("sent_id", "len"))


def openers_of(text: Column, elided: bool = False) -> Column:
    """Each sentence's first token in lower case."""
    first = lambda s: F.get(tk.pieces(F.regexp_extract(s, tk.TOKEN, 0), elided), F.lit(0))
    return F.transform(tk.sentences(text), lambda s: F.lower(F.when(F.contains(s, F.lit("'")), first(s)).otherwise(F.regexp_extract(s, tk.TOKEN, 0))))


def parts(ends) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about ITEMS items together; ends: items up to each row's end."""
    import numpy as np

    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ITEMS)))
        yield at, to
        at = to


def text_parts(texts) -> Iterator[tuple[int, int]]:
    """Ranges of rows of an Arrow string array that have about ITEMS bytes together; a longer text is on its own."""
    import numpy as np
    import pyarrow.compute as pc

    yield from parts(np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)))


def grouped(doc, key):
    """(order, starts, counts): rows by document and key, in order of place within each; where each group starts, and its size."""
    import numpy as np

    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])) if len(order) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(order)))


def best(doc, first, counts, n: int):
    """(which, rank): each document's n most frequent groups in rank order, ties by first place; groups lie by document."""
    import numpy as np

    by = np.lexsort((first, -counts, doc))
    d = doc[by]
    begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    rank = np.arange(len(d)) - np.repeat(begin, np.diff(np.append(begin, len(d)))) + 1
    return by[rank <= n], rank[rank <= n]


def coded(lists):
    """(document, code, names) of the items of an Arrow list array, nulls as empty lists."""
    import numpy as np

    names = lists.flatten().dictionary_encode()
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary, sizes


def top_items(lists: DataFrame, n: int, size: int = 1, name: str = "gram") -> DataFrame:
    """(doc_id, rank, name, cnt): of lists (doc_id, array of strings) the n most frequent runs of `size` items, joined by spaces.

    Rank by count, ties by first place. Null items and null lists count as none.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ends = np.cumsum(np.nan_to_num(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            for a, b in parts(ends):
                doc, code, names, _ = coded(batch.column(1).slice(a, b - a))
                m = max(0, len(doc) - size + 1)
                at = np.flatnonzero(doc[:m] == doc[size - 1 :][:m]) if m else np.zeros(0, np.int64)
                key = np.zeros(len(at), np.int64)
                for k in range(size):
                    key = key * len(names) + code[at + k]
                order, starts, counts = grouped(doc[at], key)
                first = at[order[starts]]
                which, rank = best(doc[first], first, counts, n)
                words = [names.take(pa.array(code[first[which] + k])) for k in range(size)]
                gram = words[0] if size == 1 else pc.binary_join_element_wise(*words, " ")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc[first[which]])), pa.array(rank), gram, pa.array(counts[which])], ["doc_id", "rank", name, "cnt"])

    lists = lists.toDF("doc_id", "items").withColumn("items", F.array_compact("items"))
    return lists.mapInArrow(run, f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, rank long, `{name}` string, cnt long")


def top_characters(texts: DataFrame, n: int, size: int = 3) -> DataFrame:
    """(doc_id, rank, gram, cnt): of texts (doc_id, text) the n most frequent runs of `size` characters (3 at most)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in parts(np.cumsum(sizes)):
                points = np.frombuffer("".join(text.slice(a, b - a).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
                doc = np.repeat(np.arange(b - a), sizes[a:b])
                m = max(0, len(points) - size + 1)
                at = np.flatnonzero(doc[:m] == doc[size - 1 :][:m]) if m else np.zeros(0, np.int64)
                key = np.zeros(len(at), np.int64)
                for k in range(size):
                    key = key << 21 | points[at + k]
                order, starts, counts = grouped(doc[at], key)
                first = at[order[starts]]
                which, rank = best(doc[first], first, counts, n)
                some = points[first[which][:, None] + np.arange(size)].astype("<u4")
                whole = some.tobytes().decode("utf-32-le")
                gram = pa.array([whole[i : i + size] for i in range(0, len(whole), size)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc[first[which]])), pa.array(rank), gram, pa.array(counts[which])], ["doc_id", "rank", "gram", "cnt"])

    texts = texts.toDF("doc_id", "text")
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, rank long, gram string, cnt long")


def kinds(lists: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, item, cnt, total): how often each item occurs in its list, and the list's length; only items of `keep`, if given."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ends = np.cumsum(np.nan_to_num(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            for a, b in parts(ends):
                doc, code, names, sizes = coded(batch.column(1).slice(a, b - a))
                if keep is not None:
                    wanted = pc.is_in(names, pa.array(keep)).to_numpy(zero_copy_only=False)
                    some = np.flatnonzero(wanted[code]) if len(code) else np.zeros(0, np.int64)
                    doc, code = doc[some], code[some]
                order, starts, counts = grouped(doc, code)
                here = order[starts]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc[here])), names.take(pa.array(code[here])), pa.array(counts), pa.array(sizes[doc[here]])], ["doc_id", "item", "cnt", "total"])

    lists = lists.toDF("doc_id", "items")
    return lists.mapInArrow(run, f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, item string, cnt long, total long")


def richness(lists: DataFrame) -> DataFrame:
    """(doc_id, n, v, v1, ff): items, different ones, those that occur once, and the sum of squared counts of each list that isn't empty."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ends = np.cumsum(np.nan_to_num(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            for a, b in parts(ends):
                doc, code, _, sizes = coded(batch.column(1).slice(a, b - a))
                order, starts, counts = grouped(doc, code)
                own = doc[order[starts]]
                some = np.flatnonzero(sizes)
                sums = [np.bincount(own, x, b - a)[some].astype(np.int64) for x in (counts, np.ones(len(own)), counts == 1, counts * counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + some)), *(pa.array(x) for x in sums)], ["doc_id", "n", "v", "v1", "ff"])

    lists = lists.toDF("doc_id", "items")
    return lists.mapInArrow(run, f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, n long, v long, v1 long, ff long")
