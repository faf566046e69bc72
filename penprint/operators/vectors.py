"""Style vectors: assembly from a profile, normalization, means by author, and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .local import best

TAGS = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split()
SIZE = 128
LOGGED = (10, 11, 12, 14, 78, 79)

#: Stored vectors in one block of a blocked search, queries of one task at most, queries whose products are taken together, and pairs
#: that are taken in double precision together.
BLOCK = 512
QUERIES = 1 << 15
CHUNK = 2048
PAIRS = 1 << 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once: what a lambda names from outside is evaluated again for each element."""
    return F.get(F.transform(F.array(x), lambda y: f(y)), F.lit(0))


def l2_normalize(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    over = lambda v, norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
    return once(v.cast("array<double>"), lambda v: once(F.sqrt(dot(v, v)), lambda norm: over(v, norm)))


def style_vector(profile: DataFrame, aligned: list[str] | None = None) -> Column:
    """128 numbers of a profile row, logged where skewed and of length 1.

    A group that is null counts as zeros. Function words fill 30 places in alphabetical order of the document's own words; with
    `aligned`, one place for each word of that list (30 at most), so that places mean the same in every document.
    """
    has = set(profile.columns)
    zero = F.lit(0.0)

    def get(group: str, *fields: str) -> list[Column]:
        return [F.coalesce(F.col(f"{group}.{f}").cast("double"), zero) if group in has else zero for f in fields]

    def lookup(group: str, field: str, keys: list[str]) -> list[Column]:
        if group not in has:
            return [zero] * len(keys)
        pairs = F.col(f"{group}.{field}")
        named = lambda k: lambda e: e["key"] == k  # noqa: E731 (a second parameter would be the place)
        return [F.coalesce(F.get(F.filter(pairs, named(k)), F.lit(0))["count"].cast("double"), zero) for k in keys]

    per = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    (count,), (types, total) = get("sentences", "count"), get("vocabulary", "unique_types", "total_tokens")
    parts = [
        *get("readability", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "coleman_liau", "ari", "smog"),
        *get("sentences", "mean_length", "median_length", "stdev_length", "skewness"), per(count * 1000, F.col("word_count").cast("double")),
        *get("vocabulary", "ttr", "hapax_ratio", "yules_k", "honores_r"), per(types, total),
        *lookup("pos", "tag_distribution", TAGS), *get("pos", "adjective_noun_ratio", "adverb_density", "verb_density"),
    ]
    head = F.array(*parts)
    if aligned is not None:
        words = F.array(*lookup("function_words", "frequencies", aligned[:30]), *[zero] * (30 - len(aligned[:30])))
    elif "function_words" in has:
        rates = F.transform(F.array_sort(F.col("function_words.frequencies")), lambda e: e["count"].cast("double"))
        words = F.slice(F.concat(F.coalesce(rates, F.array().cast("array<double>")), F.array_repeat(zero, 30)), 1, 30)
    else:
        words = F.array_repeat(zero, 30)
    marks = "comma period semicolon colon dash exclamation question ellipsis parenthesis quotation".split()
    tail = F.array(
        *get("punctuation", *marks), *get("contractions", "rate_per_1000"), *get("sentence_openers", "conjunction_start_rate"),
        *get("paragraphs", "mean_length", "median_length", "one_sentence_ratio"), *get("dialogue", "quoted_word_ratio"),
        *get("syntax", "mean_tree_depth", "median_tree_depth", "stdev_tree_depth"), *lookup("syntax", "tense_distribution", ["Past", "Pres", "None"]),
    )
    whole = F.concat(head, words, tail, F.array_repeat(zero, SIZE - 88))
    logged = F.transform(whole, lambda x, i: F.when(i.isin(*LOGGED) & (x > 0), F.log1p(x)).otherwise(x))
    return l2_normalize(logged)


def centroids(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, doc_count, mean_vector): element-wise means; doc_count counts rows without a vector too."""
    cells = rows.select(by, F.posexplode_outer(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = cells.where("i is not null").groupBy(by, "i").agg(F.avg("x").alias("x")).groupBy(by)
    means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("mean_vector"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("doc_count")).join(means, by, "left")


def blocks(rows: DataFrame, id_col: str, vector: str, block: int, groups: int = 1) -> DataFrame:
    """(g, ids, vectors): blocks of vectors as bytes, of rows whose ids fall in the same group. Null ids and vectors are left out."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            g = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(groups)
            for k in np.unique(g):
                own = np.flatnonzero(g == k)
                for at in range(0, len(own), block):
                    some = own[at : at + block]
                    yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([ids[some].tobytes()]), pa.array([x[some].tobytes()])], ["g", "ids", "vectors"])

    kind = rows.schema[vector].dataType.simpleString()
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    return rows.where("id is not null and v is not null").mapInArrow(run, "g int, ids binary, vectors binary")


def units(raw: bytes, n: int, single: bool):
    """n vectors from their bytes as rows of length 1, zero vectors as they are; and which of them are numbers throughout."""
    import numpy as np

    x = np.frombuffer(raw, np.float32 if single else np.float64).reshape(n, -1).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None], np.isfinite(norm)


class Search:
    """The k most similar of the stored vectors met so far, for a group of queries.

    Products of single precision only leave out what can't be among the k best; all others are taken again in double precision.
    """

    def __init__(self, ids, x, k: int, same: bool):
        import numpy as np

        self.ids, self.x, self.x32, self.k, self.same = ids, x, x.astype(np.float32), k, same
        self.s, self.n = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.limit = np.full(len(ids), -np.inf, np.float32)  # what a product must reach to matter
        self.error = (x.shape[1] + 8) * 2.0**-23  # more than single precision can be off for vectors of length 1
        self.held, self.waiting = [], 0

    def meet(self, ids, y) -> None:
        import numpy as np

        y32 = y.astype(np.float32)
        for at in range(0, len(self.ids), CHUNK):
            own = slice(at, at + CHUNK)
            s, limit = self.x32[own] @ y32.T, self.limit[own]
            if np.isneginf(limit).any():
                if self.same:
                    s[self.ids[own, None] == ids] = -9
                if len(ids) >= self.k:
                    limit = self.limit[own] = np.maximum(limit, np.partition(s, -self.k, axis=1)[:, -self.k] - 2 * self.error)
            rows = np.flatnonzero(s.max(axis=1) >= limit)
            q, j = np.nonzero(s[rows] >= limit[rows, None])
            q = rows[q] + at
            for k in range(0, len(q), PAIRS):
                a, b = q[k : k + PAIRS], j[k : k + PAIRS]
                if self.same:
                    other = self.ids[a] != ids[b]
                    a, b = a[other], b[other]
                self.held.append((a, np.einsum("ij,ij->i", self.x[a], y[b]), ids[b]))
                self.waiting += len(a)
                if self.waiting > max(PAIRS, self.s.size // 2):
                    self.settle()

    def settle(self) -> None:
        """Takes the waiting pairs in among the best."""
        import numpy as np

        if not self.waiting:
            return
        q, s, n = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.waiting = [], 0
        some = np.unique(q)
        q = np.concatenate([np.repeat(some, self.k), q])
        s, n = np.concatenate([self.s[some].ravel(), s]), np.concatenate([self.n[some].ravel(), n])
        which, rank = best(q, n, np.round(s, 12), self.k)
        self.s[q[which], rank - 1], self.n[q[which], rank - 1] = s[which], n[which]
        self.limit[some] = np.maximum(self.limit[some], self.s[some, -1] - 2 * self.error)

    def found(self):
        """(query, neighbour, s, rank) in order of query and rank; rows that repeat an id are one query."""
        import numpy as np

        self.settle()
        some = np.flatnonzero(self.s.ravel() > -np.inf)
        q, s, n = self.ids[some // self.k], self.s.ravel()[some], self.n.ravel()[some]
        which, rank = best(q, n, np.round(s, 12), self.k)
        return q[which], n[which], s[which], rank


def nearest(queries: DataFrame, store: DataFrame, k: int, query_id: str, store_id: str, vector: str, same: bool = False, block: int = BLOCK) -> DataFrame:
    """(query, neighbour, similarity, rank): each query's k most similar stored vectors by cosine, 4 digits; ties by id.

    Exact: a task has one group of queries and meets the whole store block by block, so it holds no more than its queries, their best
    and a block. same: both sides are one table, and a row isn't its own neighbour. Null and NaN vectors and null ids are left out.
    """
    spark = queries.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    n = queries.where(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).count()
    groups = max(1, min(tasks * -(-n // (QUERIES * tasks)), n))
    single = [d.schema[vector].dataType.simpleString() == "array<float>" for d in (queries, store)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        given, search = [], None
        for batch in batches:
            for stored, ids, raw in zip(batch.column(1), batch.column(2), batch.column(3)):
                stored, ids = stored.as_py(), np.frombuffer(ids.as_py(), np.int64)
                x, ok = units(raw.as_py(), len(ids), single[stored])
                if not stored:
                    given.append((ids[ok], x[ok]))
                elif given:
                    search = search or Search(*(np.concatenate(c) for c in zip(*given)), k, same)
                    search.meet(ids[ok], x[ok])
        if search:
            out = [pa.array(c) for c in search.found()]
            for at in range(0, len(out[0]), PAIRS):
                yield pa.RecordBatch.from_arrays([c.slice(at, PAIRS) for c in out], ["query", "neighbour", "s", "rank"])

    left = blocks(queries, query_id, vector, block, groups).select("g", F.lit(0).alias("stored"), "ids", "vectors")
    right = blocks(store, store_id, vector, block).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("stored"), "ids", "vectors")
    met = left.unionByName(right).repartitionById(groups, F.col("g")).sortWithinPartitions("stored")
    found = met.mapInArrow(run, "query long, neighbour long, s double, rank long")
    return found.select("query", "neighbour", F.round("s", 4).alias("similarity"), "rank")
