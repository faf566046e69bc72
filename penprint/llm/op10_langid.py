"""Operator 10: language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, read

#: Longest n-gram, n-grams in a profile, and the bound on labelled rows that each language's profile is trained on.
LONGEST = 3
TOP = 300
TRAIN_ROWS = 2000

#: A text is rejected if its distance is over this share of the greatest possible one from every language.
MAX_SHARE = 0.65

UNKNOWN = "und"


def plain(text):
    """Lower case, every run of characters that aren't letters one space, and a space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def grams(texts: list[str], owner=None):
    """N-grams of plain texts: symbols, width, and by owner and gram in order: owner, gram key, count.

    A gram has no space inside it and isn't a space alone. A key holds LONGEST symbol numbers, 0 where the gram has ended, so
    that keys are ordered like the grams' code points. owner: what each text counts for; itself by default.
    """
    import numpy as np

    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    symbols = np.unique(cps)
    width = len(symbols) + 1
    table = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int64)
    table[symbols] = np.arange(1, width)
    code = table[cps]
    own = np.repeat(np.arange(len(texts)) if owner is None else np.asarray(owner), lengths)
    text = np.repeat(np.arange(len(texts)), lengths)
    space = cps == 32
    parts = []
    for n in range(1, LONGEST + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        ok = text[:m] == text[n - 1 :]
        if n == 1:
            ok &= ~space
        for j in range(1, n - 1):
            ok &= ~space[j : j + m]
        if n == 2:
            ok &= ~(space[:m] & space[1:])
        key = own[:m].copy()
        for j in range(LONGEST):
            key *= width
            if j < n:
                key += code[j : j + m]
        parts.append(key[ok])
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    span = width**LONGEST
    return symbols, width, keys // span, keys % span, count


def ranked(owner, count, top: int):
    """Indices of each owner's `top` most frequent grams, by owner and rank, and the ranks from 0. Ties: by gram."""
    import numpy as np

    order = np.lexsort((-count, owner))  # stable: ties keep the order of the grams
    starts = np.searchsorted(owner, owner)  # owners come sorted
    rank = np.arange(len(order)) - starts[order]
    keep = rank < top
    return order[keep], rank[keep]


def profiles(docs: DataFrame, top: int = TOP, rows: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """Each language's most frequent n-grams, most frequent first, from at most `rows` labelled documents of it.

    The sample is the documents whose MD5 of doc_id is least, so it doesn't hang on partitions. Rows without a language or an
    id aren't sampled. The result is as large as languages times `top`.
    """
    label = F.col("lang").cast("string")
    ids = docs.select(F.col("doc_id").alias("__id"), label.alias("__lang")).where("__id is not null and __lang is not null")
    place = F.row_number().over(Window.partitionBy("__lang").orderBy(F.md5(F.col("__id").cast("string")), "__id"))
    # At most `rows` rows a language: bounded whatever the table's size.
    sample = ids.withColumn("__k", place).where(F.col("__k") <= rows).select("__id", "__lang").distinct()
    texts = docs.select("doc_id", plain(F.col("text").cast("string")).alias("__t")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for at, some in chunks(batch.column(1)):
                symbols, width, own, key, n = grams(some.to_pylist(), langs.indices.to_numpy()[at : at + len(some)])
                chars = np.array([""] + [chr(c) for c in symbols], object)
                gram = np.full(len(key), "", object)
                for j in range(LONGEST):
                    gram += chars[key // width ** (LONGEST - 1 - j) % width]
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(own)), pa.array(gram, pa.string()), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = texts.select("__lang", "__t").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= top)
    found: dict[str, list[str]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["k"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return found


def identify(docs: DataFrame, known: dict[str, list[str]], top: int = TOP, max_share: float = MAX_SHARE) -> DataFrame:
    """Every column of docs plus predicted, grams, distance and accepted.

    grams: n-grams in the text's own profile, `top` at most; distance: the sum of their out-of-place distances from the
    nearest language (`top` for a gram that its profile lacks); predicted: that language, ties going to the first by name;
    accepted: whether distance <= max_share * top * grams. The whole text counts. Null texts, texts without letters and empty
    `known` give "und", 0, 0 and false. Repeated rows are judged alike; columns with those four names are replaced.
    """
    docs = docs.drop("predicted", "grams", "distance", "accepted")
    langs = sorted(known)
    union = sorted({g for lang in langs for g in known[lang]})
    slot = {g: i for i, g in enumerate(union)}
    places = {lang: [slot[g] for g in known[lang][:top]] for lang in langs}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "predicted string, grams int, distance long, accepted boolean"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ranks = np.full((len(langs), len(union) + 1), -1, np.int64)
        for i, lang in enumerate(langs):
            ranks[i, places[lang]] = np.arange(len(places[lang]))
        for batch in batches:
            size = batch.num_rows
            n_grams, least, who = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1)
            for at, some in chunks(batch.column(batch.num_columns - 1)):
                symbols, width, own, key, n = grams(some.to_pylist())
                number = {chr(c): i + 1 for i, c in enumerate(symbols)}
                here = []
                for i, g in enumerate(union):
                    if all(c in number for c in g):
                        v = 0
                        for j in range(LONGEST):
                            v = v * width + (number[g[j]] if j < len(g) else 0)
                        here.append((v, i))
                here.sort()
                values, slots = np.array([v for v, _ in here], np.int64), np.array([i for _, i in here] + [len(union)], np.int64)
                pick, rank = ranked(own, n, top)
                own, key = own[pick], key[pick]
                at_slot = np.searchsorted(values, key)
                hit = at_slot < len(values)
                hit[hit] = values[at_slot[hit]] == key[hit]
                slot_of = np.where(hit, slots[np.where(hit, at_slot, 0)], len(union))
                here_n = np.bincount(own, minlength=len(some))
                n_grams[at : at + len(some)] = here_n
                if not langs:
                    continue
                sums = np.empty((len(langs), len(some)), np.int64)
                for i in range(len(langs)):
                    r = ranks[i][slot_of]
                    sums[i] = np.bincount(own, np.where(r < 0, top, np.abs(r - rank)), len(some)).astype(np.int64)
                best = sums.argmin(0)
                least[at : at + len(some)] = sums[best, np.arange(len(some))]
                who[at : at + len(some)] = np.where(here_n > 0, best, -1)
            known_ = who >= 0
            least[~known_] = 0
            n_grams[~known_] = 0
            names = np.array([*langs, UNKNOWN], object)[who]
            ok = known_ & (least <= max_share * top * n_grams)
            new = [pa.array(names, pa.string()), pa.array(n_grams.astype(np.int32)), pa.array(least), pa.array(ok)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "predicted", "grams", "distance", "accepted"])

    return docs.withColumn("__plain", plain(F.col("text").cast("string"))).mapInArrow(run, schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), profiles(docs)).drop("text")


QUERIES = {"op10_langid": op10_langid}
SQL = {
    "op10_langid": rf"""
WITH plain AS (
  SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents),
chars AS (SELECT doc_id, lang, string_split(t, '') AS c FROM plain),
triple AS (SELECT doc_id, lang, unnest(c) AS a, unnest(c[2:]) AS b, unnest(c[3:]) AS d FROM chars),
gram AS (
  SELECT doc_id, lang, a AS gram FROM triple WHERE a <> ' '
  UNION ALL SELECT doc_id, lang, a || b FROM triple WHERE b IS NOT NULL AND (a <> ' ' OR b <> ' ')
  UNION ALL SELECT doc_id, lang, a || b || d FROM triple WHERE d IS NOT NULL AND b <> ' '),
sample AS (SELECT doc_id FROM documents WHERE lang IS NOT NULL AND doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= {TRAIN_ROWS}),
known AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS k
  FROM gram SEMI JOIN sample USING (doc_id) WHERE lang IS NOT NULL GROUP BY lang, gram QUALIFY k <= {TOP}),
own AS (
  SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) AS k
  FROM gram GROUP BY doc_id, gram QUALIFY k <= {TOP}),
far AS (
  SELECT o.doc_id, l.lang, count(*) AS grams, sum(CASE WHEN p.k IS NULL THEN {TOP} ELSE abs(p.k - o.k) END) AS distance
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM known) l LEFT JOIN known p ON p.lang = l.lang AND p.gram = o.gram GROUP BY 1, 2),
best AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)
SELECT d.doc_id, coalesce(b.lang, '{UNKNOWN}') AS predicted, coalesce(b.grams, 0)::INTEGER AS grams, coalesce(b.distance, 0)::BIGINT AS distance,
  coalesce(b.distance <= {MAX_SHARE} * {TOP} * b.grams, false) AS accepted
FROM documents d LEFT JOIN best b USING (doc_id)
"""
}
