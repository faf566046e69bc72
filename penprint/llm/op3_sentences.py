"""Operator 3: substring dedup by sliding runs of consecutive sentences.

Every run of SPAN sentences or more, as many as it takes to LEAST_WORDS words, is hashed, equal runs are brought together over the whole
table, and the sentences of every run but the first of its kind are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, mix, polynomial, read

#: Sentences in a run at least, and words that it goes on to have: runs of a few short words recur by chance and in every text.
SPAN = 2
LEAST_WORDS = 25

#: Id of rows without doc_id: they come last.
LAST = (1 << 63) - 1

#: A sentence ends after its stops where white space follows, or at a line break; it keeps the white space after it.
END = r"([.!?]+[ \t\r\f\x0b]+|[.!?]*\n[ \t\n\r\f\x0b]*)"
CUT = "\u0001"


def sentences(text):
    """The sentences of a text with the white space after each, so that together they are the text again.

    A \u0001 in the text also ends a sentence and isn't kept.
    """
    return F.filter(F.split(F.regexp_replace(text, END, "$1" + CUT), CUT, -1), lambda s: s != "")


def norm(sentence):
    """What a sentence is compared by: its words, whatever the white space around it."""
    return F.regexp_replace(sentence, r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", "")


def ends(words, offsets, span: int, least: int):
    """(start, end) of every run, by place in the flat array of words a sentence; offsets: where each text's sentences begin.

    From each start a run takes the fewest sentences, `span` or more, that have `least` words together; starts without so many words
    after them begin none, but a text of `span` sentences that has fewer words altogether is one run.
    """
    import numpy as np

    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    start = np.arange(n)
    text_end = np.repeat(offsets[1:], np.diff(offsets))
    end = np.maximum(start + span, np.searchsorted(total, total[:-1] + least))
    first = np.repeat(offsets[:-1], np.diff(offsets))
    whole = (start == first) & (total[text_end] - total[first] < least) & (first + span <= text_end)
    end = np.where(whole, text_end, end)
    ok = end <= text_end
    return start[ok], end[ok]


def runs_of(docs: DataFrame, span: int, least: int) -> DataFrame:
    """(id, row, at, n, one, two): place, length and two hashes of every run of docs (id, row, text)."""
    bare = docs.select("id", "row", F.transform(sentences(F.col("text")), norm).alias("s"))
    cut = bare.select("id", "row", F.transform("s", lambda x: F.xxhash64(x)).alias("h"), F.transform("s", lambda x: F.regexp_count(x, F.lit(WORD_RE))).alias("n"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            h = mix(batch.column(2).flatten().to_numpy())
            start, end = ends(batch.column(3).flatten().to_numpy(), offsets, span, least)
            text = np.searchsorted(offsets, start, side="right") - 1
            hashes = [pa.array(polynomial(x, start, end).view(np.int64)) for x in (h, mix(h))]
            place = [pa.array((start - offsets[text]).astype(np.int32)), pa.array((end - start).astype(np.int32))]
            who = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), *place, *hashes], ["id", "row", "at", "n", "one", "two"])

    return cut.where("h is not null").mapInArrow(run, "id long, row long, at int, n int, one long, two long")


def repeated_runs(docs: DataFrame, span: int = SPAN, least: int = LEAST_WORDS) -> DataFrame:
    """(id, row, at, n): each run of docs (id, row, text) that has occurred before, by order of id and then place.

    Rows of one id count as one document per distinct row, ordered by their text. Runs are equal if 128 bits of hashes are.
    """
    runs = runs_of(docs, span, least)
    place = F.struct("id", "row", "at")
    # Partial aggregation shrinks a run's thousands of copies before they meet; only kinds seen twice come back to the join.
    kinds = runs.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).where("times > 1")
    again = runs.join(kinds.select("one", "two", "first"), ["one", "two"]).where(place != F.col("first"))
    return again.select("id", "row", "at", "n")


def dedup_sentences(docs: DataFrame, span: int = SPAN, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, sentences, removed): each row's text without the sentences that a non-first repeated run covers.

    Of equal runs the one with the least doc_id, then the least place, stays. A text that loses nothing comes back
    unchanged; one that loses all is empty. Null texts stay null with 0 sentences; texts of fewer than `span` sentences have
    no run. Rows without doc_id come after all others. Repeated rows (same doc_id and text) count as one document and come back
    alike; other rows of one doc_id are told apart by their text. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"id": F.coalesce("doc_id", F.lit(LAST)), "row": F.xxhash64("text")})
    again = repeated_runs(docs, span, least).groupBy("id", "row").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("at"))
    out = docs.join(again, ["id", "row"], "left").withColumn("s", sentences(F.col("text")))
    size = F.coalesce(F.size("s"), F.lit(0))
    size = F.when(F.col("text").isNull(), 0).otherwise(size)
    covered = F.flatten(F.transform("at", lambda a: F.sequence(a["at"], a["at"] + a["n"] - 1)))
    out = out.withColumn("keep", F.when(F.col("at").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("s") - 1), covered)))
    # array_except hashes, so long texts stay linear
    text = F.array_join(F.transform("keep", lambda i: F.get(F.col("s"), i)), "")
    return out.select(
        "doc_id", F.when(F.col("keep").isNull(), F.col("text")).otherwise(text).alias("text"), size.cast("int").alias("sentences"),
        F.when(F.col("keep").isNull(), 0).otherwise(size - F.size("keep")).cast("int").alias("removed"),
    )


def op3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_sentences(read(spark, sf_dir, "documents"))


QUERIES = {"op3_sentences": op3_sentences}
SQL = {
    "op3_sentences": rf"""
WITH cut AS (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '{END}', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s
  FROM documents),
plain AS (SELECT doc_id, list_transform(s, lambda x: regexp_replace(regexp_replace(x, '^[ \t\n\r\f\x0b]+', ''), '[ \t\n\r\f\x0b]+$', '')) AS s FROM cut),
counted AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '{WORD_RE}'))) AS n FROM plain WHERE len(s) >= {SPAN}),
summed AS (SELECT doc_id, s, list_transform(range(len(s) + 1), lambda k: coalesce(list_sum(n[1:k]), 0)) AS c FROM counted),
starts AS (SELECT doc_id, s, c, unnest(range(len(s))) AS i FROM summed),
ended AS (SELECT doc_id, s, i, CASE WHEN c[-1] < {LEAST_WORDS} THEN CASE WHEN i = 0 THEN len(s) END
    ELSE list_filter(range(i + {SPAN}, len(s) + 1), lambda j: c[j + 1] - c[i + 1] >= {LEAST_WORDS})[1] END AS e FROM starts),
keyed AS (SELECT doc_id, i, e, array_to_string(s[i + 1 : e], chr(1)) AS run FROM ended WHERE e IS NOT NULL),
placed AS (SELECT doc_id, i, e, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM keyed),
covered AS (SELECT doc_id, list_distinct(flatten(list(range(i, e)))) AS gone FROM placed WHERE k > 1 GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text
    ELSE array_to_string(list_filter(s, lambda x, k: NOT list_contains(gone, k - 1)), '') END AS text,
  coalesce(len(s), 0)::INTEGER AS sentences, coalesce(len(gone), 0)::INTEGER AS removed
FROM cut LEFT JOIN covered USING (doc_id)
"""
}
