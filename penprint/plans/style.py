"""The style queries that the driver runs, and their SQL. Every query runs over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as nm
from ..functions.languages import LANGUAGES, function_word_table, function_words
from ..operators import delta, local, vectors
from ..operators import features as ft
from ..operators import tokens as tk

QUERIES: dict = {}
SQL: dict[str, str] = {}

HELD_OUT = "src0"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *more)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.annotate(docs(spark, sf_dir))


SENTS = rf"""sents AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sent_id
  FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '{tk.SENTENCE}'), lambda x: regexp_matches(x, '\S')) AS l FROM documents))"""
TOKEN_SQL = tk.TOKEN.replace("'", "''")
TOKS = rf"""{SENTS}, cut AS (SELECT doc_id, sent_id, regexp_extract_all(s, '{TOKEN_SQL}') AS l FROM sents),
flat AS (SELECT doc_id, sent_id, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM cut),
toks AS (SELECT doc_id, sent_id, text, lower(text) AS lower, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, k) - 1 AS tok_i,
  NOT regexp_matches(text, '{tk.WORD}') AS is_punct FROM flat),
words AS (SELECT * FROM toks WHERE NOT is_punct)"""
SPLIT = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')"
STATS = """count(*) AS "count", round(avg(len), 2) AS mean_length, round(median(len), 2)::DOUBLE AS median_length,
  round(CASE WHEN count(*) > 1 THEN stddev_samp(len) ELSE 0 END, 2) AS stdev_length,
  round(CASE WHEN count(*) > 2 AND stddev_samp(len) > 0 THEN skewness(len) ELSE 0 END, 2) + 0.0 AS skewness, min(len) AS min_length, max(len) AS max_length"""
RICH = """sum(f)::BIGINT AS total_tokens, count(*) AS unique_types, round(count(*) / sum(f), 4) AS ttr, count(*) FILTER (f = 1) AS hapax_legomena,
  round((count(*) FILTER (f = 1)) / count(*), 4) AS hapax_ratio, round(10000 * (sum(f * f) - sum(f))::DOUBLE / (sum(f)::DOUBLE * sum(f)), 2) AS yules_k,
  round(CASE WHEN count(*) FILTER (f = 1) <> count(*) THEN 100 * ln(sum(f)) / (1 - (count(*) FILTER (f = 1)) / count(*)) END, 2) AS honores_r"""


def punctuation_sql() -> str:
    one = lambda m: f"(length(text) - length(replace(text, '{m}', '')))"
    quote = " + ".join(one(m) for m in ('"', "''", "“", "”"))
    counts = {
        "comma": one(","), "period": one("."), "semicolon": one(";"), "colon": one(":"), "exclamation": one("!"), "question": one("?"),
        "dash": "len(regexp_extract_all(text, '---')) + len(regexp_extract_all(replace(text, '---', ''), '--'))",
        "ellipsis": "len(regexp_extract_all(text, '\\.{3}|…'))", "parenthesis": f"{one('(')} + {one(')')}", "quotation": quote,
    }
    return ", ".join(f"CASE WHEN n > 0 THEN round(({c}) * 1000 / n, 2) ELSE 0 END::DOUBLE AS {k}" for k, c in counts.items())


@query(f"SELECT doc_id, sha256(text)[1:16] AS content_id, len({SPLIT}) AS word_count FROM documents")
def doc_word_count(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", nm.document_id(F.col("text")).alias("content_id"), nm.word_count(F.col("text")).alias("word_count"))


@query(
    r"""WITH a AS (SELECT doc_id, nfc_normalize(text) AS t FROM documents),
b AS (SELECT doc_id, replace(replace(replace(replace(replace(t, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS t FROM a),
c AS (SELECT doc_id, replace(replace(translate(t, '‘’“”', '''''""'), '–', '--'), '—', '---') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM c)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f\x0b]+', ' ', 'g'), ' +\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS normalized FROM d"""
)
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", nm.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {punctuation_sql()} FROM (SELECT doc_id, text, len({SPLIT}) AS n FROM documents)")
def punctuation_rates(spark, sf_dir):
    return ft.punctuation_rates(docs(spark, sf_dir))


@query(f"WITH {TOKS}, c AS (SELECT doc_id, lower, count(*) AS f FROM words GROUP BY ALL) SELECT doc_id, {RICH} FROM c GROUP BY doc_id")
def vocab_richness(spark, sf_dir):
    return ft.vocabulary_of(docs(spark, sf_dir))


LENGTHS = f"{TOKS}, lens AS (SELECT doc_id, sent_id, count(*) AS len FROM toks GROUP BY ALL)"


@query(f"WITH {LENGTHS} SELECT doc_id, {STATS} FROM lens GROUP BY doc_id")
def sentence_stats(spark, sf_dir):
    return ft.sentence_rows(local.sentence_sizes(docs(spark, sf_dir)), "doc_id")


@query(
    f"""WITH {LENGTHS}, top AS (SELECT doc_id, max(len) AS m FROM lens GROUP BY 1), grid AS (SELECT doc_id, unnest(range(ceil(m / 5)::BIGINT + 1)) AS bin FROM top)
SELECT g.doc_id, g.bin, count(l.len) AS cnt FROM grid g LEFT JOIN lens l ON l.doc_id = g.doc_id AND l.len // 5 = g.bin GROUP BY ALL"""
)
def sentence_histogram(spark, sf_dir):
    h = ft.histogram(local.sentence_sizes(docs(spark, sf_dir)))
    return h.select("doc_id", F.posexplode("length_distribution").alias("bin", "cnt")).withColumn("bin", F.col("bin").cast("long"))


@query(
    rf"""WITH {SENTS}, t AS (SELECT doc_id, regexp_replace(s, '\s+$', '') AS s FROM sents)
SELECT doc_id, round((count(*) FILTER (s NOT LIKE '%?' AND s NOT LIKE '%!')) / count(*), 3) AS declarative, round((count(*) FILTER (s LIKE '%?')) / count(*), 3) AS interrogative,
  round((count(*) FILTER (s LIKE '%!')) / count(*), 3) AS exclamatory, count(*) AS sentences FROM t GROUP BY doc_id"""
)
def sentence_types(spark, sf_dir):
    return ft.sentence_types(docs(spark, sf_dir))


def _word_values() -> str:
    return ", ".join(f"('{c}', '{w.replace(chr(39), chr(39) * 2)}', {i})" for c in LANGUAGES for i, w in enumerate(function_words(c)))


@query(
    f"""WITH {TOKS}, list(lang, word, ord) AS (VALUES {_word_values()}), c AS (SELECT doc_id, lower, count(*) AS n FROM toks GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c),
r AS (SELECT t.doc_id, l.word, l.ord, round(t.n * 1000 / t.total, 2) AS rate FROM t JOIN documents d USING (doc_id) JOIN list l ON l.lang = d.lang AND l.word = t.lower)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rate DESC, ord) AS rank, word, rate FROM r QUALIFY rank <= 30"""
)
def function_words_topn(spark, sf_dir):
    # The language goes along through the counting as part of the key, so that no join brings it back.
    d = docs(spark, sf_dir, "lang").select(F.struct("doc_id", "lang").alias("doc_id"), "text")
    counts = ft.token_kinds(d, None, sorted({w for c in LANGUAGES for w in function_words(c)}))
    return ft.function_word_rates(counts.select("doc_id.doc_id", "doc_id.lang", "item", "cnt", "total"), function_word_table(spark))


def ngram_sql(n: int) -> str:
    parts = " || ' ' || ".join(["lower", *(f"lead(lower, {k}) OVER w" for k in range(1, n))])
    return f"""WITH {TOKS}, g AS (SELECT doc_id, tok_i, {parts} AS gram FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY tok_i)),
c AS (SELECT doc_id, gram, count(*) AS cnt, min(tok_i) AS first FROM g WHERE gram IS NOT NULL GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first) AS rank, gram, cnt FROM c QUALIFY rank <= 50"""


@query(ngram_sql(2))
def word_bigrams_topn(spark, sf_dir):
    return local.top_items(ft.word_lists(docs(spark, sf_dir)), 50, 2)


@query(ngram_sql(3))
def word_trigrams_topn(spark, sf_dir):
    return local.top_items(ft.word_lists(docs(spark, sf_dir)), 50, 3)


@query(
    r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), '') AS c FROM documents),
g AS (SELECT doc_id, unnest(c) AS x, unnest(c[2:]) AS y, unnest(c[3:]) AS z, generate_subscripts(c, 1) AS i FROM t),
c AS (SELECT doc_id, x || y || z AS gram, count(*) AS cnt, min(i) AS first FROM g WHERE z IS NOT NULL GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first) AS rank, gram, cnt FROM c QUALIFY rank <= 50"""
)
def char_trigrams_topn(spark, sf_dir):
    return ft.top_char_ngrams(docs(spark, sf_dir))


@query(
    f"""WITH {TOKS}, o AS (SELECT doc_id, sent_id, arg_min(lower, tok_i) AS lower, min(tok_i) AS first FROM toks GROUP BY ALL),
c AS (SELECT doc_id, lower, count(*) AS cnt, min(first) AS first FROM o GROUP BY doc_id, lower)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first) AS rank, lower, cnt FROM c QUALIFY rank <= 20"""
)
def sentence_openers(spark, sf_dir):
    return local.top_items(docs(spark, sf_dir).select("doc_id", local.openers_of(F.col("text"))), 20, 1, "lower")


@query(
    f"""WITH {TOKS}, s AS (SELECT doc_id, text IN ('"', '“', '”') AS q, is_punct, sum(CASE WHEN text IN ('"', '“', '”') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tok_i) % 2 = 1 AS inside FROM toks),
c AS (SELECT doc_id, count(*) FILTER (inside) AS a, count(*) FILTER (NOT inside) AS b FROM s WHERE NOT q AND NOT is_punct GROUP BY 1)
SELECT t.doc_id, coalesce(round(a / (a + b), 3), 0) AS quoted_word_ratio, coalesce(round(b / (a + b), 3), 0) AS narration_word_ratio
FROM (SELECT DISTINCT doc_id FROM toks) t LEFT JOIN c USING (doc_id)"""
)
def quoted_ratio(spark, sf_dir):
    return ft.dialogue_ratios(tokens(spark, sf_dir), LANGUAGES["en"][3].split())


@query(
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{TOKEN_SQL}'), lambda x: regexp_matches(x, '{tk.WORD}')) AS l,
  greatest(len(list_filter(regexp_extract_all(text, '{tk.SENTENCE}'), lambda x: regexp_matches(x, '\S'))), 1)::DOUBLE AS s FROM documents),
b AS (SELECT doc_id, s, len(l)::DOUBLE AS w, list_transform(l, lambda x: greatest(len(regexp_extract_all(x, '{ft.VOWELS}')), 1)) AS beats, l FROM w WHERE len(l) > 0),
c AS (SELECT doc_id, s, w, list_sum(beats)::DOUBLE AS y, len(list_filter(beats, lambda x: x >= 3))::DOUBLE AS h,
  list_sum(list_transform(l, lambda x: len(regexp_extract_all(x, '[\p{{L}}\p{{N}}]'))))::DOUBLE AS c FROM b)
SELECT doc_id, round(206.835 - 1.015 * w / s - 84.6 * y / w, 6) AS flesch_reading_ease, round(0.39 * w / s + 11.8 * y / w - 15.59, 6) AS flesch_kincaid_grade,
  round(0.4 * (w / s + 100 * h / w), 6) AS gunning_fog, round(0.0588 * (c / w * 100) - 0.296 * (s / w * 100) - 15.8, 6) AS coleman_liau,
  round(4.71 * c / w + 0.5 * w / s - 21.43, 6) AS ari, round(CASE WHEN s >= 30 THEN 1.0430 * sqrt(h * 30 / s) + 3.1291 END, 6) AS smog FROM c"""
)
def readability(spark, sf_dir):
    return ft.readability_rows(docs(spark, sf_dir))


DELTA_WORDS = r"""list_filter(list_transform(string_split_regex(lower(text), '[ \t\n\r\f\x0b]+'), lambda x: trim(x, '.,;:!?"''()-')), lambda x: x <> '')"""


@query(
    f"""WITH a AS (SELECT CASE WHEN source = '{HELD_OUT}' THEN 'unknown' ELSE coalesce(source, 'Unknown') END AS author, unnest({DELTA_WORDS}) AS word FROM documents),
c AS (SELECT author, word, count(*) AS n FROM a GROUP BY ALL), f AS (SELECT word FROM c GROUP BY word ORDER BY sum(n) DESC, word LIMIT 300),
t AS (SELECT author, sum(n) AS total FROM c GROUP BY 1),
g AS (SELECT t.author, f.word, coalesce(c.n / t.total, 0) AS x FROM t CROSS JOIN f LEFT JOIN c ON c.author = t.author AND c.word = f.word),
s AS (SELECT word, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM g WHERE author <> 'unknown' GROUP BY 1),
d AS (SELECT k.author, round(avg(abs(u.x - k.x) / s.s), 4) AS delta, count(*) AS n_features
  FROM g k JOIN g u ON u.word = k.word AND u.author = 'unknown' JOIN s ON s.word = k.word WHERE k.author <> 'unknown' GROUP BY 1)
SELECT 'unknown' AS unknown_id, row_number() OVER (ORDER BY delta, author) AS rank, author, delta, n_features FROM d"""
)
def burrows_delta(spark, sf_dir):
    d = docs(spark, sf_dir, "source")
    held = F.coalesce(F.col("source") == HELD_OUT, F.lit(False))
    corpus = d.where(~held).select(F.col("source").alias("author"), "text")
    return delta.burrows_delta(corpus, d.where(held).select(F.lit("unknown").alias("unknown_id"), "text"))


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT query, neighbour, round(s, 4) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM s QUALIFY rank <= 10"""
)
def style_knn(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return vectors.nearest(e, e, 10, "vec_id", "vec_id", "embedding", same=True)


CENTROIDS = """m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)"""


@query(
    f"""WITH {CENTROIDS}, n AS (SELECT label, count(*) AS doc_count FROM embeddings GROUP BY 1)
SELECT m.label, doc_count, i - 1 AS dim, round(x, 9) AS mean FROM m JOIN n USING (label)"""
)
def author_centroids(spark, sf_dir):
    c = vectors.centroids(embeddings(spark, sf_dir), "label", "embedding")
    return c.select("label", "doc_count", F.posexplode("mean_vector").alias("dim", "mean")).select("label", "doc_count", F.col("dim").cast("long").alias("dim"), F.round("mean", 9).alias("mean"))


@query(
    f"""WITH {CENTROIDS}, v AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1),
s AS (SELECT vec_id AS query, v.label::BIGINT AS neighbour, round(list_cosine_similarity(embedding::DOUBLE[], v), 12) AS s FROM embeddings, v)
SELECT query, neighbour, round(s, 4) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM s QUALIFY rank <= 5"""
)
def author_knn(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return vectors.nearest(e, vectors.centroids(e, "label", "embedding").withColumnRenamed("mean_vector", "embedding"), 5, "vec_id", "label", "embedding")


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
SELECT vec_id, unnest(range(len(v))) AS dim, round(unnest(list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)), 9) AS unit FROM n"""
)
def l2_normalize(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("dim", "unit"))
    return e.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("unit", 9).alias("unit"))


@query(
    rf"""WITH t AS (SELECT role, lower(unnest(regexp_extract_all(text, '{TOKEN_SQL}'))) AS lower FROM conversations),
c AS (SELECT role, lower, count(*) AS f FROM t WHERE regexp_matches(lower, '{tk.WORD}') GROUP BY ALL),
p AS (SELECT role, count(*) AS turns, sum(length(text) - length(replace(text, ',', '')))::BIGINT AS commas, sum(length(text) - length(replace(text, '?', '')))::BIGINT AS questions FROM conversations GROUP BY 1),
v AS (SELECT role, {RICH} FROM c GROUP BY role)
SELECT * FROM v JOIN p USING (role)"""
)
def conversation_style(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", "text")
    t = c.select("role", F.explode(F.regexp_extract_all(F.col("text"), F.lit(tk.TOKEN), F.lit(0))).alias("t")).select("role", F.lower("t").alias("lower"))
    v = ft.vocabulary_rows(t.where(F.col("lower").rlike(tk.WORD)).groupBy("role", "lower").agg(F.count(F.lit(1)).alias("f")), "role")
    p = c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(ft.marks(F.col("text"), ",")).alias("commas"), F.sum(ft.marks(F.col("text"), "?")).alias("questions"))
    return v.join(p, "role")


@query(
    f"""SELECT lang, source, count(*) AS docs, sum(n)::BIGINT AS words, round(avg(n), 4) AS mean_words
FROM (SELECT lang, source, len({SPLIT}) AS n FROM documents) GROUP BY ROLLUP (lang, source)"""
)
def corpus_rollup(spark, sf_dir):
    d = docs(spark, sf_dir, "lang", "source").select("lang", "source", nm.word_count(F.col("text")).alias("n"))
    return d.rollup("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"), F.round(F.avg("n"), 4).alias("mean_words"))


PARAS = r"""paras AS (SELECT doc_id, k, regexp_replace(p, '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g') AS text FROM (
  SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS k FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents))),
paras20 AS (SELECT * FROM paras WHERE length(text) > 20)"""


@query(
    rf"""WITH {PARAS}, n AS (SELECT doc_id, len({SPLIT}) AS n, len(list_filter(regexp_extract_all(text, '{tk.SENTENCE}'), lambda x: regexp_matches(x, '\S'))) AS s FROM paras20)
SELECT doc_id, count(*) AS "count", round(avg(n), 1) AS mean_length, round(median(n), 1)::DOUBLE AS median_length, round(avg(CASE WHEN s <= 1 THEN 1 ELSE 0 END), 3) AS one_sentence_ratio FROM n GROUP BY 1"""
)
def paragraph_stats(spark, sf_dir):
    return ft.paragraph_stats(docs(spark, sf_dir))


@query(
    rf"""WITH {PARAS}, w AS (SELECT doc_id, k, regexp_replace(regexp_replace(lower(({SPLIT})[1]), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') AS word FROM paras20),
c AS (SELECT doc_id, word, count(*) AS cnt, min(k) AS first FROM w GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first) AS rank, word, cnt FROM c QUALIFY rank <= 15"""
)
def paragraph_openers(spark, sf_dir):
    return ft.ranked(ft.paragraph_openers(docs(spark, sf_dir)), 15, "word")


@query(
    r"""WITH b AS (SELECT doc_id, len(l) AS n, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS t, unnest(list_concat(g, [''])) AS gap
  FROM (SELECT doc_id, string_split_regex(text, '\n\n+') AS l, regexp_extract_all(text, '\n\n+') AS g FROM documents)),
c AS (SELECT *, coalesce(sum(length(t) + length(gap)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
  regexp_replace(t, '^[ \t\n\r\f\x0b]+', '') AS cut FROM b),
d AS (SELECT doc_id, k, CASE WHEN n = 1 THEN t ELSE regexp_replace(cut, '[ \t\n\r\f\x0b]+$', '') END AS text, CASE WHEN n = 1 THEN s ELSE s + length(t) - length(cut) END AS char_start, cut FROM c)
SELECT doc_id, k AS "at", text, char_start, char_start + length(text) AS char_end FROM d WHERE cut <> ''"""
)
def plain_segments(spark, sf_dir):
    from ..operators.segments import plain_segments

    return plain_segments(docs(spark, sf_dir))


def page_text(spark, sf_dir):
    """Text and title of each page."""
    from ..sources.readers import html_text

    return html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES |= {"page_text": page_text}
