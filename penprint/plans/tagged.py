"""More style queries and their SQL: tags by the declared rules, contractions, segments, passages, bands, bars and style vectors.

The tables hold no apostrophes, headings or blank lines, so some queries read a declared rewriting of the documents, the same in SQL:
words that end in "nt" as "n't", lines that begin with "Th" as headings, line breaks as blank lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.languages import LANGUAGES, function_words
from ..operators import diff, examples, segments, vectors, within
from ..operators import features as ft
from ..operators import tokens as tk
from ..operators.tagging import tagged_sql
from . import report, style
from .style import HELD_OUT, LENGTHS, PARAS, SPLIT, SQL, TOKEN_SQL, TOKS, query

TAGGED = f"{TOKS}, {tagged_sql()}"


def measured(spark, sf_dir, group: str):
    """What is counted of each document's tagged tokens, within its row."""
    return within.rows(style.docs(spark, sf_dir), group)


def long_form(rows, name: str, key: str, value: str):
    """(doc_id, rank, key, value) of a column of ranked (key, count) structs."""
    rows = rows.select("doc_id", F.posexplode(name).alias("rank", "e"))
    return rows.select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("e.key").alias(key), F.col("e.count").alias(value))


# --- tags


@query(
    f"""WITH {TAGGED} SELECT doc_id, coalesce(round(count(*) FILTER (pos = 'ADJ') / nullif(count(*) FILTER (pos IN ('NOUN', 'PROPN')), 0), 4), 0) AS adjective_noun_ratio,
  round((count(*) FILTER (pos = 'ADV')) / count(*) * 100, 2) AS adverb_density, round((count(*) FILTER (pos IN ('VERB', 'AUX'))) / count(*) * 100, 2) AS verb_density FROM tagged GROUP BY doc_id"""
)
def pos_rates(spark, sf_dir):
    return measured(spark, sf_dir, "pos").drop("tag_distribution")


@query(
    f"""WITH {TAGGED}, c AS (SELECT doc_id, pos, count(*) AS cnt, min(tok_i) AS first FROM tagged GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first) AS rank, pos, round(cnt / sum(cnt) OVER (PARTITION BY doc_id), 4) AS share FROM c"""
)
def pos_shares(spark, sf_dir):
    return long_form(measured(spark, sf_dir, "pos"), "tag_distribution", "pos", "share")


FIRSTS = f"{TAGGED}, firsts AS (SELECT doc_id, sent_id, arg_min(pos, tok_i) AS pos, min(tok_i) AS first FROM tagged GROUP BY ALL)"


@query(
    f"""WITH {FIRSTS}, c AS (SELECT doc_id, pos, count(*) AS cnt, min(first) AS first FROM firsts GROUP BY doc_id, pos)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first) AS rank, pos, round(cnt / sum(cnt) OVER (PARTITION BY doc_id), 4) AS share FROM c"""
)
def opener_tags(spark, sf_dir):
    return long_form(measured(spark, sf_dir, "sentence_openers"), "pos_distribution", "pos", "share")


@query(f"WITH {FIRSTS} SELECT doc_id, round(100 * avg(CASE WHEN pos = 'CCONJ' THEN 1 ELSE 0 END), 1) AS conjunction_start_rate FROM firsts GROUP BY doc_id")
def conjunction_starts(spark, sf_dir):
    return measured(spark, sf_dir, "sentence_openers").select("doc_id", "conjunction_start_rate")


@query(
    f"""WITH {TAGGED}, d AS (SELECT doc_id, sent_id, max(depth) AS depth FROM tagged GROUP BY ALL)
SELECT doc_id, round(avg(depth), 2) AS mean_tree_depth, round(median(depth), 1)::DOUBLE AS median_tree_depth, round(CASE WHEN count(*) > 1 THEN stddev_samp(depth) ELSE 0 END, 2) AS stdev_tree_depth FROM d GROUP BY doc_id"""
)
def tree_depth(spark, sf_dir):
    return measured(spark, sf_dir, "syntax").select("doc_id", "mean_tree_depth", "median_tree_depth", "stdev_tree_depth")


TENSES = f"""{TAGGED}, verbs AS (SELECT doc_id, coalesce(tense, 'None') AS tense, count(*) AS cnt, min(tok_i) AS first FROM tagged WHERE pos IN ('VERB', 'AUX') GROUP BY doc_id, coalesce(tense, 'None'))"""


@query(f"WITH {TENSES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first) AS rank, tense, round(cnt / sum(cnt) OVER (PARTITION BY doc_id), 3) AS share FROM verbs")
def tense_shares(spark, sf_dir):
    return long_form(measured(spark, sf_dir, "syntax"), "tense_distribution", "tense", "share")


QUOTE = "text IN ('\"', '“', '”')"


@query(
    f"""WITH {TAGGED}, n AS (SELECT *, sum(CASE WHEN {QUOTE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tok_i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM tagged),
c AS (SELECT doc_id, lemma, sum(near)::BIGINT AS cnt, min(tok_i) AS first FROM n WHERE near > 0 AND pos = 'VERB' AND dep IN ('ROOT', 'ccomp', 'parataxis') GROUP BY doc_id, lemma)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first) AS rank, lemma, cnt FROM c QUALIFY rank <= 15"""
)
def attribution_verbs(spark, sf_dir):
    return long_form(measured(spark, sf_dir, "dialogue"), "top_attribution_verbs", "lemma", "cnt")


# --- contractions


def contraction_marks(docs):
    return docs.withColumn("text", F.regexp_replace("text", r"nt(\z|[^\p{L}\p{N}])", "n't$1"))


def contracted(spark, sf_dir):
    return contraction_marks(style.docs(spark, sf_dir))


SUFFIXES = ", ".join("'" + x.replace("'", "''") + "'" for x in LANGUAGES["en"][4].split())
SHORT = rf"""s0 AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sent_id
  FROM (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, 'nt(\z|[^\p{{L}}\p{{N}}])', 'n''t\1', 'g'), '{tk.SENTENCE}'), lambda x: regexp_matches(x, '\S')) AS l FROM documents)),
t0 AS (SELECT doc_id, sent_id, regexp_extract_all(s, '{TOKEN_SQL}') AS l FROM s0), t1 AS (SELECT doc_id, sent_id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM t0),
t2 AS (SELECT *, regexp_extract(t, '^(\p{{L}}+?)(n''t|N''T|''\p{{L}}+)$', 1) AS a, regexp_extract(t, '^(\p{{L}}+?)(n''t|N''T|''\p{{L}}+)$', 2) AS b FROM t1),
t3 AS (SELECT doc_id, sent_id, k, unnest(CASE WHEN a <> '' THEN [a, b] ELSE [t] END) AS text, generate_subscripts(CASE WHEN a <> '' THEN [a, b] ELSE [t] END, 1) AS j FROM t2),
t4 AS (SELECT doc_id, lower(text) AS lower, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, k, j) - 1 AS tok_i FROM t3),
t5 AS (SELECT *, lag(lower) OVER (PARTITION BY doc_id ORDER BY tok_i) AS other FROM t4), pairs AS (SELECT doc_id, other || lower AS pair, tok_i FROM t5 WHERE lower IN ({SUFFIXES}) AND other IS NOT NULL)"""


@query(
    rf"""WITH {SHORT}, n AS (SELECT doc_id, count(*) AS n FROM t4 WHERE regexp_matches(lower, '^''?[\p{{L}}\p{{N}}]') GROUP BY 1), c AS (SELECT doc_id, count(*) AS total FROM pairs GROUP BY 1)
SELECT doc_id, coalesce(total, 0) AS total, round(coalesce(total, 0) * 1000 / n, 1) AS rate_per_1000 FROM n LEFT JOIN c USING (doc_id)"""
)
def contraction_rates(spark, sf_dir):
    return within.rows(contracted(spark, sf_dir), "contractions").select("doc_id", "total", "rate_per_1000")


@query(
    f"""WITH {SHORT}, c AS (SELECT doc_id, pair, count(*) AS cnt, min(tok_i) AS first FROM pairs GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first) AS rank, pair, cnt FROM c QUALIFY rank <= 20"""
)
def contractions_topn(spark, sf_dir):
    return long_form(within.rows(contracted(spark, sf_dir), "contractions"), "top_contractions", "pair", "cnt")


# --- segments

#: Letters that every engine puts in upper case alike.
ABC = "abcdefghijklmnopqrstuvwxyz"
LINES = r"""lines AS (SELECT doc_id, text, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, text, string_split(text, '{0}') AS l FROM src)),
placed AS (SELECT *, coalesce(sum(length(line) + {1}) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
  k = max(k) OVER (PARTITION BY doc_id) AS final FROM lines)"""
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def cut_sql(source: str, by: str, gap: int, hit: str, title: str, least: int = 1, keep: str = "true") -> str:
    """Segments from each line that `hit` names to the next; whole texts with fewer than `least` such lines."""
    lines = LINES.format(by, gap)
    return rf"""WITH src AS ({source}), {lines},
marked AS (SELECT doc_id, text, {title} AS title, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n,
  coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY k), length(text)) AS e FROM placed WHERE {hit}),
pieces AS (SELECT doc_id, place, title, {STRIP.format("substring(text, s + 1, e - s)")} AS text, s AS char_start, e AS char_end FROM marked WHERE n >= {least})
SELECT doc_id, place::INTEGER AS "at", title, text, char_start, char_end FROM pieces WHERE {keep}
UNION ALL SELECT doc_id, 0, NULL, text, 0, length(text) FROM src WHERE doc_id NOT IN (SELECT doc_id FROM marked WHERE n >= {least})"""


@query(cut_sql("SELECT doc_id, text FROM documents", "\n", 1, "line LIKE 'Th%'", "regexp_replace(line, '\\s+$', '')"))
def pattern_segments(spark, sf_dir):
    return segments.segments(style.docs(spark, sf_dir), "pattern", "^Th.*$")


@query(cut_sql(r"SELECT doc_id, regexp_replace(text, '(?m)^Th', '# Th', 'g') AS text FROM documents", "\n", 1, r"regexp_matches(line, '^#{1,2}\s+.')", r"regexp_replace(line, '^#{1,2}\s+|\s+$', '', 'g')"))
def markdown_segments(spark, sf_dir):
    return segments.segments(style.docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", "(?m)^Th", "# Th")), "markdown")


@query(
    cut_sql(
        f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) < 80 THEN translate(l, '{ABC}', '{ABC.upper()}') ELSE l END), chr(10) || chr(10)) AS text FROM documents",
        "\n\n", 2, r"NOT final AND regexp_full_match(line, '[A-Z][A-Z0-9 ,.''\-:&!?]{2,79}')", "trim(line)", 2, "length(text) > 50",
    )
)
def article_segments(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) < 80, F.translate(x, ABC, ABC.upper())).otherwise(x))
    return segments.segments(style.docs(spark, sf_dir).withColumn("text", F.array_join(lines, "\n\n")), "articles")


# --- passages


def blocks(spark, sf_dir):
    return style.docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


PACKED = rf"""paras AS (SELECT doc_id, p, n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM (
  SELECT doc_id, k, p, len({SPLIT.replace("text", "p")}) AS n FROM (SELECT doc_id, unnest(l) AS p0, trim(p0) AS p, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS l FROM documents))) WHERE n >= 10),
walk AS (SELECT doc_id, i, n AS held, 0 AS pack FROM paras WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN w.held + p.n <= 300 THEN w.held + p.n ELSE p.n END, CASE WHEN w.held + p.n <= 300 THEN w.pack ELSE w.pack + 1 END
  FROM walk w JOIN paras p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
packs AS (SELECT doc_id, pack AS "at", string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM walk JOIN paras USING (doc_id, i) GROUP BY doc_id, pack HAVING sum(n) >= 60)"""


@query(f'WITH RECURSIVE {PACKED} SELECT doc_id, "at", text FROM packs')
def example_passages(spark, sf_dir):
    return examples.passages(blocks(spark, sf_dir))


@query(
    rf"""WITH RECURSIVE {PACKED}, cut AS (SELECT doc_id, "at", text, list_filter(string_split(translate(text, '!?', '..'), '.'), lambda x: trim(x) <> '') AS s FROM packs),
lens AS (SELECT *, list_transform(s, lambda x: len(list_filter(string_split_regex(x, '[ \t\n\r\f\x0b]+'), lambda y: y <> ''))::DOUBLE) AS l FROM cut),
m AS (SELECT *, list_avg(l) AS mean FROM lens), v AS (SELECT *, list_avg(list_transform(l, lambda x: (x - mean) * (x - mean))) AS var FROM m),
scored AS (SELECT doc_id, "at", text, CASE WHEN len(l) > 0 THEN abs(mean - 12) / 12 + CASE WHEN contains(text, '''') THEN 0 ELSE 0.3 END + CASE WHEN contains(text, '"') THEN 0 ELSE 0.4 END + greatest(0, 0.3 - var / 100) ELSE 999 END AS score FROM v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9), "at") AS rank, count(*) OVER (PARTITION BY doc_id) AS n FROM scored)
SELECT doc_id, rank, text, round(score, 6) AS score FROM ranked WHERE rank <= greatest(n // 5, 10)"""
)
def example_pool(spark, sf_dir):
    """Passages that come closest to sentences of 12 words and quoted speech."""
    pool = examples.candidate_pool(blocks(spark, sf_dir), 12.0, True)
    return pool.select("doc_id", F.col("rank").cast("long").alias("rank"), "text", F.round("score", 6).alias("score"))


# --- bands and bars


@query(
    f"""WITH r AS ({SQL["readability"]}), s AS ({SQL["sentence_stats"]}), v AS ({SQL["vocab_richness"]})
SELECT doc_id, CASE WHEN flesch_reading_ease >= 90 THEN 'very easy' WHEN flesch_reading_ease >= 80 THEN 'easy' WHEN flesch_reading_ease >= 70 THEN 'fairly easy' WHEN flesch_reading_ease >= 60 THEN 'standard'
    WHEN flesch_reading_ease >= 50 THEN 'fairly difficult' WHEN flesch_reading_ease >= 30 THEN 'difficult' ELSE 'very difficult' END AS ease_band,
  CASE WHEN flesch_reading_ease >= 70 THEN 'accessible' WHEN flesch_reading_ease >= 50 THEN 'moderate' ELSE 'dense' END AS voice_band,
  CASE WHEN mean_length < 15 THEN 'very short' WHEN mean_length < 20 THEN 'crisp' WHEN mean_length < 25 THEN 'moderate' ELSE 'long' END AS rhythm_band,
  CASE WHEN skewness > 2 THEN 'heavy' WHEN skewness > 1 THEN 'moderate' ELSE 'none' END AS skew_band,
  CASE WHEN ttr < 0.15 THEN 'limited' WHEN ttr < 0.25 THEN 'moderate' ELSE 'rich' END AS richness_band
FROM r JOIN s USING (doc_id) JOIN v USING (doc_id)"""
)
def style_bands(spark, sf_dir):
    m = within.measure(style.docs(spark, sf_dir), ["readability", "sentences", "vocabulary"]).where("readability is not null and sentences is not null and vocabulary is not null")
    of = lambda group, *names: (F.col(f"{group}.{n}") for n in names)
    flat = m.select("doc_id", "sentences.*", *ft.readability_columns(*of("readability", *"wsyhc")), *ft.vocabulary_columns(*of("vocabulary", "n", "v", "v1", "ff")))
    return diff.style_bands(flat).select("doc_id", "ease_band", "voice_band", "rhythm_band", "skew_band", "richness_band")


@query(
    f"""WITH s AS (SELECT doc_id, 'sentence_length' AS series, (bin * 5)::VARCHAR AS x, cnt::DOUBLE AS y FROM ({SQL["sentence_histogram"]})),
p AS (SELECT doc_id, 'punctuation' AS series, x, y FROM (UNPIVOT (SELECT * EXCLUDE (parenthesis) FROM ({SQL["punctuation_rates"]})) ON * EXCLUDE (doc_id) INTO NAME x VALUE y)), u AS (SELECT * FROM s UNION ALL SELECT * FROM p)
SELECT doc_id, series, x, y, coalesce(floor(y / nullif(max(y) OVER (PARTITION BY doc_id, series), 0) * 40)::BIGINT, 0) AS bar FROM u"""
)
def report_bars(spark, sf_dir):
    """Bars of each document's sentence lengths and punctuation."""
    from .profile import analyze

    p = analyze(style.docs(spark, sf_dir), ["punctuation", "sentences"])
    return report.bars(report.chart_series(p)).where("y is not null")


@query(f"""WITH d AS ({SQL["burrows_delta"]}) SELECT unknown_id, rank, author, delta, rank = 1 AS most_likely, floor((1 - delta / max(delta) OVER (PARTITION BY unknown_id)) * 20)::BIGINT AS bar FROM d""")
def delta_bars(spark, sf_dir):
    return report.comparison_bars(style.burrows_delta(spark, sf_dir)).drop("n_features")


# --- all fields of the rules, by source


@query(
    rf"""WITH {LENGTHS}, {tagged_sql()}, {PARAS}, src AS (SELECT doc_id, source, text, len({SPLIT}) AS n FROM documents WHERE source IS NOT NULL),
m AS (SELECT source, round(avg(len), 2) AS mean_length FROM lens JOIN src USING (doc_id) GROUP BY 1),
p AS (SELECT source, round(sum(len(regexp_extract_all(text, '---')) + len(regexp_extract_all(replace(text, '---', ''), '--'))) * 1000 / sum(n), 2) AS dash,
  round(sum(length(text) - length(replace(text, '?', ''))) * 1000 / sum(n), 2) AS question, round(sum(length(text) - length(replace(text, ';', ''))) * 1000 / sum(n), 2) AS semicolon FROM src GROUP BY 1),
g AS (SELECT doc_id, len({SPLIT}) AS n, len(list_filter(regexp_extract_all(text, '{tk.SENTENCE}'), lambda x: regexp_matches(x, '\S'))) AS s FROM paras20),
a AS (SELECT source, round(avg(CASE WHEN s <= 1 THEN 1 ELSE 0 END), 3) AS one_sentence_ratio, round(median(g.n), 1)::DOUBLE AS paragraph_median FROM g JOIN src USING (doc_id) GROUP BY 1),
f AS (SELECT doc_id, sent_id, arg_min(pos, tok_i) AS pos FROM tagged GROUP BY ALL),
c AS (SELECT source, round(100 * avg(CASE WHEN pos = 'CCONJ' THEN 1 ELSE 0 END), 1) AS conjunction_start_rate FROM f JOIN src USING (doc_id) GROUP BY 1),
q AS (SELECT doc_id, {QUOTE} AS q, is_punct, sum(CASE WHEN {QUOTE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tok_i) % 2 = 1 AS inside FROM toks),
d AS (SELECT source, coalesce(round((count(*) FILTER (inside)) / count(*), 3), 0) AS quoted_word_ratio FROM q JOIN src USING (doc_id) WHERE NOT q AND NOT is_punct GROUP BY 1),
{SHORT}, k AS (SELECT source, count(*) AS n FROM pairs JOIN src USING (doc_id) GROUP BY 1),
w AS (SELECT source, count(*) AS n FROM t4 JOIN src USING (doc_id) WHERE regexp_matches(lower, '^''?[\p{{L}}\p{{N}}]') GROUP BY 1),
r AS (SELECT source, round(coalesce(k.n, 0) * 1000 / w.n, 1) AS contraction_rate FROM w LEFT JOIN k USING (source)),
fields AS (SELECT * FROM m JOIN p USING (source) LEFT JOIN a USING (source) LEFT JOIN c USING (source) LEFT JOIN d USING (source) LEFT JOIN r USING (source))
SELECT i.source AS input_id, t.source AS target_id, concat_ws(',', CASE WHEN i.mean_length - t.mean_length > 3 THEN 'SHORTEN_SENTENCES' WHEN i.mean_length - t.mean_length < -3 THEN 'LENGTHEN_SENTENCES' END,
  {", ".join(f"CASE WHEN t.{field} {want} AND i.{field} {have} THEN '{name}' END" for name, field, want, have in diff.RULES)}) AS instructions FROM fields i, fields t"""
)
def profile_diff(spark, sf_dir):
    """Every source against every source: a row a pair of sources, few whatever the documents."""
    f = source_fields(spark, sf_dir)
    return diff.profile_diff(f, f, "source", "source")


def source_fields(spark, sf_dir):
    """What the rules compare, by source. Contractions are those of the rewritten text."""
    d = style.docs(spark, sf_dir, "source").where("source is not null")
    t = F.col("text")
    m = within.measure(d, ["sentences", "sentence_openers", "dialogue"]).groupBy("source")
    quoted, told = F.sum("dialogue.quoted"), F.sum("dialogue.told")
    lengths = m.agg(
        F.round(F.sum("sentences.tokens") / F.sum("sentences.count"), 2).alias("mean_length"),
        F.round(100 * (F.sum("sentence_openers.conjunctions") / F.sum("sentence_openers.sentences")), 1).alias("conjunction_start_rate"),
        F.when(F.count("dialogue") > 0, ft.ratio(quoted, quoted + told, 3)).alias("quoted_word_ratio"),
    ).where("mean_length is not null")
    marks = d.withColumn("n", style.nm.word_count(t))
    rate = lambda c: F.round(F.sum(c) * 1000 / F.sum("n"), 2)
    dashes = F.regexp_count(t, F.lit("---")) + F.regexp_count(F.replace(t, F.lit("---"), F.lit("")), F.lit("--"))
    marks = marks.groupBy("source").agg(rate(dashes).alias("dash"), rate(ft.marks(t, "?")).alias("question"), rate(ft.marks(t, ";")).alias("semicolon"))
    paras = ft.paragraph_rows(d.withColumn("doc_id", F.struct("source", "doc_id"))).select("doc_id.source", style.nm.word_count(t).alias("n"), F.size(tk.sentences(t)).alias("s"))
    paras = paras.groupBy("source").agg(F.round(F.avg((F.col("s") <= 1).cast("int")), 3).alias("one_sentence_ratio"), F.round(F.median("n"), 1).alias("paragraph_median"))
    short = within.measure(contraction_marks(d), ["contractions"]).groupBy("source")
    short = short.agg(F.round(F.sum("contractions.total") * 1000 / F.sum("contractions.words"), 1).alias("contraction_rate"))
    out = lengths.join(marks, "source")
    for more in (paras, short):
        out = out.join(more, "source", "left")
    return out


# --- vectors


def vector_sql() -> str:
    """The 128 places from the queries above: joined by document, absent ones 0, logged, of length 1."""
    ranks = lambda name, key, value: f"(SELECT doc_id, map(list({key}), list({value})) AS m FROM ({SQL[name]}) GROUP BY 1)"
    tags = ", ".join(f"coalesce(t.m['{x}'], 0)" for x in vectors.TAGS)
    words = "list_resize(coalesce(w.l, []), 30, 0)"
    listed = lambda t, *names: ", ".join(f"coalesce({t}.{n}, 0)" for n in names)
    english = ", ".join("('" + w.replace("'", "''") + f"', {i})" for i, w in enumerate(function_words("en")))
    return f"""WITH base AS (SELECT doc_id, len({SPLIT}) AS n FROM documents), r AS ({SQL["readability"]}), s AS ({SQL["sentence_stats"]}), v AS ({SQL["vocab_richness"]}),
t AS {ranks("pos_shares", "pos", "share")}, ps AS ({SQL["pos_rates"]}), fw AS (WITH {TOKS}, c AS (SELECT doc_id, lower, count(*) AS n FROM toks GROUP BY ALL),
  x AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c), e(word, ord) AS (VALUES {english}),
  y AS (SELECT doc_id, word, ord, round(n * 1000 / total, 2) AS rate FROM x JOIN e ON word = lower) SELECT doc_id, word, rate FROM y QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rate DESC, ord) <= 30),
w AS (SELECT doc_id, list(rate ORDER BY word) AS l FROM fw GROUP BY 1), p AS ({SQL["punctuation_rates"]}), co AS (SELECT doc_id, 0.0 AS rate_per_1000 FROM base), o AS ({SQL["conjunction_starts"]}),
pa AS ({SQL["paragraph_stats"]}), q AS ({SQL["quoted_ratio"]}), d AS ({SQL["tree_depth"]}), te AS {ranks("tense_shares", "tense", "share")},
whole AS (SELECT base.doc_id, list_concat([{listed("r", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "coleman_liau", "ari", "smog")},
  {listed("s", "mean_length", "median_length", "stdev_length", "skewness")}, coalesce(s."count" * 1000 / nullif(base.n, 0), 0), {listed("v", "ttr", "hapax_ratio", "yules_k", "honores_r")},
  coalesce(v.unique_types / v.total_tokens, 0), {tags}, {listed("ps", "adjective_noun_ratio", "adverb_density", "verb_density")}]::DOUBLE[], {words}::DOUBLE[],
  [{listed("p", *"comma period semicolon colon dash exclamation question ellipsis parenthesis quotation".split())}, {listed("co", "rate_per_1000")}, {listed("o", "conjunction_start_rate")},
  {listed("pa", "mean_length", "median_length", "one_sentence_ratio")}, {listed("q", "quoted_word_ratio")}, {listed("d", "mean_tree_depth", "median_tree_depth", "stdev_tree_depth")},
  {", ".join(f"coalesce(te.m['{x}'], 0)" for x in ("Past", "Pres", "None"))}]::DOUBLE[]) AS x
  FROM base {" ".join(f"LEFT JOIN {j} ON {j}.doc_id = base.doc_id" for j in "r s v t ps w p co o pa q d te".split())}),
logged AS (SELECT doc_id, list_transform(list_resize(x, 128, 0), lambda y, i: CASE WHEN i - 1 IN ({", ".join(map(str, vectors.LOGGED))}) AND y > 0 THEN ln(1 + y) ELSE y END) AS x FROM whole),
normed AS (SELECT doc_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM logged)
SELECT doc_id, unnest(range(128)) AS dim, round(unnest(list_transform(x, lambda y: CASE WHEN n > 0 THEN y / n ELSE y END)), 6) AS value FROM normed"""


@query(vector_sql())
def style_profile_vectors(spark, sf_dir):
    """Place by place, the 128-place vector of each document: all analyzers that have a place, tags by the declared rules."""
    from .profile import analyze

    p = analyze(style.docs(spark, sf_dir), [g for g in ft.ANALYZERS if g != "ngrams"], backend="rules")  # n-grams have no place
    rows = p.select("doc_id", F.posexplode(vectors.style_vector(p)).alias("dim", "value"))
    return rows.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


__all__ = ["HELD_OUT", "style_profile_vectors"]
