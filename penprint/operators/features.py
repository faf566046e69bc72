"""The twelve analyzers, one row a document: over a token table where one is given, otherwise within each document's row.

Ranked dictionaries are arrays of (key, count) structs in rank order: count descending, ties by first occurrence. Documents
without tokens get the zero row of their analyzer; groups that need a parsing model are null where the backend has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import local
from . import tokens as tk

ANALYZERS: dict[str, Callable] = {}


def analyzer(name: str):
    def register(f):
        ANALYZERS[name] = f
        return f

    return register


def ratio(a: Column, b: Column, digits: int, scale: float = 1.0) -> Column:
    return F.coalesce(F.round(F.try_divide(a * F.lit(scale), b), digits), F.lit(0.0))


def top(counted: DataFrame, n: int, key: str, name: str, by: Column | None = None, value: str = "cnt") -> DataFrame:
    """(doc_id, name): the n most frequent keys of (doc_id, key, cnt, first) in rank order."""
    order = by if by is not None else F.desc("cnt")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "first"))
    rows = counted.withColumn("rn", place).where(F.col("rn") <= n)
    entry = F.struct(F.col("rn"), F.struct(F.col(key).alias("key"), F.col(value).alias("count")).alias("e"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias(name))


def ranked(counted: DataFrame, n: int, key: str) -> DataFrame:
    """(doc_id, rank, key, cnt): the same in long form."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("cnt"), "first"))
    return counted.withColumn("rank", place).where(F.col("rank") <= n).select("doc_id", F.col("rank").cast("long").alias("rank"), key, "cnt")


def packed(rows: DataFrame, key: str, name: str, value: str = "cnt") -> DataFrame:
    """(doc_id, name): ranked rows as one list a document."""
    entry = F.struct("rank", F.struct(F.col(key).alias("key"), F.col(value).alias("count")).alias("e"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias(name))


def empty_list(kind: str = "long") -> Column:
    return F.array().cast(f"array<struct<key:string,count:{kind}>>")


# --- sentences


def sentence_lengths(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, len): tokens that aren't white space, punctuation included."""
    return tokens.groupBy("doc_id", "sent_id").agg(F.count_if(~F.col("is_space")).alias("len"))


def sentence_rows(lengths: DataFrame, *by: str) -> DataFrame:
    n, x = F.count(F.lit(1)), F.col("len")
    skew = F.when((n > 2) & (F.stddev_samp(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    return lengths.groupBy(*by).agg(
        n.alias("count"), F.round(F.avg(x), 2).alias("mean_length"), F.round(F.median(x), 2).alias("median_length"),
        F.round(F.when(n > 1, F.stddev_samp(x)).otherwise(0.0), 2).alias("stdev_length"), (F.round(skew, 2) + F.lit(0.0)).alias("skewness"),
        F.min(x).alias("min_length"), F.max(x).alias("max_length"),
    )


def histogram(lengths: DataFrame) -> DataFrame:
    """(doc_id, length_distribution): sentences by length in bins of 5, from 0 up to the longest's, empty bins included."""
    bins = lengths.groupBy("doc_id", F.floor(F.col("len") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"), F.max("len").alias("longest"))
    doc = bins.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("m"), F.max("longest").alias("longest"))
    places = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("longest") / 5))
    return doc.select("doc_id", F.transform(places, lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("length_distribution"))


def elided(lang: str) -> bool:
    from ..functions.languages import ELISION

    return lang in ELISION


@analyzer("sentences")
def sentences(docs, tokens, lang):
    lengths = local.sentence_sizes(docs, elided(lang)) if tokens is None else sentence_lengths(tokens)
    return sentence_rows(lengths, "doc_id").join(histogram(lengths), "doc_id")


# --- vocabulary


def word_counts(tokens: DataFrame, *by: str) -> DataFrame:
    return tk.words(tokens).groupBy(*by, "lower").agg(F.count(F.lit(1)).alias("f"), F.min("tok_i").alias("first"))


def vocabulary_rows(counts: DataFrame, *by: str) -> DataFrame:
    n, v, v1, f = F.sum("f"), F.count(F.lit(1)), F.count_if(F.col("f") == 1), F.col("f")
    return counts.groupBy(*by).agg(
        n.alias("total_tokens"), v.alias("unique_types"), F.round(v / n, 4).alias("ttr"), v1.alias("hapax_legomena"), F.round(v1 / v, 4).alias("hapax_ratio"),
        F.round(10000 * (F.sum(f * f) - n) / (n * n), 2).alias("yules_k"), F.round(F.when(v1 != v, 100 * F.ln(n) / (1 - v1 / v)), 2).alias("honores_r"),
    )


def vocabulary_columns(n: Column, v: Column, v1: Column, ff: Column) -> list[Column]:
    """The same of a list's items, different ones, those that occur once, and the sum of squared counts."""
    return [
        n.alias("total_tokens"), v.alias("unique_types"), F.round(v / n, 4).alias("ttr"), v1.alias("hapax_legomena"), F.round(v1 / v, 4).alias("hapax_ratio"),
        F.round(10000 * (ff - n) / (n * n), 2).alias("yules_k"), F.round(F.when(v1 != v, 100 * F.ln(n) / (1 - v1 / v)), 2).alias("honores_r"),
    ]


def vocabulary_of(docs: DataFrame, lang: str = "en") -> DataFrame:
    """The same of docs (doc_id, text), without a shuffle."""
    counts = local.richness(docs.select("doc_id", local.words_of(F.col("text"), elided(lang))))
    return counts.select("doc_id", *vocabulary_columns(*(F.col(c) for c in ("n", "v", "v1", "ff"))))


@analyzer("vocabulary")
def vocabulary(docs, tokens, lang):
    if tokens is None:
        return vocabulary_of(docs, lang)
    return vocabulary_rows(word_counts(tokens, "doc_id"), "doc_id")


# --- function words


def function_word_rates(counts: DataFrame, words: DataFrame, n: int = 30) -> DataFrame:
    """(doc_id, rank, word, rate): per 1000 tokens that aren't white space, of counts (doc_id, lang, item, cnt, total). Ties in list
    order."""
    # the list of words has some 1500 rows
    hit = counts.join(F.broadcast(words.withColumnRenamed("word", "item")), ["lang", "item"]).withColumn("rate", F.round(F.col("cnt") * 1000 / F.col("total"), 2))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("rate"), "ord"))
    return hit.withColumn("rank", place).where(F.col("rank") <= n).select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("item").alias("word"), "rate")


def token_kinds(docs: DataFrame, tokens: DataFrame | None, words: list[str], lang: str = "en") -> DataFrame:
    """(doc_id, item, cnt, total): how often each of the words occurs among the document's tokens that aren't white space."""
    if tokens is None:
        lower = F.transform(local.tokens_of(F.col("text"), elided(lang)), F.lower)
        return local.kinds(docs.select("doc_id", lower), words)
    counts = tk.visible(tokens).groupBy("doc_id", F.col("lower").alias("item")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("total", F.sum("cnt").over(Window.partitionBy("doc_id"))).where(F.col("item").isin(words))


@analyzer("function_words")
def function_words(docs, tokens, lang):
    from ..functions.languages import function_word_table, function_words

    rates = function_word_rates(token_kinds(docs, tokens, function_words(lang), lang).withColumn("lang", F.lit(lang)), function_word_table(docs.sparkSession))
    entry = F.struct("rank", F.struct(F.col("word").alias("key"), F.col("rate").alias("count")).alias("e"))
    return rates.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("frequencies"), F.lit(30).alias("top_n"))


# --- parts of speech, openers, syntax: null without a model


@analyzer("pos")
def pos(docs, tokens, lang):
    tokens = tk.annotate(docs, lang) if tokens is None else tokens
    seen = tk.visible(tokens).where("pos is not null")
    n = F.count(F.lit(1))
    is_ = lambda *tags: F.count_if(F.col("pos").isin(*tags))
    rows = seen.groupBy("doc_id").agg(
        ratio(is_("ADJ"), is_("NOUN", "PROPN"), 4).alias("adjective_noun_ratio"), F.round(is_("ADV") / n * 100, 2).alias("adverb_density"),
        F.round(is_("VERB", "AUX") / n * 100, 2).alias("verb_density"),
    )
    counts = seen.groupBy("doc_id", "pos").agg(n.alias("cnt"), F.min("tok_i").alias("first"))
    counts = counts.withColumn("share", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("doc_id")), 4))
    return rows.join(top(counts, 99, "pos", "tag_distribution", value="share"), "doc_id")


def first_tokens(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, lower, pos, first): each sentence's first token that isn't white space."""
    opening = F.min_by(F.struct("lower", "pos"), "tok_i")
    return tk.visible(tokens).groupBy("doc_id", "sent_id").agg(opening.alias("o"), F.min("tok_i").alias("first")).select("doc_id", "sent_id", "o.*", "first")


def opener_counts(tokens: DataFrame) -> DataFrame:
    return first_tokens(tokens).groupBy("doc_id", "lower").agg(F.count(F.lit(1)).alias("cnt"), F.min("first").alias("first"))


@analyzer("sentence_openers")
def sentence_openers(docs, tokens, lang):
    if tokens is None:
        words = packed(local.top_items(docs.select("doc_id", local.openers_of(F.col("text"), elided(lang))), 20, 1, "lower"), "lower", "top_words")
        return words.withColumns({"pos_distribution": F.lit(None).cast("array<struct<key:string,count:double>>"), "conjunction_start_rate": F.lit(None).cast("double")})
    first = first_tokens(tokens)
    words = first.groupBy("doc_id", "lower").agg(F.count(F.lit(1)).alias("cnt"), F.min("first").alias("first"))
    tags = first.where("pos is not null").groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("cnt"), F.min("first").alias("first"))
    tags = tags.withColumn("share", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("doc_id")), 4))
    rate = first.groupBy("doc_id").agg(F.round(100 * F.avg((F.col("pos") == "CCONJ").cast("int")), 1).alias("conjunction_start_rate"))
    return top(words, 20, "lower", "top_words").join(top(tags, 99, "pos", "pos_distribution", value="share"), "doc_id", "left").join(rate, "doc_id")


def sentence_types(docs: DataFrame) -> DataFrame:
    """(doc_id, declarative, interrogative, exclamatory, sentences): shares by the sentence's last mark, 3 digits."""
    s = docs.select("doc_id", F.explode(tk.sentences(F.col("text"))).alias("s")).select("doc_id", F.regexp_replace("s", r"\s+$", "").alias("s"))
    ask, cry, n = F.count_if(F.endswith("s", F.lit("?"))), F.count_if(F.endswith("s", F.lit("!"))), F.count(F.lit(1))
    return s.groupBy("doc_id").agg(
        F.round((n - ask - cry) / n, 3).alias("declarative"), F.round(ask / n, 3).alias("interrogative"), F.round(cry / n, 3).alias("exclamatory"), n.alias("sentences")
    )


@analyzer("syntax")
def syntax(docs, tokens, lang):
    tokens = tk.annotate(docs, lang) if tokens is None else tokens
    deep = tokens.groupBy("doc_id", "sent_id").agg(F.max("depth").alias("depth"))
    d, n = F.col("depth"), F.count("depth")
    rows = deep.groupBy("doc_id").agg(
        F.round(F.avg(d), 2).alias("mean_tree_depth"), F.round(F.median(d), 1).alias("median_tree_depth"),
        F.round(F.when(n > 1, F.stddev_samp(d)).when(n == 1, 0.0), 2).alias("stdev_tree_depth"),
    )
    verbs = tokens.where(F.col("pos").isin("VERB", "AUX")).groupBy("doc_id", F.coalesce("tense", F.lit("None")).alias("tense"))
    tenses = verbs.agg(F.count(F.lit(1)).alias("cnt"), F.min("tok_i").alias("first"))
    tenses = tenses.withColumn("share", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("doc_id")), 3))
    mix = sentence_types(docs).select("doc_id", F.create_map(*[x for k in ("declarative", "interrogative", "exclamatory") for x in (F.lit(k), F.col(k))]).alias("sentence_type_mix"))
    return rows.join(top(tenses, 99, "tense", "tense_distribution", value="share"), "doc_id", "left").join(mix, "doc_id", "left")


# --- n-grams


def word_ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """(doc_id, gram, cnt, first): runs of n words, across sentences."""
    w = Window.partitionBy("doc_id").orderBy("tok_i")
    parts = [F.col("lower"), *(F.lead("lower", k).over(w) for k in range(1, n))]
    rows = tk.words(tokens).select("doc_id", "tok_i", *(p.alias(f"w{i}") for i, p in enumerate(parts))).where(F.col(f"w{n - 1}").isNotNull())
    return rows.groupBy("doc_id", F.concat_ws(" ", *(f"w{i}" for i in range(n))).alias("gram")).agg(F.count(F.lit(1)).alias("cnt"), F.min("tok_i").alias("first"))


def word_lists(docs: DataFrame, lang: str = "en") -> DataFrame:
    return docs.select("doc_id", local.words_of(F.col("text"), elided(lang)))


def top_char_ngrams(docs: DataFrame, n: int = 50, size: int = 3) -> DataFrame:
    """(doc_id, rank, gram, cnt): n-character runs of the lower-case text with white space as single spaces."""
    return local.top_characters(docs.select("doc_id", F.regexp_replace(F.lower("text"), r"\s+", " ")), n, size)


@analyzer("ngrams")
def ngrams(docs, tokens, lang):
    chars = packed(top_char_ngrams(docs), "gram", "char_trigrams")
    words = [packed(local.top_items(word_lists(docs, lang), 50, k), "gram", name) if tokens is None else top(word_ngrams(tokens, k), 50, "gram", name) for k, name in ((2, "word_bigrams"), (3, "word_trigrams"))]
    return chars.join(words[0], "doc_id", "left").join(words[1], "doc_id", "left")


# --- punctuation: no shuffle


def marks(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def punctuation_rates(docs: DataFrame) -> DataFrame:
    """(doc_id, ten rates a thousand words); a text without words has rates of 0. Words are counted once, in a select below."""
    from ..functions.normalize import word_count

    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", word_count(F.col("text")))
    return base.select("doc_id", *punctuation_columns(F.col("text"), F.col("n")))


def punctuation_columns(text: Column, n: Column) -> list[Column]:
    """The ten rates of a text of n words."""
    counts = {
        "comma": marks(text, ","), "period": marks(text, "."), "semicolon": marks(text, ";"), "colon": marks(text, ":"),
        "dash": F.regexp_count(text, F.lit("---")) + F.regexp_count(F.replace(text, F.lit("---"), F.lit("")), F.lit("--")),
        "exclamation": marks(text, "!"), "question": marks(text, "?"), "ellipsis": F.regexp_count(text, F.lit(r"\.{3}|…")),
        "parenthesis": marks(text, "(") + marks(text, ")"), "quotation": sum((marks(text, q) for q in "'“”"), marks(text, '"')),
    }
    return [F.when(n > 0, F.round(c * 1000 / n, 2)).otherwise(0.0).alias(k) for k, c in counts.items()]


@analyzer("punctuation")
def punctuation(docs, tokens, lang):
    return punctuation_rates(docs)


# --- contractions


def contraction_counts(tokens: DataFrame, suffixes: list[str], elided: bool = False) -> DataFrame:
    """(doc_id, pair, cnt, first): a suffix with the token before it, or, if elided, a prefix with the token after it."""
    w = Window.partitionBy("doc_id").orderBy("tok_i")
    other = F.lead("lower").over(w) if elided else F.lag("lower").over(w)
    rows = tokens.select("doc_id", "tok_i", "lower", other.alias("other")).where(F.col("lower").isin(suffixes) & F.col("other").isNotNull())
    pair = F.concat("lower", "other") if elided else F.concat("other", "lower")
    return rows.groupBy("doc_id", pair.alias("pair")).agg(F.count(F.lit(1)).alias("cnt"), F.min("tok_i").alias("first"))


@analyzer("contractions")
def contractions(docs, tokens, lang):
    tokens = tk.annotate(docs, lang) if tokens is None else tokens
    from ..functions.languages import ELISION, LANGUAGES

    counts = contraction_counts(tokens, LANGUAGES[lang][4].split(), lang in ELISION)
    total = counts.groupBy("doc_id").agg(F.sum("cnt").alias("total"))
    n = tk.words(tokens).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = n.join(total, "doc_id", "left").join(top(counts, 20, "pair", "top_contractions"), "doc_id", "left")
    all_ = F.coalesce("total", F.lit(0))
    return rows.select("doc_id", all_.alias("total"), F.round(all_ * 1000 / F.col("n"), 1).alias("rate_per_1000"), F.coalesce("top_contractions", empty_list()).alias("top_contractions"))


# --- paragraphs


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, at, text): blocks between blank lines of more than 20 characters, stripped."""
    from ..functions.normalize import strip

    return docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("at", "p")).select("doc_id", "at", strip(F.col("p")).alias("text")).where(F.length("text") > 20)


def paragraph_stats(docs: DataFrame) -> DataFrame:
    from ..functions.normalize import word_count

    n = paragraph_rows(docs).select("doc_id", word_count(F.col("text")).alias("n"), F.size(tk.sentences(F.col("text"))).alias("s"))
    return n.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("n"), 1).alias("mean_length"), F.round(F.median("n"), 1).alias("median_length"),
        F.round(F.avg((F.col("s") <= 1).cast("int")), 3).alias("one_sentence_ratio"),
    )


def paragraph_openers(docs: DataFrame) -> DataFrame:
    from ..functions.normalize import words

    first = F.lower(F.get(words(F.col("text")), F.lit(0)))
    bare = F.regexp_replace(F.regexp_replace(first, '^"+|"+$', ""), "^'+|'+$", "")
    return paragraph_rows(docs).groupBy("doc_id", bare.alias("word")).agg(F.count(F.lit(1)).alias("cnt"), F.min("at").alias("first"))


@analyzer("paragraphs")
def paragraphs(docs, tokens, lang):
    return paragraph_stats(docs).join(top(paragraph_openers(docs), 15, "word", "top_openers"), "doc_id", "left")


# --- dialogue


def quoted_words(tokens: DataFrame, quotes: list[str]) -> DataFrame:
    """(doc_id, quoted, told): words inside and outside quotes; quote marks toggle."""
    w = Window.partitionBy("doc_id").orderBy("tok_i").rowsBetween(Window.unboundedPreceding, 0)
    is_quote = F.col("text").isin(quotes)
    inside = (F.sum(is_quote.cast("int")).over(w) % 2) == 1
    rows = tokens.select("doc_id", inside.alias("inside"), (~is_quote & ~F.col("is_punct") & ~F.col("is_space")).alias("word"))
    return rows.groupBy("doc_id").agg(F.count_if(F.expr("inside and word")).alias("quoted"), F.count_if(F.expr("not inside and word")).alias("told"))


def dialogue_ratios(tokens: DataFrame, quotes: list[str]) -> DataFrame:
    """Words inside and outside quotes as shares of all words, 3 digits."""
    q, o = F.col("quoted"), F.col("told")
    return quoted_words(tokens, quotes).select("doc_id", ratio(q, q + o, 3).alias("quoted_word_ratio"), ratio(o, q + o, 3).alias("narration_word_ratio"))


def attribution_verbs(tokens: DataFrame, quotes: list[str]) -> DataFrame:
    """(doc_id, lemma, cnt, first): verbs near quote marks; each mark within 5 tokens counts. No range join: a rows frame."""
    w = Window.partitionBy("doc_id").orderBy("tok_i").rowsBetween(-5, 5)
    near = F.sum(F.col("text").isin(quotes).cast("int")).over(w)
    rows = tokens.withColumn("near", near).where("near > 0 and pos = 'VERB' and dep in ('ROOT', 'ccomp', 'parataxis')")
    return rows.groupBy("doc_id", "lemma").agg(F.sum("near").alias("cnt"), F.min("tok_i").alias("first"))


@analyzer("dialogue")
def dialogue(docs, tokens, lang):
    tokens = tk.annotate(docs, lang) if tokens is None else tokens
    from ..functions.languages import LANGUAGES

    quotes = LANGUAGES[lang][3].split()
    verbs = top(attribution_verbs(tokens, quotes), 15, "lemma", "top_attribution_verbs")
    return dialogue_ratios(tokens, quotes).join(verbs, "doc_id", "left").withColumn("top_attribution_verbs", F.coalesce("top_attribution_verbs", empty_list()))


# --- readability: a declared syllable rule, the same in SQL

VOWELS = "[aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûüýÿ]+"


def readability_rows(docs: DataFrame) -> DataFrame:
    """The six formulas over words (tokens with letters or digits), sentences, letters and digits, and syllables.

    Syllables of a word: its groups of vowels, 1 at least. Words of three syllables or more are hard. No shuffle.
    """
    text = F.col("text")
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(tk.TOKEN), F.lit(0)), lambda t: t.rlike(tk.WORD))
    beats = F.transform(F.col("words"), lambda x: F.greatest(F.regexp_count(x, F.lit(VOWELS)), F.lit(1)))
    add = lambda a, x: a + x
    base = docs.select("doc_id", words.alias("words"), F.greatest(F.size(tk.sentences(text)), F.lit(1)).cast("double").alias("s")).withColumn("beats", beats)
    zero = F.lit(0).cast("long")
    base = base.select(
        "doc_id", "s", F.size("words").cast("double").alias("w"), F.aggregate("beats", zero, lambda a, x: a + x).cast("double").alias("y"),
        F.size(F.filter("beats", lambda x: x >= 3)).cast("double").alias("h"),
        F.aggregate("words", zero, lambda a, x: a + F.regexp_count(x, F.lit(r"[\p{L}\p{N}]"))).cast("double").alias("c"),
    ).where("w > 0")
    return base.select("doc_id", *readability_columns(*(F.col(k) for k in "wsyhc")))


def readability_columns(w: Column, s: Column, y: Column, h: Column, c: Column) -> list[Column]:
    """The six formulas of words, sentences, syllables, hard words, and letters and digits."""
    return [
        F.round(206.835 - 1.015 * w / s - 84.6 * y / w, 6).alias("flesch_reading_ease"), F.round(0.39 * w / s + 11.8 * y / w - 15.59, 6).alias("flesch_kincaid_grade"),
        F.round(0.4 * (w / s + 100 * h / w), 6).alias("gunning_fog"), F.round(0.0588 * (c / w * 100) - 0.296 * (s / w * 100) - 15.8, 6).alias("coleman_liau"),
        F.round(4.71 * c / w + 0.5 * w / s - 21.43, 6).alias("ari"), F.round(F.when(s >= 30, 1.0430 * F.sqrt(h * 30 / s) + 3.1291), 6).alias("smog"),
    ]


@analyzer("readability")
def readability(docs, tokens, lang):
    return readability_rows(docs)
