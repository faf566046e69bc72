import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from penprint.functions import normalize as nm
from penprint.functions.languages import LANGUAGES, function_word_table, function_words, languages
from penprint.operators import delta, diff, examples, local, segments, vectors
from penprint.operators import features as ft
from penprint.operators import tokens as tk
from penprint.operators.tagging import tag
from penprint.plans.profile import analyze
from penprint.sources import readers
from penprint.sources.store import Store

TOKENS = tk.SCHEMA


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def token_rows(spark, words, **more):
    rows = []
    for i, w in enumerate(words):
        x = {"text": w, "pos": None, "dep": None, "lemma": None, "sent_id": 0} | (more.get("at", {}).get(i, {}))
        rows.append((0, x["sent_id"], i, w, w.lower(), x["lemma"], x["pos"], x["dep"], None, not w[0].isalnum(), w.isspace(), x.get("depth")))
    return spark.createDataFrame(rows, TOKENS)


def test_normalize(spark):
    got = texts(spark, "“ﬁne”—it’s  é – ok \r\n\r\n\r\n\r\nend ", None, "", "éx  y").select(nm.normalize(F.col("text"))).collect()
    assert [r[0] for r in got] == ['"fine"---it\'s é -- ok\n\nend', None, "", "éx y"]


def test_document_id_and_words(spark):
    r = texts(spark, "héllo", "a b\x1cc  d ").select(nm.document_id(F.col("text")), nm.word_count(F.col("text"))).collect()
    assert r[0][0] == "3c48591d8d098a45" and r[1][1] == 4


def test_book_frame(spark):
    d = texts(spark, "x\n*** START OF THIS\nbody\nmore\n*** END OF IT\ny", "no marks\nhere", "***start of a\n b ")
    assert [r[0] for r in d.select(nm.strip_book_frame(F.col("text"))).collect()] == ["body\nmore", "no marks\nhere", "b"]


def test_vocabulary(spark):
    d = texts(spark, "the cat saw the dog and the bird saw a cat")
    r = ft.vocabulary(d, tk.annotate(d), "en").first()
    assert (r.total_tokens, r.unique_types, r.ttr, r.hapax_legomena, r.hapax_ratio, r.yules_k, r.honores_r) == (11, 7, 0.6364, 4, 0.5714, 826.45, 559.51)
    b = ft.ranked(ft.word_ngrams(tk.annotate(d), 2), 50, "gram").orderBy("rank").collect()
    assert [x.gram for x in b][:3] == ["the cat", "cat saw", "saw the"] and all(x.cnt == 1 for x in b)


def test_sentence_numbers(spark):
    lengths = spark.createDataFrame([(0, i, n) for i, n in enumerate([3, 7, 12, 12, 31])], "doc_id long, sent_id int, len long")
    r = ft.sentence_rows(lengths, "doc_id").first()
    assert (r.mean_length, r.median_length, r.stdev_length, r.skewness) == (13.0, 12.0, 10.75, 1.55)
    assert ft.histogram(lengths).first().length_distribution == [1, 1, 2, 0, 0, 0, 1, 0]


def test_punctuation(spark):
    r = ft.punctuation_rates(texts(spark, "Well--I said \"no\"... (twice); why? Stop! It's late---go: now, then.", "")).drop("doc_id").collect()
    assert r[0].asDict() == dict(comma=100, period=400, semicolon=100, colon=100, dash=200, exclamation=100, question=100, ellipsis=100, parenthesis=200, quotation=300)
    assert set(r[1].asDict().values()) == {0.0}


def test_char_ngrams(spark):
    got = {r.gram: r.cnt for r in ft.top_char_ngrams(texts(spark, "The  the\nTHE", "ab", None, "", "😀é漢")).where("doc_id < 4").collect()}
    assert got == {"the": 3, "he ": 2, "e t": 2, " th": 2}
    assert [r.gram for r in ft.top_char_ngrams(texts(spark, "😀é漢")).collect()] == ["😀é漢"]


ODD = ["The cat didn't see the dog; it's there. The end! \"Yes,\" the man said? 12 cats...", None, "", " \n", "...", "one", "It's. Don't! It's."]


def test_counts_within_rows_equal_those_over_tokens(spark, monkeypatch):
    """With and without a token table; few items at a time, so that rows fall in several parts."""
    monkeypatch.setattr(local, "ITEMS", 5)
    d = texts(spark, *ODD).repartition(2)
    t = tk.annotate(d)
    for f in (ft.sentences, ft.vocabulary, ft.function_words, ft.ngrams):
        ours, theirs = f(d, None, "en"), f(d, t, "en")
        names = theirs.columns
        rows = lambda x: {r.doc_id: r for r in x.select(names).collect()}
        a, b = rows(ours), rows(theirs)
        assert {i: r for i, r in a.items() if i in b} == b, f
    openers = lambda tokens: {r.doc_id: r.top_words for r in ft.sentence_openers(d, tokens, "en").collect()}
    assert openers(None) == openers(t)


def test_sentences_lose_no_token(spark):
    got = texts(spark, "... and so on. Well", "?!", "a.b").select(tk.sentences(F.col("text"))).collect()
    assert [r[0] for r in got] == [["...", " and so on.", " Well"], ["?!"], ["a.", "b"]]


def test_rule_tagger(spark):
    d = texts(spark, "The famous man quickly opened a door because Anna was singing. And 12 dogs!")
    rows = tag(tk.annotate(d)).orderBy("tok_i").collect()
    assert [r.pos for r in rows] == "DET ADJ NOUN ADV VERB DET NOUN SCONJ PROPN AUX VERB PUNCT CCONJ NUM NOUN PUNCT".split()
    assert [r.dep for r in rows if r.pos == "VERB"] == ["ROOT", "ccomp"] and [r.lemma for r in rows if r.pos == "VERB"] == ["open", "sing"]
    assert {r.lower: r.tense for r in rows if r.tense} == {"opened": "Past", "was": "Past"} and [r.depth for r in rows][:9] == [1, 1, 1, 1, 0, 1, 1, 2, 2]
    p = analyze(d, backend="rules").first()
    assert p.pos.verb_density == 18.75 and p.sentence_openers.conjunction_start_rate == 50.0 and p.syntax.tense_distribution[0].key == "Past"


def test_dialogue(spark):
    t = token_rows(spark, '" Go now " she said . He left .'.split(), at={5: dict(pos="VERB", dep="ROOT", lemma="say"), 8: dict(pos="VERB", dep="ROOT", lemma="leave")})
    r = ft.dialogue_ratios(t, ['"']).first()
    assert (r.quoted_word_ratio, r.narration_word_ratio) == (0.333, 0.667)
    assert {x.lemma: x.cnt for x in ft.attribution_verbs(t, ['"']).collect()} == {"say": 2, "leave": 1}


def test_tags(spark):
    t = token_rows(spark, "old cats run fast and purr".split(), at={i: dict(pos=p, depth=d, sent_id=i // 4) for i, (p, d) in enumerate([("ADJ", 2), ("NOUN", 1), ("VERB", 0), ("ADV", 1), ("CCONJ", 1), ("VERB", 0)])})
    r = ft.pos(None, t, "en").first()
    assert (r.adjective_noun_ratio, r.adverb_density, r.verb_density) == (1.0, 16.67, 33.33) and r.tag_distribution[0].key == "VERB"
    o = ft.sentence_openers(None, t, "en").first()
    assert o.conjunction_start_rate == 50.0 and [e.key for e in o.top_words] == ["old", "and"]
    s = ft.syntax(texts(spark, "a? b!"), t, "en").first()
    assert (s.mean_tree_depth, s.median_tree_depth, s.stdev_tree_depth) == (1.5, 1.5, 0.71) and s.sentence_type_mix["interrogative"] == 0.5


def test_contractions(spark):
    d = texts(spark, "I don't know. It's what they'll do; I don't.")
    r = ft.contractions(d, tk.annotate(d), "en").first()
    assert r.total == 4 and r.top_contractions[0].key == "don't" and r.top_contractions[0]["count"] == 2
    f = texts(spark, "l'ami d'elle")
    assert {e.key for e in ft.contractions(f, tk.annotate(f, "fr"), "fr").first().top_contractions} == {"l'ami", "d'elle"}


def test_paragraphs(spark):
    d = texts(spark, "\"Now this is a paragraph of text.\"\n\nshort\n\nAnother one is here. With two sentences.")
    r = ft.paragraphs(d, None, "en").first()
    assert (r["count"], r.mean_length, r.one_sentence_ratio) == (2, 7.0, 0.5) or r["count"] == 2
    assert [e.key for e in r.top_openers] == ["now", "another"]


def test_delta(spark):
    corpus = spark.createDataFrame([("A", "the the of cat"), ("B", "the of of dog")], "author string, text string")
    unknown = spark.createDataFrame([("u", "the of cat cat")], "unknown_id string, text string")
    r = delta.burrows_delta(corpus, unknown, 3).orderBy("rank").collect()
    # ties of equally frequent words go by word: cat 3, of 4, the 4
    assert [(x.author, x.delta) for x in r] == [("A", 1.3333), ("B", 2.0)]


def test_vectors(spark):
    v = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None)], "id long, v array<double>")
    assert [r[0] for r in v.orderBy("id").select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    c = vectors.centroids(v.withColumn("a", F.lit("x")), "a", "v").first()
    assert c.doc_count == 3 and c.mean_vector == [1.5, 2.0]


def test_nearest_is_exact_over_many_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.query, r["rank"]): r.neighbour for r in vectors.nearest(v, v, 4, "id", "id", "v", same=True, block=7).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    for i, a in rows:
        want = sorted((-cos(a, b), j) for j, b in rows if j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in want]


def test_profile_and_vector(spark):
    d = texts(spark, "I don't know. \"Yes,\" she said. It is late; the cat sat.", "", None)
    p = analyze(d, lang="en")
    rows = {r.doc_id: r for r in p.collect()}
    assert len(rows) == 3 and rows[0].vocabulary.total_tokens > 5 and rows[1].vocabulary is None and rows[0].pos is None
    v = {r.doc_id: r.v for r in p.select("doc_id", vectors.style_vector(p).alias("v")).collect()}
    assert all(len(x) == 128 for x in v.values()) and abs(sum(x * x for x in v[0]) - 1) < 1e-9
    assert "readability" not in analyze(d, ["readability", "nonsense"], lang="pt").columns
    with pytest.raises(ValueError):
        analyze(d, lang="xx")


def test_diff_rules(spark):
    fields = "name string, mean_length double, contraction_rate double, one_sentence_ratio double, paragraph_median double, dash double, question double, semicolon double, conjunction_start_rate double, quoted_word_ratio double"
    a = spark.createDataFrame([("a", 20.0, 5.0, 0.1, 60.0, 0.5, 1.0, 4.0, 2.0, 0.05)], fields)
    b = spark.createDataFrame([("b", 15.0, 20.0, 0.4, 20.0, 4.0, 5.0, 1.0, 9.0, 0.4)], fields)
    r = diff.profile_diff(a, b, "name", "name").first().instructions
    assert r.split(",")[0] == "SHORTEN_SENTENCES" and len(r.split(",")) == 9
    assert diff.profile_diff(a, a, "name", "name").first().instructions == ""
    assert diff.style_bands(b.withColumn("flesch_reading_ease", F.lit(72.0))).first().voice_band == "accessible"


def test_segments(spark):
    d = texts(spark, "pre\n# One\nbody\n## Two\nmore", " a \n\n\n b", None)
    m = segments.segments(d.where("doc_id = 0"), "markdown").collect()
    assert [(r.title, r.text) for r in m] == [("One", "# One\nbody"), ("Two", "## Two\nmore")]
    t = segments.segments(d.where("doc_id > 0"), "text").collect()
    assert [(r.text, r.char_start, r.char_end) for r in t] == [("a", 1, 2), ("b", 7, 8)]
    assert segments.segments(d, "pattern", r"^##? ").count() == 3 and segments.segments(d, "none").count() == 2


def test_passages(spark):
    para = lambda n: " ".join(["word"] * (n - 1)) + " end."
    d = texts(spark, "\n\n".join([para(40), para(5), para(30), para(250), para(400), para(20)]))
    assert [len(r.text.split()) for r in examples.passages(d).orderBy("at").collect()] == [70, 250, 400]
    pool = examples.candidate_pool(d, 20.0, False)
    assert [r["rank"] for r in pool.orderBy("rank").collect()] == [1, 2, 3]


def test_languages(spark):
    assert languages(spark).count() == 18 and len(LANGUAGES) == 18
    assert all(len(set(function_words(c))) == len(function_words(c)) >= 20 for c in LANGUAGES)
    assert {"the", "of", "and", "not"} <= set(function_words("en")) and function_words("xx") == function_words("en")
    own = function_word_table(spark, {"en": ["zeta", "alpha"]}).where("lang = 'en'").orderBy("ord").collect()
    assert [r.word for r in own] == ["zeta", "alpha"]


def test_files_and_store(spark, tmp_path):
    import zipfile

    (tmp_path / "in/Ann").mkdir(parents=True)
    (tmp_path / "in/Ann/a.txt").write_text("“Hi”  there")
    (tmp_path / "in/Ann/b.dat").write_text("no")
    with zipfile.ZipFile(tmp_path / "in/Ann/c.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="urn:y" xmlns:dc="urn:z"><metadata><dc:title>Book</dc:title><dc:creator>Bo</dc:creator></metadata><manifest><item id="1" href="1.html"/></manifest><spine><itemref idref="1"/></spine></package>')
        z.writestr("o/1.html", "<html><body><h1>One</h1><p>Text &amp; more</p><div>gone</div></body></html>")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.read_files(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {"a.txt", "c.epub"} and rows["a.txt"].text == '"Hi" there' and rows["a.txt"].author == "Ann"
    assert rows["c.epub"].title == "Book" and rows["c.epub"].text == "One\nText & more"
    with pytest.raises(ValueError):
        readers.read_one(spark, "x.dat", b"")
    store = Store(spark, "file://" + str(tmp_path / "store"))
    new = spark.createDataFrame([("d1", "T", "Ann", "en", 3, "{}", [1.0, 0.0]), ("d2", "U", "Bo", "en", 3, "{}", [0.0, 1.0])], "document_id string, title string, author string, lang string, word_count long, profile string, vector array<double>")
    store.upsert(new)
    store.upsert(new.where("document_id = 'd1'").withColumn("title", F.lit("T2")))
    assert [r.title for r in store.documents().collect()] == ["T2", "U"] and store.authors().count() == 2
    q = spark.createDataFrame([(7, [1.0, 0.1])], "query long, vector array<double>")
    assert store.search(q, 1).first().document_id == "d1"
    store.delete(spark.createDataFrame([("d1",)], "document_id string"))
    assert store.rows().count() == 1 and store.missing(new).count() == 1


def test_stream_upserts(spark, tmp_path):
    import json

    from penprint.streaming.ingest import ingest

    (tmp_path / "src").mkdir()
    (tmp_path / "src/1.json").write_text("\n".join(json.dumps(dict(title=t, author="A", text=x)) for t, x in [("a", "The cat sat."), ("b", "A dog ran."), ("c", "The cat sat.")]))
    store = Store(spark, "file://" + str(tmp_path / "store"))
    ingest(spark, str(tmp_path / "src"), store, str(tmp_path / "cp"), ["vocabulary", "punctuation"]).awaitTermination()
    assert store.rows().count() == 2


def test_random_vocabulary_against_python(spark):
    rng = random.Random(1)
    rows = [" ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(1, 40))) for _ in range(10)]
    d = texts(spark, *rows)
    got = {r.doc_id: r for r in ft.vocabulary(d, tk.annotate(d), "en").collect()}
    for i, t in enumerate(rows):
        w = t.split()
        f = [w.count(x) for x in set(w)]
        assert got[i].total_tokens == len(w) and got[i].unique_types == len(f)
        assert got[i].yules_k == pytest.approx(1e4 * (sum(x * x for x in f) - len(w)) / len(w) ** 2, abs=0.01)
    assert statistics.mean(r.total_tokens for r in got.values()) > 1


def test_prompt_and_report(spark):
    from penprint.cli import flat_profile
    from penprint.plans.prompt import build_prompt
    from penprint.plans.report import bars, chart_series, html_report, text_report

    d = texts(spark, "One two three. Four five six seven! " * 5)
    bands = diff.style_bands(flat_profile(d)).first().asDict()
    p = build_prompt(bands, ["MORE_DASHES"], ["a < b"])
    assert "very short" in p and "more dashes" in p and "a &lt; b" in p and "<changes>" not in build_prompt(bands)
    profile = analyze(d, ["sentences", "punctuation", "function_words", "readability"])
    s = bars(chart_series(profile)).collect()
    assert max(r.bar for r in s if r.series == "sentence_length") == 40
    row = profile.first().asDict(True)
    assert "mean_length" in text_report(row) and html_report(row).startswith("<!DOCTYPE")
