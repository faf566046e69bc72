"""A declared rule tagger: tags, lemmas, tenses, heads and depths by word lists and endings, as column expressions.

It stands in for a parsing model where there is none. Its rules are stated here and in SQL (tagged_sql), so its numbers can be checked;
they are no linguist's.

* pos: PUNCT, NUM, the class of a function word, else by ending (English: -ly ADV; -ing, -ed VERB; -ous, -ful, -ive, -able, -ible ADJ),
  else PROPN for a capital that doesn't begin the sentence, else NOUN.
* lemma: a verb without -ing or -ed; any other token in lower case. tense: -ed and was, were, had, did Past; am, is, are, has, have,
  do, does Pres; other verbs none.
* dep: a sentence's first VERB is its ROOT, later ones are ccomp, all else dep. depth: 0 for the ROOT, otherwise 1 and one more for each
  subordinating conjunction up to the token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import word_classes

ENDINGS = {"en": [("ADV", r"^\p{L}{3,}ly$"), ("VERB", r"^\p{L}{3,}(ing|ed)$"), ("ADJ", r"^\p{L}{3,}(ous|ful|ive|able|ible)$")]}
PAST, PRESENT = ("was", "were", "had", "did"), ("am", "is", "are", "has", "have", "do", "does")


def by_class(lang: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for word, name in word_classes(lang).items():
        out.setdefault(name, []).append(word)
    return out


def tag(tokens: DataFrame, lang: str = "en") -> DataFrame:
    """The token table with pos, lemma, dep, tense and depth filled. One shuffle, by sentence."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("tok_i")
    low = F.col("lower")
    pos: Column = F.when(F.col("is_punct"), "PUNCT").when(low.rlike(r"^\p{N}+$"), "NUM")
    for name, words in by_class(lang).items():
        pos = pos.when(low.isin(words), name)
    for name, ending in ENDINGS.get(lang, []):
        pos = pos.when(low.rlike(ending), name)
    pos = pos.when(F.col("text").rlike(r"^\p{Lu}") & (F.row_number().over(w) > 1), "PROPN").otherwise("NOUN")
    tense = F.when(low.isin(*PAST) | ((F.col("pos") == "VERB") & low.rlike("ed$")), "Past").when(low.isin(*PRESENT), "Pres")
    so_far = lambda name: F.sum((F.col("pos") == name).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = tokens.withColumn("pos", F.when(F.col("is_space"), "SPACE").otherwise(pos))
    out = out.withColumn("dep", F.when((F.col("pos") == "VERB") & (so_far("VERB") == 1), "ROOT").when(F.col("pos") == "VERB", "ccomp").otherwise("dep"))
    return out.withColumns({
        "lemma": F.when(F.col("pos") == "VERB", F.regexp_replace("lower", "(ing|ed)$", "")).otherwise(low), "tense": F.when(F.col("pos").isin("VERB", "AUX"), tense),
        "depth": F.when(F.col("dep") == "ROOT", 0).otherwise(1 + so_far("SCONJ")).cast("int"),
    })


def tagged_sql(lang: str = "en") -> str:
    """A CTE `tagged` with the same columns over toks(doc_id, sent_id, tok_i, text, lower, is_punct)."""
    listed = lambda words: ", ".join("'" + x.replace("'", "''") + "'" for x in words)
    classes = " ".join(f"WHEN lower IN ({listed(words)}) THEN '{name}'" for name, words in by_class(lang).items())
    endings = " ".join(f"WHEN regexp_matches(lower, '{e}') THEN '{name}'" for name, e in ENDINGS.get(lang, []))
    return rf"""tagged0 AS (SELECT *, CASE WHEN is_punct THEN 'PUNCT' WHEN regexp_matches(lower, '^\p{{N}}+$') THEN 'NUM' {classes} {endings}
  WHEN regexp_matches(text, '^\p{{Lu}}') AND row_number() OVER w > 1 THEN 'PROPN' ELSE 'NOUN' END AS pos FROM toks WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_i)),
tagged1 AS (SELECT *, CASE WHEN pos <> 'VERB' THEN 'dep' WHEN sum(CASE WHEN pos = 'VERB' THEN 1 ELSE 0 END) OVER w = 1 THEN 'ROOT' ELSE 'ccomp' END AS dep,
  sum(CASE WHEN pos = 'SCONJ' THEN 1 ELSE 0 END) OVER w AS level FROM tagged0 WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_i ROWS UNBOUNDED PRECEDING)),
tagged AS (SELECT *, CASE WHEN pos = 'VERB' THEN regexp_replace(lower, '(ing|ed)$', '') ELSE lower END AS lemma, CASE WHEN dep = 'ROOT' THEN 0 ELSE 1 + level END AS depth,
  CASE WHEN pos NOT IN ('VERB', 'AUX') THEN NULL WHEN lower IN ({listed(PAST)}) OR (pos = 'VERB' AND lower LIKE '%ed') THEN 'Past' WHEN lower IN ({listed(PRESENT)}) THEN 'Pres' END AS tense FROM tagged1)"""
