"""Rules that compare two profiles, and bands that put a profile's numbers into words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (name, target field, op on target, op on input): a rule fires if both hold.
RULES = [
    ("ADD_CONTRACTIONS", "contraction_rate", "> 15", "< 10"), ("REMOVE_CONTRACTIONS", "contraction_rate", "< 5", "> 10"),
    ("MORE_ONE_SENTENCE_PARAGRAPHS", "one_sentence_ratio", "> 0.3", "< 0.15"), ("SHORTEN_PARAGRAPHS", "paragraph_median", "< 30", "> 50"),
    ("MORE_DASHES", "dash", "> 3", "< 1"), ("MORE_QUESTIONS", "question", "> 4", "< 2"), ("FEWER_SEMICOLONS", "semicolon", "< 1.5", "> 3"),
    ("MORE_CONJUNCTION_STARTS", "conjunction_start_rate", "> 8", "< 3"), ("MORE_DIALOGUE", "quoted_word_ratio", "> 0.3", "< 0.1"),
]


def rule_columns(i: str = "i", t: str = "t") -> list[Column]:
    delta = F.col(f"{i}.mean_length") - F.col(f"{t}.mean_length")
    out = [F.when(delta > 3, "SHORTEN_SENTENCES").when(delta < -3, "LENGTHEN_SENTENCES")]
    for name, field, want, have in RULES:
        out.append(F.when(F.expr(f"{t}.{field} {want} and {i}.{field} {have}"), name))
    return out


def profile_diff(inputs: DataFrame, targets: DataFrame, input_id: str, target_id: str) -> DataFrame:
    """(input_id, target_id, instructions): names of the rules that fire, in order, for every pair; null fields fire none.

    Both sides have the fields that the rules name, one row a document or author.
    """
    return inputs.alias("i").crossJoin(targets.alias("t")).select(
        F.col(f"i.{input_id}").alias("input_id"), F.col(f"t.{target_id}").alias("target_id"), F.concat_ws(",", F.array_compact(F.array(*rule_columns()))).alias("instructions")
    )


def band(c: Column, *limits: tuple[float, str], otherwise: str, above: bool) -> Column:
    out = F
    for limit, name in limits:
        out = out.when(c >= limit if above else c < limit, name)
    return out.otherwise(otherwise)


def style_bands(flat: DataFrame) -> DataFrame:
    """The band each number falls in, as prompts and reports word it; columns of flat that are missing give no band."""
    made = {
        "ease_band": ("flesch_reading_ease", lambda c: band(c, (90, "very easy"), (80, "easy"), (70, "fairly easy"), (60, "standard"), (50, "fairly difficult"), (30, "difficult"), otherwise="very difficult", above=True)),
        "voice_band": ("flesch_reading_ease", lambda c: band(c, (70, "accessible"), (50, "moderate"), otherwise="dense", above=True)),
        "rhythm_band": ("mean_length", lambda c: band(c, (15, "very short"), (20, "crisp"), (25, "moderate"), otherwise="long", above=False)),
        "skew_band": ("skewness", lambda c: F.when(c > 2, "heavy").when(c > 1, "moderate").otherwise("none")),
        "richness_band": ("ttr", lambda c: band(c, (0.15, "limited"), (0.25, "moderate"), otherwise="rich", above=False)),
        "contraction_band": ("contraction_rate", lambda c: F.when(c > 15, "heavy").when(c > 5, "moderate").otherwise("light")),
        "conjunction_band": ("conjunction_start_rate", lambda c: F.when(c > 8, "often").when(c > 3, "sometimes").otherwise("rarely")),
        "paragraph_band": ("one_sentence_ratio", lambda c: F.when(c > 0.35, "mostly single").when(c > 0.15, "mixed").otherwise("full")),
        "dialogue_band": ("quoted_word_ratio", lambda c: F.when(c > 0.4, "heavy").when(c > 0.2, "moderate").when(c < 0.1, "minimal").otherwise("light")),
        "depth_band": ("mean_tree_depth", lambda c: F.when(c < 5, "flat").when(c > 6, "deep").otherwise("middling")),
    }
    return flat.withColumns({name: F.when(F.col(source).isNotNull(), f(F.col(source))) for name, (source, f) in made.items() if source in flat.columns})
