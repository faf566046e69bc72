"""One profile's bands and the rules that fired, as a prompt. Calling a language model is left to the caller."""

from __future__ import annotations

from xml.sax.saxutils import escape

WORDS = {
    "voice_band": "Reading ease: {}.", "rhythm_band": "Sentence rhythm: {}.", "skew_band": "Long outliers among sentences: {}.", "richness_band": "Range of words: {}.",
    "contraction_band": "Contractions: {}.", "conjunction_band": "Sentences that open with a conjunction: {}.", "paragraph_band": "Paragraphs of one sentence: {}.",
    "dialogue_band": "Quoted speech: {}.", "depth_band": "Depth of sentence trees: {}.",
}
TASK = {"restyle": "Put the article into the style described here and keep all its facts.", "generate": "Write a new text on the given topic in the style described here."}


def format_examples(examples: list[str]) -> str:
    inner = "".join(f'\n  <example n="{i}">{escape(x)}</example>' for i, x in enumerate(examples, 1))
    return f"<examples>{inner}\n</examples>" if examples else ""


def build_prompt(bands: dict, rules: list[str] = (), examples: list[str] = (), mode: str = "restyle") -> str:
    """Sections in a fixed order; empty ones are dropped."""
    if mode not in TASK:
        raise ValueError(f"unknown mode {mode!r}")
    style = "\n".join(text.format(bands[k]) for k, text in WORDS.items() if bands.get(k))
    numbers = "\n".join(f"{k}: {v:.2f}" for k, v in bands.items() if isinstance(v, float))
    todo = "\n".join(f"- {r.replace('_', ' ').lower()}" for r in rules)
    sections = [("task", TASK[mode]), ("style", style), ("numbers", numbers), ("changes", todo)]
    parts = [f"<{tag}>\n{body}\n</{tag}>" for tag, body in sections if body]
    return "\n\n".join([*parts, *([format_examples(list(examples))] if examples else [])])
