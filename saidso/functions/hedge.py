"""Hedge words to probabilities: the longest table phrase wins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from saidso.functions.wording import WS

# Probability of each hedge phrase, most to least confident (fixed values).
HEDGE_TABLE: tuple[tuple[float, tuple[str, ...]], ...] = (
    (0.95, ("for sure", "definitely", "certainly", "guarantee", "100%", "no doubt", "no doubt about it", "without a doubt", "absolutely",
            "without question", "completely obvious")),
    (0.9, ("very confident", "highly confident", "extremely likely", "I'm confident", "feel confident")),
    (0.85, ("will", "is going to")),
    (0.75, ("very likely", "expect", "on track", "fairly confident", "the plan is", "game plan")),
    (0.7, ("likely", "probably", "should")),
    (0.65, ("I think", "I believe", "my guess", "I'm guessing", "I guess")),
    (0.55, ("I hope", "hopefully", "our hope is", "aim to", "goal is", "aspirational", "see if we can")),
    (0.5, ("50/50", "coin flip", "maybe")),
    (0.4, ("possibly", "potentially", "could", "might", "we may", "it may", "may see")),
    (0.25, ("unlikely", "doubt")),
    (0.1, ("no chance", "never going to")),
)

DEFAULT_PROBABILITY = 0.85

# Wordings that make a claim negative (fixed values).
NEGATED_CLAIM = (
    r"(?i)(?<![A-Za-z0-9_])(?:will not|won't|would not|wouldn't|is not going to|isn't going to|are not going to|aren't going to|not going to|"
    r"never|no longer|cannot|can't|not)(?![A-Za-z0-9_])"
)

_NOT_AFTER_WORD, _NOT_BEFORE_WORD = r"(?<![a-z0-9_])", r"(?![a-z0-9_])"


def normalize_hedge(s: Column) -> Column:
    """Spoken forms to the table's written ones: 'a hundred percent' -> '100%', 'fifty-fifty' -> '50/50'."""
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "[‘’ʼ]", "'"), f"{WS}+", " ")
    s = F.regexp_replace(s, _NOT_AFTER_WORD + r"(?:(?:a|one) )?hundred[ -]?(?:percent|per cent)" + _NOT_BEFORE_WORD, "100%")
    s = F.regexp_replace(s, _NOT_AFTER_WORD + r"(\d+(?:\.\d+)?) ?(?:percent|per cent)" + _NOT_BEFORE_WORD, "$1%")
    return F.trim(F.regexp_replace(s, _NOT_AFTER_WORD + r"(?:fifty|50)(?:[ -]|/)(?:fifty|50)" + _NOT_BEFORE_WORD, "50/50"))


def _phrases() -> list[tuple[str, float]]:
    """Every phrase with its probability, longest first; equal lengths keep table order."""
    flat = [(phrase, p) for p, phrases in HEDGE_TABLE for phrase in phrases]
    return sorted(flat, key=lambda x: -len(x[0]))


def _body(phrase: str) -> str:
    """Whole words, allowing a plain inflection ('expected', 'guarantees')."""
    return re.escape(phrase.lower()).replace(r"\ ", " ").replace("'", "'") + ("(?:s|d|ed)?" if phrase[-1].isalpha() else "")


def match_hedge(text: Column) -> Column:
    """STRUCT<phrase, p> of the longest table phrase in `text`, or NULL.

    One pass over the text: a lookahead captures the phrase starting at every
    word, overlapping ones included, and the longest of them wins.
    """
    phrases = _phrases()
    anywhere = "(?<![a-z0-9])(?=(" + "|".join(_body(ph) + "(?![a-z0-9])" for ph, _ in phrases) + "))"
    entries = []
    for order, (phrase, p) in enumerate(phrases):
        row = F.struct(F.lit(order).alias("order"), F.lit(phrase).alias("phrase"), F.lit(p).alias("p"))
        for ending in ("", "s", "d", "ed") if phrase[-1].isalpha() else ("",):
            entries += [F.lit(phrase.lower() + ending), row]
    table = F.create_map(*entries)
    found = F.regexp_extract_all(normalize_hedge(text), F.lit(anywhere), F.lit(1))
    best = F.array_min(F.transform(found, lambda m: F.try_element_at(table, m)))
    return F.when(best.isNotNull(), F.struct(best["phrase"].alias("phrase"), best["p"].alias("p")))


def round_probability(p: Column) -> Column:
    """Nearest 0.05, kept inside [0.05, 0.95]."""
    return F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.floor(p * 20 + 0.5) / 20))


def implied_probability(hedge: Column, claim: Column | None = None) -> Column:
    hit = match_hedge(hedge)["p"]
    if claim is not None:
        hit = F.coalesce(hit, match_hedge(claim)["p"])
    return round_probability(F.coalesce(hit, F.lit(DEFAULT_PROBABILITY)))


def is_negated(claim: Column) -> Column:
    return F.regexp_replace(claim, "[‘’ʼ]", "'").rlike(NEGATED_CLAIM)


def claim_probability(hedge: Column, claim: Column) -> Column:
    """The hedge's probability, flipped when a below-even hedge sits on a claim written in the negative.

    The claim's own wording is never read for hedges.
    """
    matched = match_hedge(hedge)["p"]
    p = round_probability(F.coalesce(matched, F.lit(DEFAULT_PROBABILITY)))
    return F.when(matched.isNotNull() & (p < 0.5) & is_negated(claim), round_probability(1 - p)).otherwise(p)
