"""Wording columns: neutral language, topic labels, plain verdicts, one-line export text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saidso.functions.dates import iso

# Words that state or imply dishonesty or motive (fixed values).
LOADED_WORDS = (
    r"(?i)(?<![A-Za-z0-9_])(lie[sd]?|liars?|lying|misled|mislead(?:s|ing)?|dishonest(?:y|ly)?|deceiv(?:e|ed|es|ing)|deceptive|"
    r"broke (?:a|his|her|their|its) promises?|broken promises?)(?![A-Za-z0-9_])"
)

# Whitespace as browsers and scripting languages see it.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, f"{WS}+", " "))


def loaded_word(text: Column) -> Column:
    hit = F.regexp_extract(text, LOADED_WORDS, 1)
    return F.when(hit != "", hit)


def neutral_or(text: Column, fallback: Column) -> Column:
    return F.when(text.rlike(LOADED_WORDS), fallback).otherwise(text)


def neutral_rationale(verdict: Column, target: Column, resolved: Column) -> Column:
    """A plain rationale from the verdict and dates alone."""
    by = F.coalesce(F.concat(F.lit(" by "), iso(target)), F.lit(""))
    later = F.when(resolved > target, F.concat(F.lit(" It happened on "), iso(resolved), F.lit("."))).otherwise("")
    return (
        F.when(verdict == "correct", F.concat(F.lit("The predicted outcome happened"), by, F.lit(". See the evidence links.")))
        .when(verdict == "incorrect", F.concat(F.lit("The target was not met"), by, F.lit("."), later, F.lit(" See the evidence links.")))
        .when(verdict == "partial", F.concat(F.lit("Part of the prediction came true"), by, F.lit(" and part did not. See the evidence links.")))
        .when(verdict == "unresolvable", F.lit("The available evidence does not settle whether this came true."))
        .when(verdict == "too_early", F.lit("The outcome cannot be known yet."))
    )


# Topic words whose written form is not the slug's lower case (fixed values).
TOPIC_WORDS = {
    "ai": "AI", "agi": "AGI", "openai": "OpenAI", "iphone": "iPhone", "html5": "HTML5", "spacex": "SpaceX", "xai": "xAI", "fsd": "FSD",
    "ev": "EV", "tesla": "Tesla", "lyft": "Lyft", "mars": "Mars", "meta": "Meta", "optimus": "Optimus", "starlink": "Starlink",
    "flash": "Flash",
}

# Verdicts in plain words (fixed values).
PLAIN_VERDICT = {
    "correct": "Came true", "incorrect": "Did not happen", "partial": "Partly", "unresolvable": "Could not be judged",
    "too_early": "Too early to tell", "pending": "Waiting on its deadline",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def topic_label(slug: Column) -> Column:
    """'ai-coding' -> 'AI coding', 'mars-landing' -> 'Mars landing'."""
    words = F.filter(F.split(slug, "-"), lambda w: w != "")
    named = F.transform(
        words,
        lambda w, i: F.coalesce(
            _lookup(TOPIC_WORDS, w),
            F.when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(w),
        ),
    )
    return F.array_join(named, " ")


def plain_verdict(verdict: Column) -> Column:
    return F.coalesce(_lookup(PLAIN_VERDICT, verdict), verdict)


def one_line(s: Column) -> Column:
    """One line, no leading dashes."""
    return F.regexp_replace(collapse(s), f"^-+{WS}*", "")


def clean_cell(s: Column) -> Column:
    """`one_line` that is also safe inside a table cell: pipes become slashes."""
    return one_line(F.replace(s, F.lit("|"), F.lit("/")))


def take_kind(type_: Column) -> Column:
    return F.when(type_ == "prediction", "bet").when(type_ == "stance", "take").otherwise("fact")


def take_quality(verdict: Column) -> Column:
    return F.when(verdict.isin("correct", "incorrect", "partial", "unresolvable"), verdict)


def take_text(claim: Column, target: Column) -> Column:
    text = clean_cell(claim)
    return F.when(target.isNull(), text).otherwise(F.concat(text, F.lit(" (deadline "), iso(target), F.lit(")")))


def take_link(source: Column) -> Column:
    return F.coalesce(source["deep_link"], source["url"])


def take_source(source: Column, said: Column) -> Column:
    return clean_cell(F.concat_ws(" ", source["title"], iso(said), take_link(source)))


def weight_text(p: Column) -> Column:
    """A short decimal: 0.85, never 0.8500000000000001."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", p), r"0+$", ""), r"\.$", "")


def timeline_summary(source: Column, quote: Column) -> Column:
    return one_line(F.concat(source["title"], F.lit(" — \""), one_line(quote), F.lit("\" "), take_link(source)))


def numbered_summary(summary: Column, index: Column, total: Column) -> Column:
    """A quote shared by several claims: every one after the first says which it is."""
    which = F.concat(summary, F.lit(" (claim "), index.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" from this quote)"))
    return F.when(index > 1, which).otherwise(summary)


def timeline_detail(c_type: Column, topic: Column, target: Column, hedge: Column, p: Column, verified: Column) -> Column:
    base = F.concat(
        F.lit("statement: type="), c_type, F.lit(" topic="), topic, F.lit(" due="), F.coalesce(iso(target), F.lit("none")),
        F.lit(" hedge=\""), one_line(hedge), F.lit("\" p="), weight_text(p),
    )
    return F.when(F.coalesce(verified, F.lit(False)), base).otherwise(F.concat(base, F.lit(" quote=unverified")))


def short_text(s: Column, limit: int = 90) -> Column:
    t = collapse(s)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def short_quote(q: Column, max_words: int = 25) -> Column:
    words = F.split(F.trim(q), f"{WS}+")
    return F.when(F.size(words) <= max_words, F.trim(q)).otherwise(F.concat(F.array_join(F.slice(words, 1, max_words), " "), F.lit("…")))
