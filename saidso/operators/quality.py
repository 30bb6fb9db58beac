"""Data quality: one report row per broken rule, duplicate ids, totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saidso.functions.dates import iso, lateness_applies, lateness_months
from saidso.functions.hedge import claim_probability
from saidso.functions.ids import claim_id, slugify
from saidso.functions.urls import is_http
from saidso.functions.wording import loaded_word
from saidso.schemas import CLAIM_TYPES, OUTCOME_VERDICTS, SOURCE_KINDS, VERDICTS

TOPIC_FORM = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
ID_FORM = r"^[0-9a-f]{12}$"
LATENESS_TOLERANCE_MONTHS = 1
# A reporter's attribution closing a quote (fixed value).
REPORTED_SPEECH = (
    r"(?:\b(?:told|tells) (?:us|me|reporters|[A-Z][\w.]*)|\b(?:he|she|they|[A-Z][a-z]+) (?:said|says))[.,]?[\"”]?\s*$"
)


def _text(*parts: object) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("none")) if isinstance(p, Column) else F.lit(p) for p in parts])


def probability_step(p: Column) -> Column:
    return F.coalesce(p.between(0.05 - 1e-9, 0.95 + 1e-9) & (F.abs(p * 20 - F.floor(p * 20 + 0.5)) < 1e-9), F.lit(False))


def claim_problems(claims: DataFrame, today: dt.date) -> DataFrame:
    """(id, person_slug, said_date, severity, message): every rule in one pass over the rows, no shuffle."""
    c, now = F.col, F.lit(today)
    rules: list[Column] = []

    def check(severity: str, bad: Column, message: Column | str) -> None:
        text = message if isinstance(message, Column) else F.lit(message)
        rules.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(severity).alias("severity"), text.alias("message"))))

    def filled(col: Column) -> Column:
        return F.coalesce(F.trim(col) != "", F.lit(False))

    for key in ("id", "person", "person_slug", "quote", "claim", "topic", "resolution_criteria"):
        check("error", ~filled(c(key)), f"{key} is missing or empty")
    check("error", c("hedge").isNull(), 'hedge must be a string ("" when there is none)')
    check("error", c("quote_verified").isNull(), "quote_verified must be true or false")
    check("error", F.trim("quote").rlike(REPORTED_SPEECH), "quote ends in a reporter's attribution: quote the speaker's own words")
    last = F.element_at(F.split(F.trim("person"), r"\s+"), -1)
    third = (F.length(last) > 2) & F.array_contains(F.split(c("quote"), r"[^A-Za-z0-9_]+"), last)
    check("warning", third, _text("quote names ", last, " in the third person: check it is not a reporter's paraphrase"))
    check("error", c("said_date").isNull(), "said_date is not a calendar date")
    check("error", c("said_date") > now, _text("said_date ", c("said_date"), f" is after today ({today.isoformat()})"))
    slug = slugify(c("person"))
    check("error", filled(c("person")) & ~c("person_slug").eqNullSafe(slug), _text('person_slug should be "', slug, '"'))
    want = claim_id(c("person_slug"), c("said_date"), c("claim"))
    known = filled(c("person_slug")) & c("said_date").isNotNull() & filled(c("claim"))
    shaped = F.coalesce(c("id").rlike(ID_FORM), F.lit(False))
    check("error", known & ~shaped, _text('id "', c("id"), '" is not 12 hex characters (expected ', want, ")"))
    check("error", known & shaped & (c("id") != want), _text("id ", c("id"), " does not match its claim (expected ", want, ")"))
    check("error", ~F.coalesce(c("type").isin(*CLAIM_TYPES), F.lit(False)), _text('type "', c("type"), '" is not one of ' + ", ".join(CLAIM_TYPES)))
    check("error", filled(c("topic")) & ~c("topic").rlike(TOPIC_FORM), _text('topic "', c("topic"), '" is not kebab-case'))
    check("error", ~c("origin").eqNullSafe(F.lit("seed")), _text('origin must be "seed" (got "', c("origin"), '")'))
    dated = c("target_date").isNotNull()
    check("error", c("target_date") < c("said_date"), _text("target_date ", c("target_date"), " is before said_date"))
    check("error", dated & c("target_date_inferred").isNull(), "target_date_inferred must be true or false when target_date is set")
    check("warning", dated & (c("type") != "prediction"), _text("a ", c("type"), " usually has no target_date"))
    check("error", ~dated & (c("type") == "prediction"), "a prediction needs a target_date")
    step = probability_step(c("implied_probability"))
    check("error", ~step, _text("implied_probability ", c("implied_probability"), " is not a 0.05 step in [0.05, 0.95]"))
    table = claim_probability(c("hedge"), F.coalesce("claim", F.lit("")))
    off = step & (F.abs(table - c("implied_probability")) > 1e-9)
    check("warning", off, _text("implied_probability ", c("implied_probability"), " differs from the hedge table (", table, ' for "', c("hedge"), '")'))
    check("error", ~F.coalesce(c("specificity").between(1, 5), F.lit(False)), "specificity must be an integer 1-5")

    src = c("source")
    check("error", src.isNull(), "source is missing")
    check("error", src.isNotNull() & ~filled(src["title"]), "source.title is missing")
    check("error", src.isNotNull() & ~F.coalesce(is_http(src["url"]), F.lit(False)), _text('source.url "', src["url"], '" is not an http(s) URL'))
    check("error", src.isNotNull() & ~src["date"].eqNullSafe(c("said_date")), _text("source.date ", src["date"], " differs from said_date ", c("said_date")))
    check("error", src.isNotNull() & ~F.coalesce(src["kind"].isin(*SOURCE_KINDS), F.lit(False)), _text('source.kind "', src["kind"], '" is not one of ' + ", ".join(SOURCE_KINDS)))
    check("error", src["deep_link"].isNotNull() & ~is_http(src["deep_link"]), "source.deep_link is not an http(s) URL")

    v, g, target = c("verdict"), c("grading"), c("target_date")
    valid = F.coalesce(v.isin(*VERDICTS), F.lit(False))
    check("error", ~valid, _text('verdict "', v, '" is not one of ' + ", ".join(VERDICTS)))
    pending = valid & (v == "pending")
    check("error", pending & g.isNotNull(), "a pending claim must not carry a grading")
    check("warning", pending & (target <= now), _text("deadline ", target, " has passed: grade it"))
    judged = valid & (v != "pending")
    check("error", judged & g.isNull(), _text("verdict is ", v, " but there is no grading"))
    graded = judged & g.isNotNull()
    check("error", graded & ~g["verdict"].eqNullSafe(v), _text("grading.verdict ", g["verdict"], " differs from verdict ", v))
    check("error", graded & ~g["graded_by"].eqNullSafe(F.lit("human:seed")), _text('grading.graded_by must be "human:seed" (got "', g["graded_by"], '")'))
    check("error", graded & ~F.coalesce(g["confidence"].between(0, 1), F.lit(False)), "grading.confidence must be a number from 0 to 1")
    check("error", graded & ~filled(g["rationale"]), "grading.rationale is missing")
    check("error", graded & loaded_word(g["rationale"]).isNotNull(), _text('grading.rationale uses loaded wording ("', loaded_word(g["rationale"]), '"); describe outcomes, not motives'))
    check("error", graded & g["graded_at"].isNull(), "grading.graded_at is not an ISO timestamp")
    check("error", graded & g["evidence"].isNull(), "grading.evidence must be a list")
    needs = v.isin(*OUTCOME_VERDICTS)
    check("error", graded & needs & (F.size(g["evidence"]) == 0), _text("a ", v, " verdict needs at least one evidence URL"))
    resolved = g["resolved_on"]
    check("error", graded & (resolved > now), _text("grading.resolved_on ", resolved, f" is after today ({today.isoformat()})"))
    ahead = graded & (c("type") == "prediction") & (target > now) & resolved.isNull()
    check("error", ahead & (v == "correct"), _text("graded correct before the deadline (", target, ") without resolved_on"))
    check("warning", ahead & v.isin("incorrect", "partial"), _text("graded ", v, " before the deadline (", target, ")"))
    check("warning", graded & (v == "too_early") & (target <= now), _text("too_early, but the deadline ", target, " has passed: grade it"))
    # Three states: not recorded, recorded as never, recorded in months.
    stated, actual = g["lateness_applies"], g["lateness_months"]
    applies, expected = lateness_applies(v, target, resolved), lateness_months(v, target, resolved)
    recorded = graded & F.coalesce(stated, F.lit(False))
    check("warning", recorded & ~applies & actual.isNotNull(), _text("lateness_months ", actual, " is set, but there is no deadline or resolved_on to measure it from"))
    differs = F.coalesce(F.abs(actual - expected) > LATENESS_TOLERANCE_MONTHS, actual.isNull() != expected.isNull())
    check("warning", recorded & applies & differs, _text("lateness_months is ", actual, "; the grader would record ", expected))
    for key in ("claim", "resolution_criteria"):
        check("error", loaded_word(c(key)).isNotNull(), _text(f'{key} uses loaded wording ("', loaded_word(c(key)), '"); describe outcomes, not motives'))

    per_source = F.flatten(
        F.transform(
            F.when(graded, g["evidence"]),
            lambda e, k: F.array_compact(
                F.array(
                    F.when(
                        ~F.coalesce(is_http(e["url"]), F.lit(False)),
                        F.struct(F.lit("error").alias("severity"), F.concat(F.lit("evidence["), k.cast("string"), F.lit("].url is not an http(s) URL")).alias("message")),
                    ),
                    F.when(
                        F.coalesce(e["url"] == src["url"], F.lit(False)),
                        F.struct(
                            F.lit("warning").alias("severity"),
                            F.concat(F.lit("evidence["), k.cast("string"), F.lit("] is the claim's own source, which is not evidence of the outcome")).alias("message"),
                        ),
                    ),
                )
            ),
        )
    )
    none = F.array().cast("array<struct<severity:string,message:string>>")
    found = F.concat(F.array_compact(F.array(*rules)), F.coalesce(per_source, none))
    return claims.select("id", "person_slug", "said_date", F.explode(found).alias("p")).select("id", "person_slug", "said_date", "p.*")


def duplicate_ids(claims: DataFrame) -> DataFrame:
    return claims.groupBy("id").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def ledger_totals(claims: DataFrame) -> DataFrame:
    """Claims, distinct people and graded claims, exact."""
    per_person = claims.groupBy("person_slug").agg(F.count("*").alias("claims"), F.count("grading").alias("graded"))
    return per_person.agg(F.sum("claims").alias("claims"), F.count("*").alias("people"), F.sum("graded").alias("graded"))


__all__ = ["claim_problems", "duplicate_ids", "iso", "ledger_totals", "probability_step"]
