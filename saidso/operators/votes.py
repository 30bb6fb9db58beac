"""Judge votes to verdicts: deadline gate, tie-break demand, majority, evidence, grading."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saidso.functions.binding import let
from saidso.functions.dates import calendar_date, iso, lateness_applies, lateness_months
from saidso.functions.urls import page_ref, url_key
from saidso.functions.wording import neutral_or, neutral_rationale
from saidso.schemas import GRADED_VERDICTS
from saidso.session import materialize

MAX_EVIDENCE = 5
DEADLINE_RULE = "rule:deadline"
UNITS = 1_000_000


def normalize_confidence(x: Column) -> Column:
    """0..1; some judges answer in percent, and anything that is not a number counts as 0."""
    x = x.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    scaled = F.when((x > 1) & (x <= 100), x / 100).otherwise(x)
    return F.when(bad, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def deadline_gate(claims: DataFrame, today: dt.date) -> DataFrame:
    """Claims whose deadline is still ahead, decided without reading any vote."""
    rationale = F.concat(
        F.lit("The deadline ("), iso(F.col("target_date")), F.lit(f") has not passed yet (today is {today.isoformat()}).")
    )
    return claims.where(F.col("target_date") > F.lit(today)).select(
        "id", F.lit("too_early").alias("verdict"), F.lit(1.0).alias("confidence"), rationale.alias("rationale"),
        F.lit(DEADLINE_RULE).alias("graded_by"),
    )


def past_gate(claims: DataFrame, today: dt.date) -> DataFrame:
    """The rest: filter with this before joining votes."""
    return claims.where(F.col("target_date").isNull() | (F.col("target_date") <= F.lit(today)))


def tie_break_demand(votes: DataFrame) -> DataFrame:
    """Claims whose two judges disagree and so need a third."""
    return (
        votes.groupBy("claim_id")
        .agg(F.count("*").alias("n"), (F.min("verdict") != F.max("verdict")).alias("split"))
        .where((F.col("n") == 2) & F.col("split"))
        .select("claim_id", F.lit("C").alias("judge"))
    )


def combine_votes(votes: DataFrame) -> DataFrame:
    """Verdict per claim by strict majority; no majority is a disputed 'unresolvable'.

    Two aggregations with map-side combine: per (claim, verdict), then per claim.
    `votes`: claim_id, judge, verdict, confidence; judge order is alphabetical.
    """
    conf = F.floor(normalize_confidence(F.col("confidence")) * UNITS + 0.5).cast("long")
    # Most confident first, earlier judge on ties.
    lead = F.struct((-conf).alias("c"), F.col("judge"))
    per_verdict = votes.groupBy("claim_id", "verdict").agg(
        F.count("*").alias("n"), F.sum(conf).alias("conf_sum"), F.min(lead)["judge"].alias("lead"), F.min(lead).alias("lead_key")
    )
    total = F.sum("n")
    top = F.max(F.struct("n", "verdict", "conf_sum", "lead"))
    majority = F.col("top.n") >= F.floor(F.col("votes") / 2) + 1
    return (
        per_verdict.groupBy("claim_id")
        .agg(total.alias("votes"), top.alias("top"), F.min("lead_key")["judge"].alias("any_lead"))
        .select(
            "claim_id",
            F.when(majority, F.col("top.verdict")).otherwise("unresolvable").alias("verdict"),
            F.when(majority, round2(F.col("top.conf_sum") / (F.col("top.n") * float(UNITS)))).otherwise(0.5).alias("confidence"),
            (~majority).alias("disputed"),
            F.when(majority, F.col("top.n")).otherwise(F.col("votes")).alias("winners"),
            F.when(majority, F.col("top.lead")).otherwise(F.col("any_lead")).alias("lead"),
            "votes",
        )
    )


def verified_evidence(evidence: Column, citations: Column, searched: Column) -> Column:
    """A judge's evidence whose page its own search cited or read; the arrays of one row, so no join."""
    found = F.array_compact(
        F.transform(F.concat(F.coalesce(citations, F.array()), F.coalesce(searched, F.array())), lambda c: url_key(c["url"]))
    )
    return let(found, lambda keys: F.filter(evidence, lambda e: F.coalesce(F.array_contains(keys, url_key(e["url"])), F.lit(False))))


def verified_evidence_rows(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """The same on flat tables: evidence (claim_id, judge, url, …) kept when the judge's pages (claim_id, judge, url) hold its key.

    Either table may carry `ref` already, as `with_refs` adds it.
    """
    # Different stand-ins for "no key", so two unusable URLs never meet.
    key = let(_ref(pages)["key"], lambda k: F.when(k == "", "?").otherwise(k))
    keys = pages.select("claim_id", "judge", key.alias("key")).distinct()
    return evidence.withColumn("key", _ref(evidence)["key"]).join(keys, ["claim_id", "judge", "key"], "left_semi")


def _ref(rows: DataFrame) -> Column:
    return F.col("ref") if "ref" in rows.columns else page_ref(F.col("url"))


def with_refs(rows: DataFrame) -> DataFrame:
    """`rows` written once with `ref`, their parsed URL, for jobs that read it several times. Many rows share a URL: each is parsed once."""
    refs = materialize(rows.select(F.col("url").alias("_page")).distinct().withColumn("ref", page_ref(F.col("_page"))), plain=True)
    return materialize(rows.join(refs, F.col("url").eqNullSafe(F.col("_page")), "left").drop("_page"))


def merge_evidence(evidence: DataFrame, cited: DataFrame, claims: DataFrame) -> DataFrame:
    """Up to five sources per claim, one judge's next source at a time, then cited pages; dated-after-deadline first.

    `evidence`: claim_id, judge, pos, url, title, date, snippet (verified, of winning judges);
    `cited`: claim_id, judge, pos, url, title; `claims`: claim_id, own_url, target_date.

    Lossless bound: five places exist, and a judge's turn only skips pages already
    taken, so no judge is ever asked for more than its first five distinct pages,
    nor the cited list for more than its first ten. Both cuts happen before the
    shuffle (row-number group limits), so a claim never gathers more than that.
    """
    own = claims.select("claim_id", url_key(F.col("own_url")).alias("own_key"), "target_date")
    shared = ["claim_id", "judge", "pos", "title"]
    ev = evidence.select(*shared, "date", "snippet", _ref(evidence).alias("ref"), F.lit(0).alias("tier"))
    ct = cited.select(
        *shared, F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("snippet"), _ref(cited).alias("ref"), F.lit(1).alias("tier")
    )
    rows = ev.unionByName(ct).select(*shared, "date", "snippet", "tier", "ref.url", "ref.key")
    # Evidence queues are per judge; cited pages form one queue in judge order.
    queue = F.when(F.col("tier") == 0, F.col("judge")).otherwise(F.lit("~cited"))
    first = rows.groupBy("claim_id", "tier", queue.alias("queue"), "key").agg(
        F.min(F.struct("judge", "pos", "url", "title", "date", "snippet")).alias("r")
    )
    usable = first.join(own, "claim_id", "left").where(F.col("own_key").isNull() | (F.col("key") != F.col("own_key")))
    # URLs without a key go last and drop out after the cut.
    order = [F.col("key") == "", F.col("r.judge"), F.col("r.pos"), F.col("key")]
    rank = F.row_number().over(W.partitionBy("claim_id", "tier", "queue").orderBy(*order))
    head = usable.withColumn("rank", rank).where(F.col("rank") <= 2 * MAX_EVIDENCE).where(F.col("key") != "").where((F.col("tier") == 1) | (F.col("rank") <= MAX_EVIDENCE))
    item = F.struct("rank", "queue", "key", F.struct("r.url", "r.title", "r.date", "r.snippet").alias("e"))
    grouped = head.groupBy("claim_id").agg(
        F.first("target_date").alias("target_date"),
        F.sort_array(F.collect_list(F.when(F.col("tier") == 0, item))).alias("items"),
        F.sort_array(F.collect_list(F.when(F.col("tier") == 1, item))).alias("pages"),
    )
    judges = F.array_sort(F.array_distinct(F.transform("items", lambda x: x["queue"])))
    turns = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(MAX_EVIDENCE)), lambda _: F.col("judges")))

    def room(acc: Column) -> Column:
        return F.size(acc) < MAX_EVIDENCE

    def untaken(acc: Column, x: Column) -> Column:
        return ~F.exists(acc, lambda t: t["key"] == x["key"])

    def turn(acc: Column, judge: Column) -> Column:
        left = F.filter(F.col("items"), lambda x: (x["queue"] == judge) & untaken(acc, x))
        return F.when(room(acc), F.concat(acc, F.slice(left, 1, 1))).otherwise(acc)

    def page(acc: Column, x: Column) -> Column:
        return F.when(room(acc) & untaken(acc, x), F.concat(acc, F.array(x))).otherwise(acc)

    none = F.slice(F.col("items"), 1, 0)
    out = (
        grouped.withColumn("judges", judges)
        .withColumn("taken", F.aggregate(turns, none, turn))
        .withColumn("taken", F.aggregate(F.col("pages"), F.col("taken"), page))
    )
    ordered = F.sort_array(
        F.transform(
            "taken",
            lambda t, i: F.struct(
                F.when(t["e"]["date"] >= F.col("target_date"), 0).otherwise(1).alias("before"), i.alias("i"), t["e"].alias("e")
            ),
        )
    )
    return out.select("claim_id", F.transform(ordered, lambda x: x["e"]).alias("evidence"))


JUDGE_NAMES = {"A": "strict reading", "B": "charitable reading", "C": "tie-break"}


def grade(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Judge results to gradings: (claim_id, verdict, grading, ungraded_reason).

    `claims`: id, target_date, source. `results`: claim_id, judge, model, verdict,
    confidence, rationale, resolved_on, evidence, citations, searched; one row per
    judge, at most three judges per claim. An outcome verdict without any verified
    source stays ungraded with a reason.
    """
    # Read by the winners and by the result, and the winners by their evidence and their pages: each written once.
    combined = materialize(combine_votes(results))
    vote = F.struct(
        F.col("judge"), F.col("model"), F.col("verdict"), round2(normalize_confidence(F.col("confidence"))).alias("confidence"),
        F.trim("rationale").alias("rationale"), calendar_date(F.col("resolved_on").cast("string")).alias("resolved_on"),
    )
    panel = results.groupBy("claim_id").agg(F.sort_array(F.collect_list(vote)).alias("panel"))
    winners = results.join(combined.select("claim_id", F.col("verdict").alias("won"), "disputed"), "claim_id").where(
        ~F.col("disputed") & (F.col("verdict") == F.col("won")) & F.col("won").isin(*GRADED_VERDICTS)
    )
    ok = verified_evidence(F.col("evidence"), F.col("citations"), F.col("searched"))
    checked = materialize(winners.select("claim_id", "judge", ok.alias("ok"), "citations"))
    blank = F.lit(None).cast("string")
    ev = checked.select("claim_id", "judge", F.posexplode("ok").alias("pos", "e")).select(
        "claim_id", "judge", "pos", "e.url", F.nullif(F.trim("e.title"), F.lit("")).alias("title"),
        calendar_date(F.col("e.date").cast("string")).alias("date"), F.nullif(F.trim("e.snippet"), F.lit("")).alias("snippet"),
    )
    cited = checked.select("claim_id", "judge", F.posexplode("citations").alias("pos", "c")).select(
        "claim_id", "judge", "pos", "c.url", F.nullif(F.col("c.title"), F.lit("")).alias("title")
    )
    about = claims.select(F.col("id").alias("claim_id"), F.col("source.url").alias("own_url"), "target_date")
    merged = merge_evidence(ev, cited, about)
    j = combined.join(panel, "claim_id").join(merged, "claim_id", "left").join(about, "claim_id")
    wins = F.when(F.col("disputed"), F.col("panel")).otherwise(F.filter("panel", lambda v: v["verdict"] == F.col("verdict")))
    lead = F.element_at(F.filter("panel", lambda v: v["judge"] == F.col("lead")), 1)
    dates = F.filter(F.transform(F.concat(F.array(lead), wins), lambda v: v["resolved_on"]), lambda d: d.isNotNull())
    resolved = F.when(~F.col("disputed"), F.try_element_at(dates, F.lit(1)))
    names = F.create_map(*[F.lit(x) for kv in JUDGE_NAMES.items() for x in kv])
    split = F.array_join(
        F.transform(
            "panel",
            lambda v: F.concat(F.coalesce(F.try_element_at(names, v["judge"]), v["judge"]), F.lit(": "), F.regexp_replace(v["verdict"], "_", " ")),
        ),
        ", ",
    )
    rationale = F.when(
        F.col("disputed"), F.concat(F.lit("The judges disagreed ("), split, F.lit("), so no verdict is recorded."))
    ).otherwise(neutral_or(lead["rationale"], neutral_rationale(F.col("verdict"), F.col("target_date"), resolved)))
    no_sources = F.array().cast("array<struct<url:string,title:string,date:date,snippet:string>>")
    needs = F.col("verdict").isin(*GRADED_VERDICTS)
    evidence = F.when(needs, F.coalesce("evidence", no_sources)).otherwise(no_sources)
    grading = F.struct(
        F.col("verdict"), F.col("confidence"), rationale.alias("rationale"), evidence.alias("evidence"), resolved.alias("resolved_on"),
        lateness_applies(F.col("verdict"), F.col("target_date"), resolved).alias("lateness_applies"),
        lateness_months(F.col("verdict"), F.col("target_date"), resolved).alias("lateness_months"),
        F.lit(None).cast("timestamp").alias("graded_at"),
        F.array_join(F.array_distinct(F.transform("panel", lambda v: v["model"])), "+").alias("graded_by"),
        F.transform(
            "panel",
            lambda v: F.struct(F.concat(v["model"], F.lit("#"), v["judge"]).alias("judge"), v["verdict"].alias("verdict"), v["confidence"].alias("confidence")),
        ).alias("judges"),
        F.when(F.col("disputed"), F.lit(True)).alias("disputed"),
    )
    bare = needs & (F.size(evidence) == 0)
    reason = F.when(
        bare,
        F.concat(F.lit("the judges said "), F.col("verdict"), F.lit(", but none of their evidence links came from their web search, so no verdict is recorded")),
    ).otherwise(blank)
    return j.select("claim_id", F.when(~bare, F.col("verdict")).alias("verdict"), F.when(~bare, grading).alias("grading"), reason.alias("ungraded_reason"))
