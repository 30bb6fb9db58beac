"""What an external take store still needs from the ledger, as a table of actions.

The store keeps, per person page, timeline entries and numbered takes; a take's
resolution is immutable. Nothing is written here: the plan is the diff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saidso.functions.wording import (
    numbered_summary, take_kind, take_quality, take_source, take_text, timeline_summary,
)
from saidso.session import materialize


def page() -> Column:
    return F.concat(F.lit("people/"), F.col("person_slug"))


def resolvable() -> Column:
    """The quality to resolve a claim's take with; only undisputed predictions with an outcome have one."""
    open_to = (F.col("type") == "prediction") & ~F.coalesce(F.col("grading.disputed"), F.lit(False))
    return F.when(open_to, take_quality(F.col("verdict")))


def needs_sync() -> Column:
    quality = resolvable()
    return (
        ~F.coalesce(F.col("link.timeline_written"), F.lit(False))
        | F.col("link.row").isNull()
        | (quality.isNotNull() & ~quality.eqNullSafe(F.col("link.resolved_quality")))
    )


def shared_quotes(claims: DataFrame) -> DataFrame:
    """(id, index, total) of claims that share one quote on one day; unique quotes are absent.

    The summary travels as a hash, and single-claim groups drop out before the
    window, which then only sees claims split from one sentence. Hashes are
    written once: read twice and asked for nulls, a summary was built three times.
    """
    keyed = materialize(
        claims.select("id", "person_slug", "said_date", F.sha2(timeline_summary(F.col("source"), F.col("quote")), 256).alias("quote_hash"))
    )
    group = ("person_slug", "said_date", "quote_hash")
    many = keyed.groupBy(*group).agg(F.count("*").alias("total")).where(F.col("total") > 1)
    place = F.row_number().over(W.partitionBy(*group).orderBy("id"))
    return keyed.join(many, list(group)).select("id", place.alias("index"), "total")


def match_takes(claims: DataFrame, takes: DataFrame) -> DataFrame:
    """(id, row_num, held) for unlinked claims that already have a take; each take is used once.

    Claims and active takes pair off inside (holder, kind, text, source) by rank:
    the n-th such claim in ledger order takes the n-th such row.
    """
    key = ["holder", "kind", "text", "source"]
    wanted = claims.select(
        "id", "said_date", "person_slug", page().alias("holder"), take_kind(F.col("type")).alias("kind"),
        take_text(F.col("claim"), F.col("target_date")).alias("text"), take_source(F.col("source"), F.col("said_date")).alias("source"),
    ).withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("person_slug", "said_date", "id")))
    held = takes.where(F.coalesce("active", F.lit(True))).select(
        "row_num", "holder", "kind", F.col("claim").alias("text"), F.coalesce("source", F.lit("")).alias("source"),
        F.col("resolved_quality").alias("held"),
    ).withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("row_num")))
    return wanted.join(held, [*key, "n"]).select("id", "row_num", "held")


def sync_plan(claims: DataFrame, takes: DataFrame) -> DataFrame:
    """Actions (id, page, action, row, quality, held, text): add_timeline, link_take, add_take, resolve, record, conflict, foreign_take."""
    todo = claims.where(needs_sync())
    linked = todo.where(F.col("link.row").isNotNull()).select("id", page().alias("holder"), F.col("link.row").alias("row_num"))
    used = linked.select("holder", "row_num").distinct()
    free = takes.join(used, ["holder", "row_num"], "left_anti")
    matched = match_takes(todo.where(F.col("link.row").isNull()), free)
    on_row = takes.select(
        F.col("holder").alias("_h"), F.col("row_num").alias("_r"), F.col("claim").alias("row_text"), F.col("resolved_quality").alias("row_held")
    )
    t = (
        todo.join(matched, "id", "left")
        .join(shared_quotes(todo), "id", "left")
        .withColumn("page", page())
        .withColumn("row", F.coalesce("link.row", "row_num"))
        .withColumn("own_text", take_text(F.col("claim"), F.col("target_date")))
        .join(on_row, (F.col("page") == F.col("_h")) & (F.col("row") == F.col("_r")), "left")
    )
    quality, recorded = resolvable(), F.col("link.resolved_quality")
    text = F.col("own_text")
    ours = F.col("row_text").eqNullSafe(text)
    held = F.col("row_held")
    open_resolution = quality.isNotNull() & recorded.isNull()
    fresh_take = F.col("row").isNull()

    def act(when: Column, name: str, detail: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(name).alias("action"), F.col("row").cast("int").alias("row"), quality.alias("quality"), F.coalesce(held, recorded).alias("held"),
                detail.alias("text"),
            ),
        )

    summary = numbered_summary(timeline_summary(F.col("source"), F.col("quote")), F.col("index"), F.col("total"))
    actions = F.array_compact(
        F.array(
            act(~F.coalesce(F.col("link.timeline_written"), F.lit(False)), "add_timeline", summary),
            act(F.col("row_num").isNotNull(), "link_take", text),
            act(fresh_take, "add_take", text),
            act(open_resolution & (fresh_take | (ours & held.isNull())), "resolve", text),
            act(open_resolution & ~fresh_take & ~ours, "foreign_take", text),
            act(open_resolution & ours & (held == quality), "record", text),
            act(open_resolution & ours & (held != quality), "conflict", text),
            act(recorded.isNotNull() & (recorded != quality) & ~fresh_take, "conflict", text),
        )
    )
    return t.select("id", "person_slug", "page", F.explode(actions).alias("a")).select("id", "person_slug", "page", "a.*")


def apply_plan(claims: DataFrame, plan: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Link state after the plan ran; `new_rows` (id, row) are the numbers the store gave added takes."""
    done = plan.groupBy("id").agg(
        F.bool_or(F.col("action") == "add_timeline").alias("wrote"),
        F.max(F.when(F.col("action") == "link_take", F.col("row"))).alias("linked_row"),
        F.max(F.when(F.col("action") == "resolve", F.col("quality"))).alias("pushed"),
        F.max(F.when(F.col("action").isin("record", "conflict"), F.col("held"))).alias("found"),
    )
    added = new_rows.select("id", F.col("row").cast("int").alias("added_row"))
    j = claims.join(done, "id", "left").join(added, "id", "left")
    link = F.struct(
        page().alias("page"), F.coalesce("link.row", "linked_row", "added_row").alias("row"),
        (F.coalesce("link.timeline_written", F.lit(False)) | F.coalesce("wrote", F.lit(False))).alias("timeline_written"),
        F.coalesce("link.resolved_quality", "pushed", "found").alias("resolved_quality"),
    )
    touched = F.col("wrote").isNotNull()
    return j.withColumn("link", F.when(touched, link).otherwise(F.col("link"))).select(*claims.columns)


def forget_links(claims: DataFrame, slug: str | None = None) -> DataFrame:
    """Drop link state for one person or everyone, so the next plan matches takes again."""
    if slug is None:
        return claims.withColumn("link", F.lit(None).cast(claims.schema["link"].dataType))
    return claims.withColumn("link", F.when(F.col("person_slug") != slug, F.col("link")))


def track_record(scores: DataFrame, topics: DataFrame, summaries: DataFrame) -> DataFrame:
    """Track-record export lines, one row each: (person_slug, section, sort_key, line)."""

    def pct(x: Column) -> Column:
        return F.coalesce(F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%")), F.lit("n/a"))

    def t(*parts: object) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    c = F.col
    head = scores.select(
        "person_slug",
        F.explode(
            F.array_compact(
                F.array(
                    t("Claims tracked: ", c("claims"), " (", c("predictions"), " predictions)"),
                    t("Predictions: ", c("correct"), " correct, ", c("incorrect"), " incorrect, ", c("partial"), " partial, ", c("unresolvable"),
                      " unresolvable, ", c("too_early"), " too early, ", c("pending"), " pending"),
                    t("Accuracy: ", pct(c("accuracy")), " (", c("correct"), " of ", c("correct") + c("incorrect"), " resolved correct/incorrect)"),
                    t("Brier: ", F.when(c("brier").isNotNull(), F.format_string("%.3f", c("brier"))).otherwise("n/a"), " (coin-flip baseline 0.25; lower is better)"),
                    F.when(c("lateness_multiplier").isNotNull(), t("Lateness: ", F.format_string("%.1f", c("lateness_multiplier")), "× the promised time (median of late-but-true predictions)")),
                    t("Drift events: ", c("drift_events")),
                )
            )
        ).alias("line"),
    ).select("person_slug", F.lit("summary").alias("section"), F.lit("").alias("sort_key"), "line")
    by_topic = topics.select(
        "person_slug", F.lit("topic").alias("section"), F.concat(F.format_string("%012d", F.lit(10**11) - c("predictions")), c("topic")).alias("sort_key"),
        t(c("topic"), ": ", c("predictions"), " predictions, ", c("correct"), " correct, ", c("incorrect"), " incorrect, ", c("partial"),
          " partial (accuracy ", pct(c("accuracy")), ")").alias("line"),
    )
    stories = summaries.where(c("claims") >= 2).select(
        "person_slug", F.lit("story").alias("section"), c("topic").alias("sort_key"), t(c("topic"), ": ", c("summary")).alias("line")
    )
    return head.unionByName(by_topic).unionByName(stories)
