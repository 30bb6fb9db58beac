"""What is new, and the cards of followed people."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saidso.functions.wording import plain_verdict, short_text, topic_label
from saidso.operators.drift import drift_text, latest_move
from saidso.operators.ledger import is_open
from saidso.operators.scores import person_scorecard, record_line
from saidso.schemas import NOTABLE_DRIFT

FEED_MAX = 8
KIND_ORDER = ("came_due", "story_moved", "new_statements", "discovered", "coming_due")


def _shown_dates(s: Column) -> Column:
    """ISO dates inside a text as 'Mar 5, 2026'."""
    iso = r"\b\d{4}-\d{2}-\d{2}\b"
    plain = F.split(s, iso)
    dates = F.transform(F.regexp_extract_all(s, F.lit(f"({iso})"), F.lit(1)), lambda d: F.coalesce(F.date_format(F.try_to_date(d), "MMM d, yyyy"), d))
    return F.array_join(F.zip_with(plain, F.concat(dates, F.array(F.lit(""))), lambda p, d: F.concat(p, d)), "")


def _short(s: Column, limit: int = 90) -> Column:
    return short_text(_shown_dates(s), limit)


def feed_items(claims: DataFrame, today: dt.date, discoveries: DataFrame | None = None, watchlist: DataFrame | None = None) -> DataFrame:
    """(kind, date, text, person_slug, ref): every item, before the cut. `discoveries`: person_slug, status, checked_at."""
    day = F.lit(today)
    recent, year_ago, month_on = F.date_sub(day, 30), F.date_sub(day, 365), F.date_add(day, 31)
    added = F.col("extracted_at").cast("date")
    source = F.coalesce(F.nullif("source.url", F.lit("")), F.col("source.title"))

    def item(df: DataFrame, kind: str, date: Column, text: Column, ref: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), date.alias("date"), text.alias("text"), "person_slug", ref.alias("ref"))

    def plural(n: Column, one: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))

    fresh = (
        claims.where((F.col("origin") == "extracted") & (added > recent) & (added <= day))
        .groupBy("person_slug", source.alias("src"))
        .agg(F.count("*").alias("n"), F.max(added).alias("d"), F.min(F.struct("said_date", "id", "person", "source.title"))["title"].alias("title"), F.min("person").alias("who"))
    )
    new = item(fresh, "new_statements", F.col("d"), F.concat(plural(F.col("n"), "new statement"), F.lit(" from \""), _short(F.col("title"), 70), F.lit("\" ("), "who", F.lit(")")), F.col("src"))
    dated = claims.where((F.col("type") == "prediction") & F.col("target_date").isNotNull())
    outcome = F.when(is_open(), "Waiting to be graded.").otherwise(F.concat(plain_verdict(F.col("verdict")), F.lit(".")))
    passed = item(
        dated.where((F.col("target_date") > recent) & (F.col("target_date") <= day)), "came_due", F.col("target_date"),
        F.concat(F.lit("Deadline passed: \""), _short(F.col("claim")), F.lit("\" ("), "person", F.lit("). "), outcome), F.col("id"),
    )
    ahead = item(
        dated.where((F.col("target_date") > day) & (F.col("target_date") <= month_on) & is_open()), "coming_due", F.col("target_date"),
        F.concat(F.lit("Due "), F.date_format("target_date", "MMM d, yyyy"), F.lit(": \""), _short(F.col("claim")), F.lit("\" ("), "person", F.lit(")")), F.col("id"),
    )
    lately = F.coalesce(added > recent, F.lit(False)) | ((F.col("said_date") > year_ago) & (F.col("said_date") <= day))
    moved = item(
        claims.where(F.col("drift.label").isin(*NOTABLE_DRIFT) & lately), "story_moved", F.col("said_date"),
        F.concat("person", F.lit(": "), F.lower(drift_text(F.col("drift.label"))), F.lit(" on "), topic_label(F.col("topic")), F.lit(". "), _short(F.col("drift.note"), 110)), F.col("id"),
    )
    out = new.unionByName(passed).unionByName(ahead).unionByName(moved)
    if discoveries is None:
        return out
    found = discoveries.groupBy("person_slug").agg(F.count_if(F.col("status") == "new").alias("n"), F.max("checked_at").cast("date").alias("d")).where(F.col("n") > 0)
    names = claims.groupBy("person_slug").agg(F.min(F.struct("said_date", "id", "person"))["person"].alias("on_record"))
    f = found.join(names, "person_slug", "left")
    if watchlist is not None:
        f = f.join(watchlist.select(F.col("slug").alias("person_slug"), F.col("name").alias("typed")), "person_slug", "left")
    else:
        f = f.withColumn("typed", F.lit(None).cast("string"))
    who = F.coalesce("typed", "on_record", "person_slug")
    return out.unionByName(item(f, "discovered", F.col("d"), F.concat(F.lit("Found "), plural(F.col("n"), "new appearance"), F.lit(" for "), who), F.col("person_slug")))


def whats_new(items: DataFrame, top: int = FEED_MAX) -> DataFrame:
    """Newest first, then kind, then text; a top-k, so each task keeps only `top` rows."""
    order = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    return items.orderBy(F.col("date").desc(), order, F.col("text"), "ref").limit(top)


def people_cards(claims: DataFrame, watchlist: DataFrame, discoveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards of followed people, most recently active first; everyone else on record by predictions)."""
    scores = person_scorecard(claims)
    last = claims.groupBy("person_slug").agg(F.max("said_date").alias("last_statement"))
    moved = latest_move(claims)
    story = moved.select(
        "person_slug", F.concat(F.lit("Story moved on "), topic_label(F.col("topic")), F.lit(" ("), F.lower(drift_text(F.col("label"))), F.lit(")")).alias("story_moved")
    )
    new = discoveries.groupBy("person_slug").agg(F.count_if(F.col("status") == "new").alias("new_appearances"))
    w = watchlist.select(F.col("slug").alias("person_slug"), F.col("name").alias("typed"), "last_checked_at")
    cards = w.join(scores, "person_slug", "left").join(last, "person_slug", "left").join(story, "person_slug", "left").join(new, "person_slug", "left")
    active = F.greatest(F.col("last_checked_at").cast("date"), F.col("last_statement"))
    cards = cards.select(
        "person_slug", F.coalesce("person", "typed").alias("name"),
        F.when(F.col("claims").isNull(), "Nothing on record yet").otherwise(record_line()).alias("record"),
        F.coalesce(F.col("pending") + F.col("too_early"), F.lit(0)).alias("waiting"), F.coalesce("claims", F.lit(0)).alias("claims"), "last_statement", "last_checked_at",
        F.coalesce("new_appearances", F.lit(0)).alias("new_appearances"), "story_moved", active.alias("active"),
    ).orderBy(F.col("active").desc_nulls_last(), F.collate(F.col("name"), "UNICODE"), "person_slug")
    others = scores.join(w, "person_slug", "left_anti").select("person_slug", "person", "predictions").orderBy(
        F.col("predictions").desc(), F.collate(F.col("person"), "UNICODE"), "person_slug"
    )
    return cards, others
