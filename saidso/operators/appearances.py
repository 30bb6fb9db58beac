"""Episodes that could be ingested: validation, ranking, what is already held, discovery state, re-check cadence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saidso.functions import urls as U
from saidso.functions.dates import calendar_date
from saidso.functions.wording import collapse
from saidso.session import materialize

MIN_DURATION_MIN = 10
FALLBACK_MIN_DURATION_MIN = 5
DEFAULT_LIMIT, MAX_LIMIT = 5, 10
WATCH_MAX_PEOPLE = 10


def appearance_key(url: Column) -> Column:
    return F.coalesce(U.source_key(url), url)


def validate(raw: DataFrame, searched: DataFrame, today: dt.date, since: dt.date) -> DataFrame:
    """Every proposed appearance with `kept` and, when dropped, the `reason`; the first rule that fails decides.

    `raw`: person_slug, ordinal, title, show, host, date (string), url, kind,
    duration_min, transcript_source, why. `searched`: person_slug, url of the pages
    the search returned. Clips of 5 to 10 minutes stay only when a person's run has
    nothing longer.
    """
    listed = searched.select("person_slug", F.explode(F.array_distinct(F.array_compact(F.array(U.source_key(F.col("url")), U.url_key(F.col("url")))))).alias("found")).distinct()
    any_listed = listed.select("person_slug").distinct().withColumn("searched", F.lit(True))
    given = F.trim("url")
    public = U.public_url(given)
    r = raw.withColumn("_given", given).withColumn("_public", public)
    r = r.withColumn("url", F.when(F.col("_public"), U.mirror_to_canonical(U.strip_signed_params(F.col("_given")))).otherwise(F.col("_given")))
    r = r.withColumn("_source", U.source_key(F.col("url"))).withColumn("_page", U.url_key(F.col("url")))
    day = calendar_date(F.trim("date"))
    r = materialize(
        r.withColumn("date", F.when(day <= F.lit(today), day))
        .withColumn("title", collapse(F.coalesce("title", F.lit(""))))
        .withColumn("why", collapse(F.coalesce("why", F.lit(""))))
        .withColumn("show", collapse(F.coalesce("show", F.lit(""))))
        .withColumn("host", F.nullif(collapse(F.coalesce("host", F.lit(""))), F.lit("")))
        .withColumn("duration_min", F.when(F.col("duration_min") > 0, F.floor(F.col("duration_min") + 0.5)).cast("int"))
        .withColumn("transcript_source", U.transcript_source(F.col("url"), F.col("transcript_source")))
        .withColumn("key", F.coalesce("_source", "url"))
    )
    confirmed = (
        r.select("person_slug", "ordinal", F.explode(F.array_compact(F.array("_source", "_page"))).alias("found"))
        .join(listed, ["person_slug", "found"], "left_semi")
        .select("person_slug", "ordinal")
        .distinct()
        .withColumn("link_confirmed", F.lit(True))
    )
    r = r.join(confirmed, ["person_slug", "ordinal"], "left").join(any_listed, "person_slug", "left")
    r = r.withColumn("link_confirmed", F.coalesce("link_confirmed", F.lit(False)))
    unlisted = F.coalesce("searched", F.lit(False)) & ~F.col("link_confirmed") & (F.col("transcript_source") != "youtube")
    reason = (
        F.when(~F.col("_public"), "not a public web link")
        .when(U.is_social(F.col("url")), "a social media post")
        .when(F.col("date") < F.lit(since), "older than the window")
        .when((F.col("title") == "") | (F.col("why") == ""), "missing a title or description")
        .when(unlisted, "link not found in the search results")
        .when(U.is_short(F.col("url")), "a YouTube Short")
    )
    r = r.withColumn("reason", reason)
    # Long enough: the first of each key stays. Too short: a duplicate when a longer one came before it.
    fine = F.col("reason").isNull()
    long_enough = F.col("duration_min").isNull() | (F.col("duration_min") >= MIN_DURATION_MIN)
    firsts = r.where(fine & long_enough).groupBy("person_slug", "key").agg(F.min("ordinal").alias("first"))
    kept_any = firsts.groupBy("person_slug").agg(F.lit(True).alias("any_long"))
    clips = r.where(fine & ~long_enough & (F.col("duration_min") >= FALLBACK_MIN_DURATION_MIN)).groupBy("person_slug", "key").agg(F.min("ordinal").alias("first_clip"))
    j = r.join(firsts, ["person_slug", "key"], "left").join(kept_any, "person_slug", "left").join(clips, ["person_slug", "key"], "left")
    last = (
        F.when(F.col("first") < F.col("ordinal"), "a duplicate")
        .when(F.col("duration_min") < FALLBACK_MIN_DURATION_MIN, "a short clip")
        .when(~long_enough & F.coalesce("any_long", F.lit(False)), "a short clip")
        .when(~long_enough & (F.col("first_clip") < F.col("ordinal")), "a duplicate")
    )
    j = j.withColumn("reason", F.coalesce("reason", last))
    return j.select(
        "person_slug", "ordinal", "title", "show", "host", "date", "url", "kind", "duration_min", "transcript_source", "why", "link_confirmed", "key",
        F.col("reason").isNull().alias("kept"), "reason",
    )


def first_wins(df: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Rows with `duplicate`: true for all but the first of each key; an aggregate, so a hot key never fills a window."""
    first = df.groupBy(*keys).agg(F.min(ordinal).alias("_first"))
    return df.join(first, keys, "left").withColumn("duplicate", F.col(ordinal) > F.col("_first")).drop("_first")


def split_held(kept: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, have): appearances whose source no claim cites yet, and those already in the ledger."""
    held = claims.select(U.source_key(F.col("source.url")).alias("key")).where(F.col("key").isNotNull()).distinct()
    return kept.join(held, "key", "left_anti"), kept.join(held, "key", "left_semi")


def appearance_order() -> list[Column]:
    """Readable first, newest first with undated last, transcript source, longer, title."""
    readable = F.col("transcript_source").isin("youtube", "page")
    source = F.when(F.col("transcript_source") == "youtube", 0).when(F.col("transcript_source") == "page", 1).when(F.col("transcript_source") == "audio", 2).otherwise(3)
    return [
        readable.desc(), F.col("date").desc_nulls_last(), source, F.coalesce("duration_min", F.lit(0)).desc(), F.collate(F.col("title"), "UNICODE"), F.col("ordinal"),
    ]


def rank_appearances(fresh: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The best appearances per person, with `place`; a row-number limit cuts each person's list before the shuffle."""
    n = min(MAX_LIMIT, max(1, int(limit)))
    return fresh.withColumn("place", F.row_number().over(W.partitionBy("person_slug").orderBy(*appearance_order()))).where(F.col("place") <= n)


def record_discovery(previous: DataFrame, run: DataFrame, now: dt.datetime) -> DataFrame:
    """Discovery state after a run: earlier status, dates and errors stay; rows the run did not return stay after the fresh ones.

    `previous`: person_slug, key, place, url, title, status, found_at, pulled_at, claims_added, error.
    `run`: person_slug, key, place, url, title, in_ledger. Only people in `run` change.
    """
    keys = ["person_slug", "key"]
    first = run.groupBy(*keys).agg(F.min_by(F.struct("place", "url", "title", "in_ledger"), "place").alias("r")).select(*keys, "r.*")
    old = previous.select(*keys, *[F.col(c).alias(f"old_{c}") for c in previous.columns if c not in keys])
    j = first.withColumn("_now", F.lit(True)).join(old, keys, "full_outer")
    was, have = F.col("old_status"), F.coalesce("in_ledger", F.lit(False))
    status = (
        F.when(F.col("_now").isNull(), was)
        .when(was.isNull(), F.when(have, "have").otherwise("new"))
        .when(have & was.isin("new", "failed"), "have")
        .when(was == "pulling", F.when(have, "have").otherwise("new"))
        .otherwise(was)
    )
    return j.select(
        *keys, F.coalesce("url", "old_url").alias("url"), F.coalesce("title", "old_title").alias("title"), status.alias("status"),
        F.coalesce("old_found_at", F.lit(now)).alias("found_at"), F.col("old_pulled_at").alias("pulled_at"), F.col("old_claims_added").alias("claims_added"),
        F.col("old_error").alias("error"),
        # Fresh rows first in run order, then earlier ones in theirs.
        F.struct(F.col("_now").isNull().alias("earlier"), F.coalesce("place", "old_place").alias("place")).alias("order"),
    )


def readable_new(discoveries: DataFrame, first: int) -> DataFrame:
    """Per person, the first appearances still new that have captions or a page to read."""
    ready = discoveries.where((F.col("status") == "new") & F.col("transcript_source").isin("youtube", "page"))
    return ready.withColumn("n", F.row_number().over(W.partitionBy("person_slug").orderBy("place"))).where(F.col("n") <= first)


def due_people(watchlist: DataFrame, every: dt.timedelta, now: dt.datetime, top: int = WATCH_MAX_PEOPLE) -> DataFrame:
    """Followed people whose last check is at least `every` ago (never checked counts), oldest first."""
    last = F.coalesce("last_checked_at", F.lit(dt.datetime(1970, 1, 1)))
    return watchlist.where(last <= F.lit(now - every)).orderBy(last, "slug").limit(top)
