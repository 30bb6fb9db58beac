"""Queries whose inputs are built from the driver tables so that every rule of an operator comes up, by the key of a row.

Each query reads a whole table; the row's key decides which case the row is, so the expected result is known from the key
alone and `ORACLE` states it without repeating the rule.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saidso.functions import dates as DT
from saidso.functions import tokens as T
from saidso.functions import urls as U
from saidso.operators import appearances as A
from saidso.operators import drift as D
from saidso.operators import extraction as X
from saidso.operators import retrieval as R
from saidso.operators import sync as Y
from saidso.operators import votes as V
from saidso.plans.driver_tables import LEDGER_COLUMNS, as_claims, ledger, project, table
from saidso.plans.oracle_sql import LEDGER
from saidso.session import scratch
from saidso.sources import captions as CP
from saidso.sources import ledger_files as LF
from saidso.streaming import jobs as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return register


def _text(*parts: str | Column) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _case(key: Column, n: int, *values: Column | str) -> Column:
    """The value for key % n."""
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(key % n == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


SPOKEN = "concat('turn ', turn, ' ', trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')))"


@query(f"""
SELECT concat(conv_id, CASE conv_id % 4 WHEN 0 THEN '.vtt' WHEN 1 THEN '.srt' WHEN 2 THEN '.txt' ELSE '.json' END) AS transcript_id,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS seg_no, CAST(turn * 30 AS DOUBLE) AS start,
  CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END AS speaker, trim({SPOKEN}) AS text
FROM conversations""")
def transcript_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as caption, subtitle, plain and JSON transcripts and read back by routing."""
    said = F.trim(_text("turn ", F.col("turn"), " ", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))))
    clock = lambda sec, mark: F.concat(F.date_format(F.timestamp_seconds(sec), "HH:mm:ss"), F.lit(f"{mark}000"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.initcap("role").alias("speaker"), said.alias("said"), (F.col("turn") * 30).alias("at"))
    line = _case(
        F.col("conv_id"), 4,
        _text(clock(F.col("at"), "."), " --> ", clock(F.col("at") + 9, "."), "\n<v ", F.col("speaker"), ">", F.col("said"), "</v>\n"),
        _text(F.col("turn") + 1, "\n", clock(F.col("at"), ","), " --> ", clock(F.col("at") + 9, ","), "\n<v ", F.col("speaker"), ">", F.col("said"), "\n"),
        _text("[", F.date_format(F.timestamp_seconds("at"), "HH:mm:ss"), "] ", F.col("speaker"), ": ", F.col("said")),
        F.to_json(F.struct(F.col("at").cast("string").alias("start"), F.col("said").alias("text"), "speaker")),
    )
    files = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    key = F.col("conv_id")
    content = _case(key, 4, _text("WEBVTT\n\n", F.array_join("lines", "\n")), F.array_join("lines", "\n"), F.array_join("lines", "\n"), _text('{"segments":[', F.array_join("lines", ","), "]}"))
    segments, _ = CP.route_segments(files.select(_text(key, _case(key, 4, ".vtt", ".srt", ".txt", ".json")).alias("file"), content.alias("content")))
    return segments.select("transcript_id", F.col("seg_no").cast("int").alias("seg_no"), "start", "speaker", "text")


@query("""
SELECT concat(conv_id, '.json') AS file FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 < 2""")
def unread_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Files of no known shape, named instead of lost."""
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    content = _case(F.col("conv_id"), 3, '{"foo": 1}', "no json at all", '{"segments":[{"start":"1","text":"words"}]}')
    return CP.route_segments(c.select(_text(F.col("conv_id"), ".json").alias("file"), content.alias("content")))[1]


@query("""
SELECT o_orderkey AS id, array_to_string(list_sort(CASE o_orderkey % 4
    WHEN 0 THEN [CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)]
    WHEN 1 THEN [CAST(o_orderkey * 1000 AS VARCHAR)]
    WHEN 2 THEN [CAST(o_custkey % 90 + 10 AS VARCHAR), 'q3']
    ELSE ['12', concat(o_orderkey % 1000, '.5')] END), ',') AS numbers
FROM orders""")
def number_signatures(spark: SparkSession, sf: str) -> DataFrame:
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    said = _case(key, 4, _text("we shipped ", key, " units to ", other, " people"), _text("some ", key, " thousand robots"), _text("up ", other % 90 + 10, " percent in Q3"), _text("a dozen for ", key % 1000, ".5 dollars"))
    return table(spark, sf, "orders").select(key.alias("id"), F.array_join(T.number_signature(T.match_words(said)), ",").alias("numbers"))


@query("""
SELECT o_orderkey AS id,
  CASE o_orderkey % 5 WHEN 1 THEN concat('number mismatch: quote has [', o_orderkey, '], transcript has [', o_orderkey + 1, ']')
                      WHEN 2 THEN 'negation mismatch: quote has 0 negation(s), transcript has 1' END AS meaning,
  o_orderkey % 5 = 3 AS other_time, o_orderkey % 5 = 4 AS other_name
FROM orders""")
def meaning_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A sentence beside one that changes its number, its meaning, its time or its name."""
    key = F.col("o_orderkey")
    quote = _text("We will tell Miller to ship ", key, " robots next year")
    span = _case(key, 5, quote, _text("We will tell Miller to ship ", key + 1, " robots next year"), _text("We will not tell Miller to ship ", key, " robots next year"), _text("We will tell Miller to ship ", key, " robots next month"), _text("We will tell Bernard to ship ", key, " robots next year"))
    both = table(spark, sf, "orders").select(key.alias("id"), quote.alias("quote"), span.alias("span"))
    both = both.select("id", T.match_words(F.col("quote")).alias("q"), T.match_words(F.col("span")).alias("s"), T.entity_words(F.col("quote")).alias("qn"), T.entity_words(F.col("span")).alias("sn"))
    q, s = F.col("q"), F.col("s")
    name = T.name_change(F.col("qn"), q, F.col("sn"), s)
    return both.select("id", T.meaning_change(q, s).alias("meaning"), T.time_change(q, s).isNotNull().alias("other_time"), name.isNotNull().alias("other_name"))


@query("""
SELECT conv_id, turn, (conv_id + turn) % 7 IN (1, 2, 6) AS barred FROM conversations""")
def speaker_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that can and cannot be the wanted speaker."""
    label = _case(F.col("conv_id") + F.col("turn"), 7, "Dana", "Sam", "Host", "Speaker 1", "Guest", "Dana Founder", "Bob")
    wanted, host = F.lit("Dana Founder"), F.lit("Sam Host")
    problem = T.label_problem(label, T.match_words(label), wanted, T.match_words(wanted), host, T.match_words(host))
    return table(spark, sf, "conversations").select("conv_id", "turn", problem.isNotNull().alias("barred"))


@query(f"""WITH {LEDGER}
SELECT id, CASE WHEN target_date IS NOT NULL AND verdict IN ('correct', 'partial', 'incorrect') AND resolved_on IS NOT NULL THEN
    CASE WHEN resolved_on <= target_date THEN 0.0 ELSE greatest(0.1, floor(CAST(resolved_on - target_date AS DOUBLE) / {DT.DAYS_PER_MONTH}::DOUBLE * 10 + 0.5) / 10) END END::DOUBLE AS months
FROM ledger""")
def lateness(spark: SparkSession, sf: str) -> DataFrame:
    c = ledger(spark, sf)
    return c.select("id", DT.lateness_months(F.col("verdict"), F.col("target_date"), F.col("grading.resolved_on")).alias("months"))


@query("""
SELECT page_id, concat(base, CASE WHEN contains(base, '?') THEN '&' ELSE '?' END, 'keep=1') AS stripped,
  concat('see ', base, CASE WHEN contains(base, '?') THEN '&' ELSE '?' END, 'keep=1 and sk-REDACTED') AS scrubbed
FROM (SELECT page_id, split_part(url, '#', 1) AS base FROM pages)""")
def stripped_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page links with signing parameters added, alone and inside a text that also holds a key."""
    base = F.substring_index("url", "#", 1)
    signed = _text(base, F.when(base.contains("?"), "&").otherwise("?"), "X-Amz-Signature=abc&keep=1&X-Amz-Date=2")
    text = _text("see ", signed, " and sk-", F.repeat(F.lit("a1B2"), 8))
    return table(spark, sf, "pages").select("page_id", U.strip_signed_params(signed).alias("stripped"), U.scrub_text(text).alias("scrubbed"))


@query("""
WITH p AS (SELECT page_id, lpad(CAST(page_id AS VARCHAR), 11, 'v') AS v, page_id % 5 AS k FROM pages)
SELECT page_id, CASE WHEN k < 3 THEN concat('youtube:', v) END AS video,
  CASE WHEN k = 3 THEN concat('https://www.youtube.com/watch?v=', v) WHEN k = 0 THEN concat('https://www.youtube.com/watch?v=', v, '&t=5s') WHEN k = 1 THEN concat('https://youtu.be/', v)
       WHEN k = 2 THEN concat('https://www.youtube.com/shorts/', v) ELSE concat('https://cdn.example.com/', v, '.mp3') END AS canonical,
  CASE WHEN k < 3 THEN 'youtube' WHEN k = 4 THEN 'audio' ELSE 'page' END AS source,
  CASE k WHEN 0 THEN concat('https://www.youtube.com/watch?v=', v, '&t=', page_id, 's') WHEN 1 THEN concat('https://youtu.be/', v, '?t=', page_id, 's') END AS link, k = 2 AS short
FROM p""")
def video_links(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("page_id")
    v = F.lpad(key.cast("string"), 11, "v")
    url = _case(key, 5, _text("https://www.youtube.com/watch?v=", v, "&t=5s"), _text("https://youtu.be/", v), _text("https://www.youtube.com/shorts/", v), _text("https://mirror.example.org/watch?v=", v), _text("https://cdn.example.com/", v, ".mp3"))
    p = table(spark, sf, "pages").select("page_id", url.alias("url"))
    u = F.col("url")
    return p.select(
        "page_id", F.when(U.youtube_id(u).isNotNull(), U.source_key(u)).alias("video"), U.mirror_to_canonical(u).alias("canonical"), U.transcript_source(u, F.lit("youtube")).alias("source"),
        U.deep_link(u, F.col("page_id")).alias("link"), U.is_short(u).alias("short"),
    )


@query("""
SELECT DISTINCT concat('person-', o_custkey) AS person_slug FROM orders WHERE o_orderkey % 4 IN (1, 2)""")
def label_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two drift tables: some claims new, some with another label, some alike, some without one now."""
    key = F.col("o_orderkey")
    drift = lambda label: F.struct(label.alias("label"), F.lit("x").alias("previous_claim_id"), F.lit("n").alias("note"))
    o = table(spark, sf, "orders").select(key.alias("id"), _text("person-", F.col("o_custkey")).alias("person_slug"))
    old = o.where("id % 4 <> 1").withColumn("drift", drift(F.lit("first")))
    new = o.withColumn("drift", F.when(F.col("id") % 4 != 3, drift(_case(F.col("id"), 4, "first", "first", "reversed"))))
    return D.label_changes(old, new)


@query("""
SELECT concat('person-', o_custkey) AS person_slug, CAST(o_orderkey AS VARCHAR) AS key,
  CASE o_orderkey % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'have' WHEN 2 THEN 'have' WHEN 3 THEN 'new' WHEN 4 THEN 'pulled' ELSE 'dismissed' END AS status,
  CASE WHEN o_orderkey % 6 >= 2 THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2021-01-01' END AS found_at, o_orderkey % 6 = 5 AS earlier
FROM orders""")
def discovery_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Appearances found again, found first, held by now, being pulled, pulled, and no longer returned."""
    key = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(_text("person-", F.col("o_custkey")).alias("person_slug"), key.cast("string").alias("key"), key.alias("k"), key.alias("place"), _text("https://a.example.com/", key).alias("url"), F.lit("t").alias("title"))
    status = _case(F.col("k"), 6, F.lit(None), F.lit(None), "failed", "pulling", "pulled", "dismissed")
    none = F.lit(None)
    previous = o.where("k % 6 >= 2").select("person_slug", "key", "place", "url", "title", status.alias("status"), F.lit(dt.datetime(2020, 1, 1)).alias("found_at"), none.cast("timestamp").alias("pulled_at"), none.cast("int").alias("claims_added"), none.cast("string").alias("error"))
    run = o.where("k % 6 < 5").withColumn("in_ledger", (F.col("k") % 6).isin(1, 2)).select("person_slug", "key", "place", "url", "title", "in_ledger")
    merged = A.record_discovery(previous, run, dt.datetime(2021, 1, 1))
    return merged.select("person_slug", "key", "status", F.col("found_at").cast("timestamp_ntz").alias("found_at"), F.col("order.earlier").alias("earlier"))


@query("""
SELECT concat('person-', o_custkey) AS person_slug, o_orderkey AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 < 2 QUALIFY n <= 3""")
def readable_new(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    found = table(spark, sf, "orders").select(_text("person-", F.col("o_custkey")).alias("person_slug"), key.alias("place"), _case(key, 3, "new", "pulled", "failed").alias("status"), _case(key, 4, "youtube", "page", "audio", "unknown").alias("transcript_source"))
    return A.readable_new(found, 3).select("person_slug", "place", F.col("n").cast("long").alias("n"))


@query("""
SELECT conv_id, turn, conv_id % 2 = 0 AS answered FROM conversations""")
def response_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Model calls, of which half have a recorded answer under the key of the call."""
    key = LF.response_key(F.lit("ask_answer"), F.lit(None).cast("string"), F.col("role"), _text(F.col("conv_id"), "/", F.col("turn"), " ", F.coalesce("text", F.lit(""))), F.lit(False))
    calls = table(spark, sf, "conversations").withColumn("key", key)
    hit, miss = LF.lookup_responses(calls.select("conv_id", "turn", "key"), calls.where("conv_id % 2 = 0").select("key", F.lit("a").alias("answer")).distinct())
    return hit.select("conv_id", "turn", F.lit(True).alias("answered")).unionByName(miss.select("conv_id", "turn", F.lit(False).alias("answered")))


@query("""
SELECT concat('person-', o_custkey) AS person_slug, count(*) AS claims, CASE WHEN o_custkey = 7 THEN 0 ELSE count(*) END AS linked
FROM orders GROUP BY o_custkey""")
def forgotten_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link state of one person dropped, everyone else's kept."""
    link = F.struct(F.lit("p").alias("page"), F.lit(1).alias("row"), F.lit(True).alias("timeline_written"), F.lit(None).cast("string").alias("resolved_quality"))
    left = Y.forget_links(ledger(spark, sf).withColumn("link", link), "person-7")
    return left.groupBy("person_slug").agg(F.count("*").alias("claims"), F.count("link").alias("linked"))


@query("""
SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'read' WHEN 3 THEN NULL ELSE 'set aside' END AS outcome
FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 <> 3""")
def model_output(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded answers: of the wanted schema, without data, no JSON, and of another schema."""
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    call = lambda schema, data: _text('{"request":{"schemaName":"', schema, '"},"response":{"data":', data, "}}")
    content = _case(F.col("conv_id"), 4, call("ask_answer", '{"answer":"yes","cited_claim_ids":["a"]}'), call("ask_answer", "null"), "no json", call("grade_claim", "{}"))
    good, bad = LF.read_model_output(c.select(_text("ask_answer-", F.lpad(F.hex("conv_id"), 16, "0"), ".json").alias("file"), content.alias("content")), "ask_answer")
    number = F.conv(F.regexp_extract("file", "([0-9A-F]{16})", 1), 16, 10).cast("long").alias("conv_id")
    return good.select(number, F.lit("read").alias("outcome")).unionByName(bad.select(number, F.lit("set aside").alias("outcome")))


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'correct' WHEN 2 THEN 'incorrect' WHEN 3 THEN 'unresolvable' WHEN 4 THEN 'too_early' WHEN 5 THEN 'partial' END AS verdict,
  CASE WHEN o_orderkey % 6 IN (0, 2, 5) THEN 1 WHEN o_orderkey % 6 IN (3, 4) THEN 0 END AS sources, o_orderkey % 6 = 3 AS disputed, o_orderkey % 6 = 1 AS ungraded,
  CASE WHEN o_orderkey % 6 IN (0, 2, 5) THEN CAST(o_orderdate AS DATE) + 61 END AS resolved_on, CASE WHEN o_orderkey % 6 IN (0, 2, 5) THEN 2.0::DOUBLE END AS months,
  CASE o_orderkey % 6 WHEN 1 THEN NULL WHEN 3 THEN 3 WHEN 2 THEN 3 ELSE 2 END AS judges
FROM orders""")
def grading_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Two or three judges per order: agreed, agreed without a checked source, settled by the third, split three ways, open, partial."""
    key = F.col("o_orderkey")
    verdicts = _case(key, 6, F.array(*map(F.lit, ("correct", "correct"))), F.array(*map(F.lit, ("incorrect", "incorrect"))), F.array(*map(F.lit, ("correct", "incorrect", "incorrect"))), F.array(*map(F.lit, ("correct", "incorrect", "partial"))), F.array(*map(F.lit, ("too_early", "too_early"))), F.array(*map(F.lit, ("partial", "partial"))))
    orders = table(spark, sf, "orders")
    day, url = F.col("o_orderdate").cast("date"), _text("https://news.example.org/a?id=", key)
    claims = orders.select(key.cast("string").alias("id"), day.alias("target_date"), F.struct(F.lit("https://own.example.org/").alias("url")).alias("source"))
    votes = orders.select(key, day.alias("day"), F.posexplode(verdicts).alias("i", "verdict"))
    page = F.struct(url.alias("url"), F.lit("page").alias("title"))
    found = F.when(key % 6 != 1, F.array(page)).otherwise(F.array().cast("array<struct<url:string,title:string>>"))
    results = votes.select(
        key.cast("string").alias("claim_id"), F.element_at(F.array(*map(F.lit, "ABC")), F.col("i") + 1).alias("judge"), F.lit("m").alias("model"), "verdict", F.lit(0.8).alias("confidence"), F.lit("It came out so.").alias("rationale"),
        F.when(~F.col("verdict").isin("too_early"), F.date_add("day", 61).cast("string")).alias("resolved_on"),
        F.array(F.struct(_text(url, "#top").alias("url"), F.lit("title").alias("title"), F.date_add("day", 61).cast("string").alias("date"), F.lit("snippet").alias("snippet"))).alias("evidence"),
        found.alias("citations"), found.alias("searched"),
    )
    g = V.grade(claims, results)
    return g.select(
        F.col("claim_id").cast("long").alias("id"), "verdict", F.size("grading.evidence").alias("sources"), F.coalesce("grading.disputed", F.lit(False)).alias("disputed"), F.col("ungraded_reason").isNotNull().alias("ungraded"),
        F.col("grading.resolved_on").alias("resolved_on"), F.col("grading.lateness_months").alias("months"), F.size("grading.judges").alias("judges"),
    )


@query("""
SELECT CAST(d AS DATE) AS first_day, CAST(d AS DATE) + 30 AS end_day, event_type, count(*) AS n
FROM events, LATERAL (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 29 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d) GROUP BY ALL""")
def live_counts_30d(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the last 30 days by type, for every day, as a stream counts them."""
    live = ST.stateful_session(spark)
    events = ST.files_stream(live, sf, table(spark, sf, "events").schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ST.run_available(ST.new_per_month(events, "ts", "event_type"), scratch(spark))
    return out.groupBy("first_day", "end_day", "event_type").agg(F.max_by("n", "batch_id").alias("n"))


@query("""
WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'unresolvable' END AS verdict FROM orders)
SELECT CAST(k AS VARCHAR) AS claim_id, verdict, k % 4 = 2 AS disputed FROM p WHERE verdict IS NOT NULL""")
def live_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes arriving as a stream: agreed by two, by the third, split three ways, and one vote alone, which decides nothing."""
    key = F.col("o_orderkey")
    panels = {0: ("correct", "correct"), 1: ("correct", "incorrect", "incorrect"), 2: ("correct", "incorrect", "partial"), 3: ("correct",)}
    verdicts = _case(key, 4, *(F.array(*map(F.lit, v)) for v in panels.values()))
    folder = scratch(spark)
    rows = table(spark, sf, "orders").select(key.alias("claim_id"), F.posexplode(verdicts).alias("i", "verdict"))
    rows.select("claim_id", F.element_at(F.array(*map(F.lit, "ABC")), F.col("i") + 1).alias("judge"), "verdict", F.lit(0.9).alias("confidence")).write.parquet(f"{folder}/votes")
    live = ST.stateful_session(spark)
    votes = live.readStream.schema("claim_id long, judge string, verdict string, confidence double").parquet(f"{folder}/votes")
    decided = ST.run_available(ST.live_votes(votes, None), f"{folder}/run").where("verdict IS NOT NULL")
    return decided.select("claim_id", "verdict", "disputed")


def _interviews(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The claims that extraction makes of one interview per customer, and what it drops: by key, a sound candidate, another
    number, the interviewer's words, too few words, a claim with a number of its own, and no quote."""
    key = F.col("c_custkey")
    people = table(spark, sf, "customer")
    said = _text("We will ship ", key + 100, " delivery robots to Miller next year")
    line = lambda i, who, text: F.struct(F.lit(i).alias("seg_no"), F.lit(10.0 * i).alias("start"), F.lit(who).alias("speaker"), text.alias("text"))
    host = line(0, "Sam Host", F.lit("Tell us what you will ship next year and to whom."))
    lines = F.array(host, line(1, "Dana Founder", F.concat(said, F.lit(", of course."))), line(2, "Dana Founder", F.lit("That is very likely, if you ask me.")))
    segments = people.select(key.cast("string").alias("transcript_id"), F.inline(lines))
    quote = _case(key, 6, said, _text("We will ship ", key + 101, " delivery robots to Miller next year"), "Tell us what you will ship next year", "to Miller next year", said, "")
    claim = F.when(key % 6 == 4, "Acme ships 999999 delivery robots").otherwise(_text("Acme ships ", key + 100, " delivery robots next year"))
    candidates = people.select(
        key.cast("string").alias("candidate_id"), key.cast("string").alias("transcript_id"), F.lit(0).alias("ordinal"), F.lit("Dana Founder").alias("speaker"), F.lit("Sam Host").alias("host"), quote.alias("quote"), claim.alias("claim"),
        F.lit("prediction").alias("type"), F.lit("Delivery Robots").alias("topic"), F.lit("2021-12-31").alias("target_date"), F.lit(False).alias("target_date_inferred"), F.lit("it ships").alias("resolution_criteria"), F.lit("very likely").alias("hedge"), F.lit(9).alias("specificity"),
    )
    none = F.lit(None)
    source = F.struct(F.lit("talk").alias("title"), F.lit("https://www.youtube.com/watch?v=abcdefghijk").alias("url"), F.lit(dt.date(2020, 5, 1)).alias("date"), F.lit("video").alias("kind"), none.cast("double").alias("timestamp_sec"), none.cast("string").alias("deep_link"))
    return X.extract_claims(candidates, segments, people.select(key.cast("string").alias("transcript_id"), source.alias("source")))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS transcript_id, 'dana-founder' AS person_slug, concat('We will ship ', c_custkey + 100, ' delivery robots to Miller next year') AS quote, 'delivery-robots' AS topic,
  DATE '2020-05-01' AS said_date, DATE '2021-12-31' AS target_date, 'very likely' AS hedge, 0.75::DOUBLE AS implied_probability, 5 AS specificity, 'https://www.youtube.com/watch?v=abcdefghijk&t=10s' AS link
FROM customer WHERE c_custkey % 6 = 0""")
def extract_claims(spark: SparkSession, sf: str) -> DataFrame:
    claims, _ = _interviews(spark, sf)
    return claims.select("transcript_id", "person_slug", "quote", "topic", "said_date", "target_date", "hedge", "implied_probability", "specificity", F.col("source.deep_link").alias("link"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS candidate_id, CASE c_custkey % 6
    WHEN 1 THEN concat('number mismatch: quote has [', c_custkey + 101, '], transcript has [', c_custkey + 100, ']')
    WHEN 2 THEN 'label' WHEN 3 THEN 'quote is too short to carry a claim (4 words; at least 5 needed)'
    WHEN 4 THEN 'claim has numbers the quote does not: 999999' ELSE 'missing quote or claim text' END AS reason
FROM customer WHERE c_custkey % 6 <> 0""")
def extract_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Every dropped candidate with its reason; the wording of a wrong speaker is not compared."""
    _, dropped = _interviews(spark, sf)
    return dropped.select("candidate_id", F.when(F.col("candidate_id").cast("long") % 6 == 2, "label").otherwise(F.col("reason")).alias("reason"))


#: Claims a ledger file of the queries holds at most, about; 16 files at least.
CLAIMS_A_FILE = 50_000


def _ledger_files(spark: SparkSession, sf: str, head: str, tail: str) -> str:
    """The ledger as compressed JSON files, one for each group of claims; more claims make more files. No list is gathered: a file
    is written claim by claim, `head` before the first and `tail` after the last."""
    orders = table(spark, sf, "orders")
    n = max(16, math.ceil(orders.count() / CLAIMS_A_FILE))
    # Orders are dealt to files and put in order; only then they are written out as claims, so that no claim is shuffled.
    of_file = Window.partitionBy("file").orderBy("o_orderkey")
    dealt = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", F.pmod(F.xxhash64("o_orderkey"), F.lit(n)).alias("file"))
    dealt = dealt.withColumn("first", F.row_number().over(of_file) == 1).withColumn("last", F.lead(F.lit(1)).over(of_file).isNull())
    c = as_claims(project(dealt, LEDGER_COLUMNS | {x: x for x in ("file", "first", "last")}), "file", "first", "last")
    g = F.col("grading")
    graded = F.when(g.isNotNull(), F.struct(g["verdict"].alias("verdict"), g["confidence"].alias("confidence"), g["rationale"].alias("rationale"), g["resolved_on"].cast("string").alias("resolvedOn"), g["graded_by"].alias("gradedBy")))
    claim = F.struct(
        "id", "person", F.col("person_slug").alias("personSlug"), F.concat("quote", F.lit(' "}, {" \\ [')).alias("quote"), F.col("quote_verified").alias("quoteVerified"), "claim", "type", "topic", F.col("said_date").cast("string").alias("saidDate"),
        F.col("target_date").cast("string").alias("targetDate"), "hedge", F.col("implied_probability").alias("impliedProbability"), "specificity", F.struct("source.title", "source.url", "source.kind").alias("source"), "verdict", graded.alias("grading"), "origin",
    )
    before, after = F.when(F.col("first"), head).otherwise(""), F.when(F.col("last"), tail).otherwise(",")
    root = scratch(spark)
    c.select("file", F.concat(before, F.to_json(claim), after).alias("value")).write.partitionBy("file").option("compression", "gzip").text(root)
    return f"{root}/*"


LEDGER_FIELDS_SQL = f"""
WITH {LEDGER} SELECT id, person_slug, concat(quote, ' "}}, {{" \\ [') AS quote, claim, CAST(said_date AS DATE) AS said_date, CAST(target_date AS DATE) AS target_date, verdict, verdict NOT IN ('pending', 'too_early') AS graded, source_url AS url FROM ledger"""


@query(LEDGER_FIELDS_SQL)
def ledger_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger files read back, quotes full of brackets and quotation marks included."""
    path = _ledger_files(spark, sf, '{"version": 1, "claims": [\n', "\n]}")
    return LF.read_claims(spark, path).select("id", "person_slug", "quote", "claim", "said_date", "target_date", "verdict", F.col("grading").isNotNull().alias("graded"), F.col("source.url").alias("url"))


@query(LEDGER_FIELDS_SQL.replace(" FROM ledger", ", id AS given_id FROM ledger"))
def part_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Part files (bare lists) read as one ledger, ids computed anew."""
    parts = LF.read_parts(spark, _ledger_files(spark, sf, "[", "]"))
    return parts.select("id", "person_slug", "quote", "claim", "said_date", "target_date", "verdict", F.col("grading").isNotNull().alias("graded"), F.col("source.url").alias("url"), "given_id")


@query(f"""
WITH {LEDGER} SELECT id, CAST(2 AS BIGINT) AS copies FROM ledger WHERE CAST(replace(person_slug, 'person-', '') AS BIGINT) % 5 = 0""")
def part_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that two parts hold."""
    parts = LF.read_parts(spark, _ledger_files(spark, sf, "[", "]"))
    again = parts.where(F.replace("person_slug", F.lit("person-"), F.lit("")).cast("long") % 5 == 0).withColumn("part", F.lit("again.json"))
    return LF.part_problems(parts.unionByName(again)).select("id", "copies")


@query(f"""
WITH said AS (SELECT conv_id, turn, trim({SPOKEN}) AS said FROM conversations)
SELECT concat(conv_id, CASE conv_id % 2 WHEN 0 THEN '.vtt' ELSE '.json' END) AS transcript_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS seg_no,
  CAST(turn * 30 AS DOUBLE) AS start, said AS text
FROM said""")
def rolling_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions that scroll: every line comes with the one before it, first its beginning, then all of it, then again."""
    said = F.trim(_text("turn ", F.col("turn"), " ", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))))
    c = table(spark, sf, "conversations").select("conv_id", "turn", said.alias("said"), (F.col("turn") * 30).alias("at"))
    lines = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "at", "said"))).alias("t"))
    before = lambda i: F.coalesce(F.get("t", i - 1)["said"], F.lit("[Music]"))
    head = lambda x: _text("turn ", x["turn"])
    clock = lambda sec: F.date_format(F.timestamp_seconds(sec), "HH:mm:ss")
    cue = lambda x, i: F.concat(clock(x["at"]), F.lit(".000 --> "), clock(x["at"] + 9), F.lit(".000\n"), before(i), F.lit("\n"), head(x), F.lit("\n\n"), clock(x["at"] + 10), F.lit(".000 --> "), clock(x["at"] + 19), F.lit(".000\n"), head(x), F.lit("\n<c>"), x["said"], F.lit("</c>\n"))
    event = lambda at, text: F.to_json(F.struct((at * 1000).alias("tStartMs"), F.array(F.struct(text.alias("utf8"))).alias("segs")))
    events = F.flatten(F.transform("t", lambda x, i: F.array(event(x["at"], head(x)), event(x["at"] + 3, x["said"]), event(x["at"] + 6, before(i)), event(x["at"] + 7, x["said"]))))
    vtt = _text("WEBVTT\n\n", F.array_join(F.transform("t", cue), "\n"))
    content = F.when(F.col("conv_id") % 2 == 0, vtt).otherwise(_text('{"events":[', F.array_join(events, ","), "]}"))
    files = lines.select(_text(F.col("conv_id"), F.when(F.col("conv_id") % 2 == 0, ".vtt").otherwise(".json")).alias("file"), content.alias("content"))
    return CP.route_segments(files)[0].select("transcript_id", F.col("seg_no").cast("int").alias("seg_no"), "start", "text")


TRACK_LANGUAGE = "CASE l_suppkey % 7 WHEN 0 THEN 'en' WHEN 1 THEN 'en-US' WHEN 2 THEN 'de' WHEN 3 THEN 'en-orig' WHEN 4 THEN 'EN-gb' WHEN 5 THEN 'en-AU' ELSE 'fr' END"


@query(f"""
WITH t AS (SELECT l_orderkey AS video_id, l_linenumber * 10000000 + l_partkey AS ordinal, {TRACK_LANGUAGE} AS language, CASE WHEN l_linestatus = 'O' THEN 'asr' END AS kind FROM lineitem)
SELECT video_id, ordinal, language, kind FROM t WHERE lower(language) LIKE 'en%'
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN kind = 'asr' THEN 1 ELSE 0 END,
  CASE WHEN language = 'en' THEN 0 WHEN lower(language) IN ('en-us', 'en-gb') THEN 1 WHEN language = 'en-orig' THEN 3 WHEN language LIKE 'en%' THEN 2 ELSE 4 END, ordinal) = 1""")
def caption_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The line items of an order as caption tracks of a video: the one to use."""
    tracks = table(spark, sf, "lineitem").selectExpr("l_orderkey AS video_id", "l_linenumber * 10000000 + l_partkey AS ordinal", f"{TRACK_LANGUAGE} AS language", "CASE WHEN l_linestatus = 'O' THEN 'asr' END AS kind")
    return LF.best_track(tracks).select("video_id", "ordinal", "language", "kind")


@query(f"""
WITH t AS (SELECT DISTINCT l_orderkey AS video_id, {TRACK_LANGUAGE} AS language FROM lineitem)
SELECT video_id, concat(video_id, '.', language, '.vtt') AS name FROM t
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY
  CASE WHEN language = 'en' THEN 0 WHEN lower(language) IN ('en-us', 'en-gb') THEN 1 WHEN language = 'en-orig' THEN 3 WHEN language LIKE 'en%' THEN 2 ELSE 4 END, concat(video_id, '.', language, '.vtt')) = 1""")
def subtitle_files(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS video_id", f"concat(l_orderkey, '.', {TRACK_LANGUAGE}, '.vtt') AS name").distinct()
    return LF.best_subtitle_file(files).select(F.col("video_id").cast("long").alias("video_id"), "name")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS file, concat('episode ', o_orderkey) AS title, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('https://example.com/', o_orderkey) END AS url,
  CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('channel ', o_custkey) END AS channel, CAST(o_custkey AS DOUBLE) AS duration_sec
FROM orders""")
def episode_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Downloader metadata of one episode an order: dates as upload day, release day, seconds, or not at all."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    title, url, channel = _text(" episode ", key), _text("https://example.com/", key), _text("channel ", F.col("o_custkey"))
    packed = F.date_format(day, "yyyyMMdd")
    meta = F.struct(
        key.cast("string").alias("id"), title.alias("title"), F.when(key % 4 == 1, url).alias("webpage_url"), F.when(key % 4 > 1, url).otherwise(F.lit(" ")).alias("original_url"), F.when(key % 4 == 0, packed).alias("upload_date"), F.when(key % 4 == 1, packed).otherwise("x").alias("release_date"),
        F.when(key % 4 == 2, F.unix_date(day) * 86400 + 3600).alias("timestamp"), F.when(key % 3 == 1, channel).alias("channel"), F.when(key % 3 == 2, channel).alias("uploader"), F.col("o_custkey").cast("double").alias("duration"),
    )
    files = table(spark, sf, "orders").select(key.cast("string").alias("file"), F.to_json(meta).alias("content"))
    return LF.episode_metadata(files).select("file", "title", "url", "date", "channel", "duration_sec")


@query("""
SELECT conv_id AS transcript_id, count(*) AS segments FROM conversations GROUP BY conv_id""")
def transcript_store(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts stored in two goes that overlap: each is there once, whole."""
    c = table(spark, sf, "conversations")
    segments = c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("seg_no"), F.lit(None).cast("double").alias("start"), F.col("role").alias("speaker"), "text")
    sources = segments.select("transcript_id", _text("https://example.com/talks/", F.col("transcript_id")).alias("source")).distinct()
    root = scratch(spark)
    LF.write_transcripts(segments, sources.where("transcript_id % 3 = 0"), root)
    LF.write_transcripts(segments, sources, root)
    return spark.read.parquet(root).groupBy("transcript_id").agg(F.count("*").alias("segments"))


@query("""
SELECT o_orderkey AS question_id, concat('answer ', o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN ' new' ELSE '' END) AS answer, CAST(o_custkey AS VARCHAR) AS cited
FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderkey % 4 <> 3""")
def same_question(spark: SparkSession, sf: str) -> DataFrame:
    """Questions asked before in other letters and marks: the newest recording whose claims all still exist; by key, one recording, one of
    another day, two, and one that cites a claim that is gone."""
    key, orders = F.col("o_orderkey"), table(spark, sf, "orders")
    misses = orders.select(key.alias("question_id"), _text("What did person ", F.col("o_custkey"), " say about order ", key, "?").alias("question"), F.lit("2001-01-01").alias("today"))
    asked = _text("  what DID person ", F.col("o_custkey"), " say - about order ", key)
    cited = F.when(key % 4 == 3, F.array(F.col("o_custkey").cast("string"), F.lit("gone"))).otherwise(F.array(F.col("o_custkey").cast("string"), F.col("o_custkey").cast("string")))
    day = F.when(key % 4 == 1, "2000-12-31").when(key % 4 == 0, F.lit(" 2001-01-01 "))
    old = orders.select(asked.alias("question"), day.alias("today"), _text(" answer ", key, " ").alias("answer"), cited.alias("cited"), F.lit(dt.datetime(2000, 1, 1)).alias("recorded_at"))
    new = orders.where(key % 4 == 2).select(asked.alias("question"), day.alias("today"), _text("answer ", key, " new").alias("answer"), cited.alias("cited"), F.lit(dt.datetime(2000, 1, 2)).alias("recorded_at"))
    claims = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return LF.same_question(misses, old.unionByName(new), claims).select("question_id", "answer", F.array_join("cited", ",").alias("cited"))


@query("""
SELECT o_orderkey AS question_id, CASE o_orderkey % 6
    WHEN 1 THEN 'it cited no statement from the ledger'
    WHEN 2 THEN concat('it quoted words that are in no statement ("order ', o_orderkey + 1, ' has priority")')
    WHEN 3 THEN 'it dated a quote 1901-01-01, which is not when it was said' END AS problem,
  CASE WHEN o_orderkey % 6 <> 1 THEN CAST(o_orderkey AS VARCHAR) END AS cited
FROM orders""")
def answer_audit(spark: SparkSession, sf: str) -> DataFrame:
    """An answer about each order, quoting it: sound, without a source, with other words, with another day, about a deadline, and in two parts."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    quote = _text("order ", key, " has priority ", F.lower("o_orderpriority"))
    said = _text("On ", day, ' they said "order ', key, ' has priority" and "yes".')
    answer = _case(
        key, 6, said, said, _text("On ", day, ' they said "order ', key + 1, ' has priority".'), _text('On 1901-01-01 they said "order ', key, ' has priority".'),
        _text("It falls due ", F.date_add(day, 9), ': "order ', key, ' has priority".'), _text("On ", day, ' they said "order ', key, "... ", F.lower("o_orderpriority"), '".'),
    )
    orders = table(spark, sf, "orders")
    own = key.cast("string")
    cited = F.when(key % 6 == 1, F.array(F.lit("none"))).otherwise(F.array(own, F.lit("none"), own))
    answers = orders.select(key.alias("question_id"), answer.alias("answer"), cited.alias("cited_claim_ids"), F.when(key % 6 == 4, "due").otherwise("general").alias("kind"))
    context = orders.select(key.alias("question_id"), own.alias("id"), quote.alias("quote"), day.alias("said_date"), F.date_add(day, 9).alias("target_date"))
    return R.answer_problems(answers, context).select("question_id", "problem", F.array_join("cited", ",").alias("cited"))
