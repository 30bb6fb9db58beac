"""Scores, drift, hedges, upsert, votes, sync and quality against worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from saidso.functions import hedge as H
from saidso.functions import urls as U
from saidso.functions.dates import lateness_months
from saidso.operators import drift as D
from saidso.operators import ledger as L
from saidso.operators import quality as Q
from saidso.operators import scores as S
from saidso.operators import sync as Y
from saidso.operators import votes as V
from saidso.plans.queries import _linked
from saidso.plans.driver_tables import ledger
from saidso.schemas import CLAIMS

SF = "/root/testdata/sf0.001"


def claim(id, said="2020-01-01", target=None, verdict="pending", p=0.85, type="prediction", topic="t", person="Ann Lee", slug="ann-lee", resolved=None, **over):
    day = dt.date.fromisoformat
    row = dict(
        id=id, person=person, person_slug=slug, quote="q", quote_verified=True, claim=f"claim {id}", type=type, topic=topic, said_date=day(said),
        target_date=day(target) if target else None, target_date_inferred=False if target else None, resolution_criteria="r", hedge="", implied_probability=p,
        specificity=3, source=("Show", "https://example.com/a", day(said), "podcast", None, None), verdict=verdict,
        grading=(verdict, 0.9, "r", [], day(resolved) if resolved else None, None, None, None, "human:seed", None, None) if verdict not in ("pending", "too_early") else None,
        drift=None, link=None, origin="seed", extracted_at=None,
    )
    row.update(over)
    return tuple(row[f.name] for f in CLAIMS.fields)


def claims(spark, *rows):
    return spark.createDataFrame(list(rows), CLAIMS)


def test_scorecard_parity_case(spark):
    c = claims(
        spark, claim("1", verdict="correct", p=0.9), claim("2", verdict="incorrect", p=0.9), claim("3", verdict="incorrect", p=0.7), claim("4", verdict="incorrect", p=0.85),
        claim("5", verdict="partial", p=0.6), claim("6", type="stance", p=0.1),
    )
    s = S.person_scorecard(c).first()
    assert (s.claims, s.predictions, s.correct, s.incorrect, s.partial) == (6, 5, 1, 3, 1)
    assert s.accuracy == 0.25 and s.credit_accuracy == 0.3
    assert s.brier == pytest.approx((0.01 + 0.81 + 0.49 + 0.7225) / 4)


def test_lateness_multiplier_counts_late_misses(spark):
    c = claims(spark, claim("1", "2019-04-22", "2021-06-05", "incorrect", resolved="2024-03-11"), claim("2", "2020-01-01", "2020-02-01", "correct", resolved="2020-01-15"))
    assert S.lateness_multiplier(c).first().lateness_multiplier == pytest.approx(1785 / 775)


def test_even_median_averages_the_middle(spark):
    late = [claim(str(i), "2020-01-01", "2020-01-11", "correct", resolved=f"2020-0{1 + i}-01") for i in (1, 2)]
    got = S.lateness_multiplier(claims(spark, *late)).first().lateness_multiplier
    assert got == pytest.approx((31 / 10 + 60 / 10) / 2)


def test_calibration_buckets(spark):
    c = claims(spark, *[claim(str(i), verdict="correct", p=p) for i, p in enumerate((0.7, 0.75, 0.95, 0.05))])
    rows = {r.bucket: r.n for r in S.calibration(c).collect()}
    assert rows == {"0.7-0.8": 2, "0.9-1.0": 1, "0.0-0.1": 1}


def labels(spark, *rows):
    got = D.detect_drift(claims(spark, *rows)).select("id", "detected.*").collect()
    return {r.id: (r.label, r.previous_claim_id) for r in got}


def test_drift_edges(spark):
    got = labels(spark, claim("a", "2020-01-01", "2021-01-01"), claim("b", "2020-02-01", "2021-03-02"), claim("c", "2020-03-01", "2021-04-30"), claim("d", "2020-04-01", "2021-03-01"))
    assert got["a"] == ("first", None)
    assert got["b"] == ("pushed_later", "a")  # exactly 60 days
    assert got["c"] == ("reaffirmed", "b")  # 59 days
    assert got["d"] == ("pulled_earlier", "c")  # exactly -60 days


def test_siblings_never_compare_and_met_deadlines_do_not_move(spark):
    got = labels(spark, claim("a", "2020-01-01", "2021-01-01"), claim("b", "2020-01-01", "2025-01-01"), claim("c", "2020-06-01"), claim("d", "2020-07-01", "2021-02-01"))
    assert got["a"][0] == got["b"][0] == "first"
    assert got["c"] == ("reaffirmed", "b")
    assert got["d"] == ("reaffirmed", "a")
    met = labels(spark, claim("a", "2020-01-01", "2021-01-01", "correct"), claim("b", "2022-01-01", "2024-01-01"))
    assert met["b"] == ("reaffirmed", "a")


def test_proposed_labels_yield_to_measured_slips(spark):
    c = claims(spark, claim("a", "2020-01-01", "2021-01-01"), claim("b", "2020-06-01", "2022-01-01"), claim("c", "2020-09-01", "2022-01-10"))
    proposed = spark.createDataFrame(
        [("ann-lee", "t", "b", "softened", "n", "m", 1), ("ann-lee", "t", "b", "reversed", "late", "m", 2), ("ann-lee", "t", "c", "escalated", "He lied.", "m", 1), ("ann-lee", "t", "a", "reversed", "x", "m", 1)],
        "person_slug string, topic string, claim_id string, label string, note string, labeled_by string, ordinal int",
    )
    got = {r.id: (r.drift.label, r.drift.note) for r in D.merge_labels(c, proposed).collect()}
    assert got["a"][0] == "first"
    assert got["b"] == ("pushed_later", "Deadline moved from 2021-01-01 to 2022-01-01.")
    assert got["c"] == ("escalated", "Labeled escalated relative to the previous claim.")


@pytest.mark.parametrize(
    "hedge, claim_text, p",
    [
        ("very likely", "x will", 0.75), ("unlikely", "x will", 0.25), ("unlikely", "x will not", 0.75), ("no chance", "x gets it", 0.1), ("no chance", "x never gets it", 0.9),
        ("a hundred percent", "x", 0.95), ("fifty-fifty", "x", 0.5), ("willing", "x", 0.85), ("", "it could happen", 0.85), ("we expected that", "x", 0.75), ("not likely", "x", 0.7),
        ("no doubt about it", "x", 0.95), ("I’m confident", "x", 0.9),
    ],
)
def test_claim_probability(spark, hedge, claim_text, p):
    df = spark.createDataFrame([(hedge, claim_text)], "h string, c string")
    assert df.select(H.claim_probability(F.col("h"), F.col("c")).alias("p")).first().p == pytest.approx(p)


def test_lateness_states(spark):
    rows = [("incorrect", None), ("correct", None), ("correct", "2019-12-01"), ("correct", "2020-01-02"), ("correct", "2020-04-01")]
    df = spark.createDataFrame([(v, dt.date(2020, 1, 1), dt.date.fromisoformat(r) if r else None) for v, r in rows], "v string, t date, r date")
    got = [x.m for x in df.select(lateness_months(F.col("v"), F.col("t"), F.col("r")).alias("m")).collect()]
    assert got == [None, None, 0.0, 0.1, 3.0]


def test_upsert_keeps_what_the_ledger_knows_and_is_idempotent(spark):
    held = claims(spark, claim("a", verdict="correct", resolved="2020-05-01", link=("people/ann-lee", 3, True, None)), claim("b"))
    again = claims(
        spark, claim("a", origin="extracted", quote_verified=False, hedge="maybe", link=("people/ann-lee", None, None, "correct")),
        claim("new", "2021-01-01", verdict="incorrect", resolved="2021-05-01"), claim("new", "2021-01-01", hedge="likely"),
    ).withColumn("ordinal", F.monotonically_increasing_id())
    merged = L.upsert(held, again)
    got = {r.id: r for r in merged.collect()}
    a, n = got["a"], got["new"]
    assert (a.verdict, a.origin, a.quote_verified, a.hedge, a.change) == ("correct", "seed", True, "maybe", "updated")
    assert tuple(a.link) == ("people/ann-lee", 3, True, "correct")
    assert (n.verdict, n.hedge, n.change) == ("incorrect", "likely", "added") and got["b"].change == "kept"
    twice = L.upsert(merged.drop("change"), again)
    assert {r.change for r in twice.collect()} <= {"unchanged", "kept"}


def test_patch_ignores_nulls_and_unknown_ids(spark):
    c = claims(spark, claim("a", hedge="maybe"), claim("b"))
    u = spark.createDataFrame([("a", None, "x"), ("zzz", "will", "y")], "id string, hedge string, topic string")
    got = {r.id: (r.hedge, r.topic) for r in L.patch(c, u, ["hedge", "topic"]).collect()}
    assert got == {"a": ("maybe", "x"), "b": ("", "t")}


def test_grading_assembly(spark):
    c = claims(spark, claim("a", target="2020-06-01"), claim("b", target="2020-06-01"), claim("c"))
    ev = lambda url, date=None: (url, "t", date, "s")
    page = lambda url: (url, None)
    rows = [
        ("a", "A", "m1", "correct", 80.0, "It broke promises, he lied.", "2020-07-01", [ev("https://x.com/1?utm_source=z", "2020-05-01"), ev("https://made.up/2")], [page("http://www.x.com/1/")], []),
        ("a", "B", "m2", "correct", 0.9, "Fine.", "not a date", [ev("https://y.com/2", "2020-08-01")], [], [page("https://y.com/2")]),
        ("b", "A", "m1", "correct", 0.9, "r", None, [ev("https://made.up/1")], [], []), ("b", "B", "m1", "correct", 0.9, "r", None, [], [], []),
        ("c", "A", "m1", "correct", 0.9, "r", None, [], [], []), ("c", "B", "m1", "incorrect", 0.9, "r", None, [], [], []), ("c", "C", "m1", "partial", 0.9, "r", None, [], [], []),
    ]
    e = "array<struct<url:string,title:string,date:string,snippet:string>>"
    p = "array<struct<url:string,title:string>>"
    r = spark.createDataFrame(rows, f"claim_id string, judge string, model string, verdict string, confidence double, rationale string, resolved_on string, evidence {e}, citations {p}, searched {p}")
    got = {x.claim_id: x for x in V.grade(c, r).collect()}
    g = got["a"].grading
    assert (g.verdict, g.confidence, g.rationale, g.resolved_on, g.graded_by) == ("correct", 0.85, "Fine.", dt.date(2020, 7, 1), "m1+m2")
    assert [x.url for x in g.evidence] == ["https://y.com/2", "https://x.com/1?utm_source=z"]  # after the deadline first
    assert g.lateness_applies and g.lateness_months == 1.0
    assert got["b"].grading is None and "none of their evidence" in got["b"].ungraded_reason
    assert got["c"].grading.disputed and got["c"].verdict == "unresolvable" and "tie-break: partial" in got["c"].grading.rationale


def test_sync_plan_is_empty_after_it_ran(spark):
    c, takes = _linked(ledger(spark, SF))
    c = c.cache()
    plan = Y.sync_plan(c, takes).cache()
    added = plan.where("action = 'add_take'").select("id", (F.abs(F.hash("id")) % 10**6 + 10**7).cast("int").alias("row")).cache()
    after = Y.apply_plan(c, plan, added)
    texts = plan.where("action = 'add_take'").select("id", "page", "text").join(added, "id")
    resolved = plan.where("action = 'resolve'").select("id", F.col("quality").alias("q"))
    new = texts.join(resolved, "id", "left").select(
        F.col("row").alias("row_num"), F.col("text").alias("claim"), F.lit("bet").alias("kind"), F.col("page").alias("holder"), F.lit(0.5).alias("weight"),
        F.lit("").alias("source"), F.lit(True).alias("active"), F.col("q").alias("resolved_quality"),
    )
    left = Y.sync_plan(after, takes.unionByName(new)).groupBy("action").count().collect()
    # Conflicts are reported every time; a claim linked to someone else's row is never resolved.
    assert {r.action for r in left} <= {"conflict", "foreign_take", "resolve"}
    done = {r.action for r in plan.select("action").distinct().collect()}
    assert {"add_timeline", "add_take", "link_take", "resolve"} <= done
    assert not {"add_timeline", "add_take", "link_take"} & {r.action for r in left}


def test_claim_problems(spark):
    bad = claim("nope", "2020-01-02", "2019-01-01", p=0.83, slug="x", quote="The goal is near, he said", type="prediction")
    found = {r.message for r in Q.claim_problems(claims(spark, bad), dt.date(2020, 1, 1)).collect()}
    for text in ("is not 12 hex", "is before said_date", "is not a 0.05 step", 'person_slug should be "ann-lee"', "reporter's attribution", "is after today"):
        assert any(text in m for m in found), text


@pytest.mark.parametrize(
    "url, key, public, video",
    [
        ("https://WWW.Example.com/a/b/?utm_source=x&q=1#top", "example.com/a/b?q=1", True, None), ("http://example.com", "example.com", True, None),
        ("https://youtu.be/abcdefghijk?t=3", "youtube:abcdefghijk", True, "abcdefghijk"), ("https://m.youtube.com/watch?v=abcdefghijk&x=1", "youtube:abcdefghijk", True, "abcdefghijk"),
        ("ftp://example.com/a", None, False, None), ("http://127.0.0.1/x", "127.0.0.1/x", False, None), ("http://0x7f.1/", "0x7f.1", False, None), ("http://user@example.com/", "example.com", False, None),
        ("http://[::1]/", "[::1]", False, None), ("http://[::ffff:8.8.8.8]/", "[::ffff:8.8.8.8]", True, None), ("http://printer.local/", "printer.local", False, None), ("http://8.8.8.8/a", "8.8.8.8/a", True, None),
    ],
)
def test_urls(spark, url, key, public, video):
    r = spark.createDataFrame([(url,)], "u string").select(U.source_key(F.col("u")).alias("k"), U.public_url(F.col("u")).alias("p"), U.youtube_id(F.col("u")).alias("v")).first()
    assert (r.k, r.p, r.v) == (key, public, video)


def test_scrubbing_and_links(spark):
    t = "see https://a.com/x?sig=1&b=2 and sk-ABCdefghijklmnopqrstuvwx but sk-hynix-results-are-all-lower"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(U.scrub_text(F.col("t")).alias("s")).first().s == "see https://a.com/x?b=2 and sk-REDACTED but sk-hynix-results-are-all-lower"
    links = [("https://youtu.be/abcdefghijk?t=1s&x=2", 63.9), ("https://www.youtube.com/watch?v=abcdefghijk", 5.0), ("https://example.com/", 5.0)]
    got = [r.l for r in spark.createDataFrame(links, "u string, s double").select(U.deep_link(F.col("u"), F.col("s")).alias("l")).collect()]
    assert got == ["https://youtu.be/abcdefghijk?t=63s&x=2", "https://www.youtube.com/watch?v=abcdefghijk&t=5s", None]
