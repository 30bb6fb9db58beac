"""Named queries against DuckDB at the smallest scale, the entry point, questions, and live jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from saidso.functions import questions as Qn
from saidso.functions.unicode import fold
from saidso.session import scratch
from saidso.streaming import jobs as ST
from oracle_check import canonical, connect

SF = "/root/testdata/sf0.001"
QUICK = (
    "person_scorecard", "topic_scorecard", "calibration", "deadline_drift", "chain_summary", "drift_label_merge", "people_ranking_wrong", "claim_quality", "ledger_upsert", "vote_combine",
    "evidence_merge", "hedge_probability", "url_keys", "segment_times", "trimmed_minutes", "people_links", "recent_additions", "whats_new_feed", "people_cards", "appearance_validation", "sync_plan",
    "daily_new_statements",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "text, kind, window",
    [
        ("Has the deadline moved?", "drift", None), ("What's coming due next month?", "due", ("2026-07-02", "2026-08-01")), ("Who has been most wrong since 2019?", "ranking", ("2019-01-01", "2026-07-01")),
        ("What did she say about it last year?", "said_about", ("2025-01-01", "2025-12-31")), ("How reliable is he?", "track_record", None), ("Anything new lately?", "recent", ("2026-04-02", "2026-07-01")),
        ("deadlines in the next three months", "due", ("2026-07-02", "2026-10-01")), ("tell me", "general", None),
    ],
)
def test_question_kind_and_window(spark, text, kind, window):
    f = fold(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(Qn.question_kind(f, F.lit(0)).alias("k"), Qn.time_window(f, F.lit(dt.date(2026, 7, 1))).alias("w")).first()
    assert r.k == kind
    assert (None if r.w is None else (str(r.w.start), str(r.w.stop))) == window


def test_live_votes_ask_for_a_tie_break(spark):
    s, root = ST.stateful_session(spark), scratch(spark)
    schema = "claim_id int, judge string, verdict string, confidence double"
    s.createDataFrame([(1, "A", "correct", 0.9), (1, "B", "incorrect", 0.8), (2, "A", "correct", 0.9), (2, "B", "correct", 90.0)], schema).write.parquet(f"{root}/in/1")
    votes = s.readStream.schema(schema).parquet(f"{root}/in/*")
    first = {r.claim_id: r for r in ST.run_available(ST.live_votes(votes, None), f"{root}/run").collect()}
    assert first["1"].need_judge == "C" and first["2"].verdict == "correct" and first["2"].confidence == 0.9
    s.createDataFrame([(1, "C", "incorrect", 0.7)], schema).write.parquet(f"{root}/in/2")
    both = ST.run_available(ST.live_votes(votes, None), f"{root}/run").where("claim_id = '1' AND verdict IS NOT NULL").collect()
    assert [(r.verdict, r.confidence) for r in both] == [("incorrect", 0.75)]


def test_live_deadlines_fire_in_event_time(spark):
    s, root = ST.stateful_session(spark), scratch(spark)
    schema = "id string, type string, verdict string, target_date date, seen_at timestamp"
    day = dt.date(2020, 3, 1)
    waves = [
        [("a", "prediction", "pending", day, dt.datetime(2020, 1, 1)), ("b", "prediction", "correct", day, dt.datetime(2020, 1, 1))],
        [("c", "prediction", "pending", dt.date(2021, 3, 1), dt.datetime(2020, 2, 10))],
        [("d", "prediction", "pending", dt.date(2021, 3, 1), dt.datetime(2020, 3, 10))],
    ]
    stream = s.readStream.schema(schema).parquet(f"{root}/in/*")
    for i, rows in enumerate(waves):
        s.createDataFrame(rows, schema).write.parquet(f"{root}/in/{i}")
        fired = ST.run_available(ST.live_deadlines(stream), f"{root}/run")
    assert [(r.id, r.kind) for r in fired.orderBy("batch_id").collect()] == [("a", "coming_due"), ("a", "came_due")]
