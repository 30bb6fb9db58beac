"""Faults found on larger and odd tables, at the smallest scale that shows them."""

import random
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from oracle_check import TABLES, canonical, connect
from saidso.functions.tokens import match_words
from saidso.functions.unicode import nfkc, nfkd
from saidso.operators import drift as D
from saidso.operators import extraction as X
from saidso.operators import retrieval as R
from saidso.operators import scores as S
from saidso.operators import sync as Y
from saidso.operators import votes as V
from saidso.plans import rule_queries as RQ
from saidso.plans.oracle_sql import ORACLE
from saidso.plans.queries import QUERIES
from saidso.session import materialize, run_folder, scratch
from saidso.streaming import jobs as ST

SF = "/root/testdata/sf0.001"


def _same_as_duckdb(df, sf, sql):
    cur = connect(sf).execute(sql)
    names = [d[0] for d in cur.description]
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


@pytest.mark.parametrize("name", ["ledger_scan", "part_scan"])
def test_ledger_files_grow_in_number_not_in_size(spark, monkeypatch, name):
    monkeypatch.setattr(RQ, "CLAIMS_A_FILE", 40)
    written = []
    monkeypatch.setattr(RQ, "scratch", lambda s, old=RQ.scratch: written.append(old(s)) or written[-1])
    _same_as_duckdb(RQ.QUERIES[name](spark, SF), SF, RQ.ORACLE[name])
    sizes = [r["count"] for r in spark.read.text(written[0]).groupBy("file").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 100


def test_question_about_someone_off_record_retrieves_nothing(spark, tmp_path):
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "customer":
            df = df.unionByName(df.orderBy("c_custkey").limit(4).withColumn("c_custkey", df.c_custkey + 90000))
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    cur = con.execute(ORACLE["question_retrieval"])
    names = [d[0] for d in cur.description]
    df = QUERIES["question_retrieval"](spark, str(tmp_path))
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


def test_parity_rounds_the_value_not_its_shortest_decimal(spark):
    ours = spark.createDataFrame([("a", 0.5025, 0.5025, 7)], "person_slug string, accuracy double, brier double, predictions long")
    theirs = spark.createDataFrame([("a", 0.25, 0.4354545454545455, 7)], "person_slug string, accuracy double, brier double, total_bets long")
    row = S.scorecard_parity(ours, theirs).first()
    assert row.ours == "accuracy 0.502 · Brier 0.502 · 7 bets" and row.theirs == "accuracy 0.250 · Brier 0.435 · 7 bets"


def test_votes_without_timeout_are_settled_without_python(spark):
    s, root = ST.stateful_session(spark), scratch(spark)
    schema = "claim_id int, judge string, verdict string, confidence double"
    waves = [
        [(1, "A", "correct", 0.9), (2, "A", "correct", 0.9), (2, "B", "correct", 80.0), (3, "A", "correct", 1.0), (3, "B", "partial", 1.0), (4, "A", "partial", 0.2)],
        [(1, "A", "incorrect", 0.1), (2, "C", "incorrect", 0.7), (3, "C", "incorrect", 1.0), (4, "A", "partial", 0.2), (4, "B", "partial", 0.405), (4, "C", "partial", None)],
        [(1, "B", "correct", 0.5), (2, "D", "incorrect", 0.7), (3, "D", "correct", 1.0)],
    ]
    votes = s.readStream.schema(schema).parquet(f"{root}/in/*")
    live = ST.live_votes(votes, None)
    assert "Python" not in live._jdf.queryExecution().logical().toString() and "Pandas" not in live._jdf.queryExecution().logical().toString()
    for i, rows in enumerate(waves):
        s.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/{i}")
        out = ST.run_available(live, f"{root}/run")
    got = sorted((r.claim_id, r.batch_id, r.verdict, r.confidence, r.disputed, r.need_judge) for r in out.collect())
    assert got == [
        ("1", 2, "correct", 0.7, False, None), ("2", 0, "correct", 0.85, False, None), ("3", 0, None, None, None, "C"),
        ("3", 1, "unresolvable", 0.5, True, None), ("4", 1, "partial", 0.2, False, None),
    ]


def test_plain_tables_show_the_planner_their_size(spark):
    names = spark.range(200_000).selectExpr("concat('person ', id % 50) AS name", "array('person', cast(id % 50 AS string)) AS words").coalesce(1)
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows = names.selectExpr("sum(length(name) + 10 + length(words[1])) AS n").first().n
    assert size(materialize(names, plain=True)) >= rows > 4 * size(materialize(names))


def test_similar_variants_equal_brute_force_and_shuffle_no_words(spark):
    rnd = random.Random(1)
    sets = set()
    for block in ("a", "b"):
        for n in (1, 2, 4, 5, 6, 9, 10, 20, 63, 64, 65, 100, 300) * 3:
            pool = [f"w{i}" for i in range(rnd.choice((n + 2, 2 * n + 3, 1000)))]
            base = rnd.sample(pool, n)
            for _ in range(6):
                changed = set(base) - set(rnd.sample(base, rnd.randint(0, n // 8))) | set(rnd.sample(pool, rnd.randint(0, 1 + n // 12)))
                sets.add((block, tuple(sorted(changed))))
    rows = [(block, f"{block}{i}", list(words)) for i, (block, words) in enumerate(sorted(sets))]
    want = set()
    for i, (block, x, words) in enumerate(rows):
        for other, y, more in rows[i + 1 :]:
            if block == other and 5 * len(set(words) & set(more)) >= 4 * len(set(words) | set(more)):
                want.add((min(x, y), max(x, y)))
    df = spark.createDataFrame(rows + rows[:30], "block_key string, variant string, words array<string>")
    assert want and sorted((r.a, r.b) for r in X.similar_variants(df).collect()) == sorted(want)
    # Unlike texts of common words met on single words before; now few are even compared.
    common = [("a", str(i), sorted(rnd.sample([f"w{j}" for j in range(600)], 150))) for i in range(300)]
    met = X._candidates(X._sets(spark.createDataFrame(common, "block_key string, variant string, words array<string>"), "block_key", "variant", "words"))
    assert met.count() < 300


def test_unicode_folding_needs_no_python_worker(spark):
    texts = ["plain", "", None, "Zoë Ångström", "ﬁve ①② ½", "e\u0301 \u1e9b\u0323", "한국어 ｶﾞ", "\x00é\x00", "𝔘𝔫𝔦 🎈"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", "t", nfkd(F.col("t")).alias("d"), nfkc(F.col("t")).alias("c"))
    for r in out.collect():
        assert (r.d, r.c) == tuple(None if r.t is None else unicodedata.normalize(f, r.t) for f in ("NFKD", "NFKC"))
    cut = df.select(match_words(F.col("t")).alias("w")).where(F.size("w") > 0)
    assert "EvalPython" not in cut._jdf.queryExecution().executedPlan().toString()


def test_summaries_of_shared_quotes_are_built_once(spark):
    row = ("x", "p-1", "2020-01-01", "We  ship soon.", "talk")
    rows = [row, ("y", *row[1:]), ("z", *row[1:3], "Another.", "talk")]
    claims = spark.createDataFrame(rows, "id string, person_slug string, said_date string, quote string, title string")
    source = F.struct("title", F.lit("https://a.com").alias("url"), F.lit(None).cast("string").alias("deep_link"))
    shared = Y.shared_quotes(claims.withColumn("source", source))
    assert sorted(tuple(r) for r in shared.collect()) == [("x", 1, 2), ("y", 2, 2)]
    assert "regexp_replace" not in shared._jdf.queryExecution().executedPlan().toString()


def test_grading_combines_votes_once(spark):
    page = F.struct(F.lit("https://a.com/1").alias("url"), F.lit("page").alias("title"))
    found = F.struct(F.lit("HTTPS://www.a.com/1#top").alias("url"), F.lit("t").alias("title"), F.lit("2020-01-02").alias("date"), F.lit("s").alias("snippet"))
    rows = spark.createDataFrame([("x", "A", "correct"), ("x", "B", "correct")], "claim_id string, judge string, verdict string")
    results = rows.withColumns({"model": F.lit("m"), "confidence": F.lit(0.8), "rationale": F.lit("So."), "resolved_on": F.lit("2020-01-02")})
    results = results.withColumns({"evidence": F.array(found), "citations": F.array(page), "searched": F.array(page)})
    claims = spark.sql("SELECT 'x' AS id, DATE '2020-01-01' AS target_date, named_struct('url', 'https://own.com/') AS source")
    graded = V.grade(claims, results)
    assert [e.url for e in graded.first().grading.evidence] == ["HTTPS://www.a.com/1#top"]
    plan = graded._jdf.queryExecution().optimizedPlan().toString()
    # Only the panel still reads the votes themselves; their confidences were summed once for each reader before.
    assert "sum(n" not in plan


def test_each_url_is_parsed_once(spark, monkeypatch):
    parsed = []
    monkeypatch.setattr(V, "materialize", lambda df, plain=False, old=V.materialize: parsed.append(old(df, plain)) or parsed[-1])
    urls = ["https://www.a.com/x/?utm_source=y&id=1#top", "http://a.com/x?id=1", "no url", "", None]
    rows = spark.range(4000).select("id", F.element_at(F.array(*map(F.lit, urls)), (F.col("id") % 5 + 1).cast("int")).alias("url"))
    got = V.with_refs(rows)
    assert parsed[0].count() == 5 and got.columns == ["id", "url", "ref"]
    want = rows.select("id", "url", V.page_ref(F.col("url")).alias("ref"))
    assert got.count() == 4000 and got.exceptAll(want).count() == 0


def test_a_chain_is_one_state_value_over_batches(spark):
    s, root = ST.stateful_session(spark), scratch(spark)
    schema = "id string, person_slug string, topic string, said_date date, target_date date, verdict string"
    day = lambda n: ST.EPOCH + ST.dt.timedelta(days=n)
    waves = [[("b", 20, 300, "pending"), ("c", 30, None, "pending")], [("a", 10, 200, "pending"), ("d", 40, 310, "correct")], [("e", 50, 100, "pending")]]
    live = ST.live_drift(s.readStream.schema(schema).parquet(f"{root}/in/*"))
    assert "TransformWithState" not in live._jdf.queryExecution().logical().toString()
    for i, rows in enumerate(waves):
        rows = [(k, "p", "t", day(x), None if y is None else day(y), v) for k, x, y, v in rows]
        s.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/{i}")
        out = ST.run_available(live, f"{root}/run")
    last = {}
    for r in sorted(out.collect(), key=lambda r: r.batch_id):
        last[(r.said_date - ST.EPOCH).days] = (r.label, r.previous_claim_id, r.shift_days)
    assert last == {10: ("first", None, None), 20: ("pushed_later", "a", 100), 30: ("reaffirmed", "b", None), 40: ("reaffirmed", "b", 10), 50: ("reaffirmed", "d", None)}


def test_chains_share_the_states_of_a_few_buckets(spark):
    s, root = ST.stateful_session(spark), scratch(spark)
    schema = "id string, person_slug string, topic string, said_date date, target_date date, verdict string"
    day = lambda n: ST.EPOCH + ST.dt.timedelta(days=n)
    rng = random.Random(8)
    rows = [(f"c{i}", f"p{rng.randrange(20)}", f"t{rng.randrange(5)}", day(rng.randrange(9)), rng.choice([None, day(rng.randrange(400))]), rng.choice(["correct", "pending"])) for i in range(900)]
    live = ST.live_drift(s.readStream.schema(schema).parquet(f"{root}/in/*"), buckets=3)
    for i in range(3):
        s.createDataFrame(rows[i::3], schema).write.parquet(f"{root}/in/{i}")
        out = ST.run_available(live, f"{root}/run")
    state = s.read.format("statestore").load(f"{root}/run/state")
    assert state.count() == 3
    last = {}
    for r in sorted(out.collect(), key=lambda r: r.batch_id):
        last[r.person_slug, r.topic, r.said_date, r.target_date] = (r.label, r.previous_claim_id)
    want = D.label_keys(spark.createDataFrame(rows, schema)).collect()
    assert len(want) > 700 and last == {(r.person_slug, r.topic, r.said_date, r.target_date): (r.detected.label, r.detected.previous_claim_id) for r in want}


def test_answers_store_pairs_without_their_plans(spark, monkeypatch):
    written, wide = [], ("people", "terms", "window")
    monkeypatch.setattr(R, "materialize", lambda df, plain=False, old=R.materialize: written.append(old(df, plain)) or written[-1])
    with run_folder(spark) as folder:
        assert QUERIES["answer_tables"](spark, SF).count() == 365
        stored = sum(p.stat().st_size for p in Path(folder.removeprefix("file:")).rglob("*") if p.is_file())
    assert len(written) > 10 and not [t.columns for t in written if "id" in t.columns and {*wide} & {*t.columns}]
    assert stored < 1_600_000, stored
