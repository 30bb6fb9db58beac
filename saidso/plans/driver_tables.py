"""The ledger and its companions as projections of the driver tables.

The SQL text of a projection is shared with the oracle: it runs unchanged in
Spark and in DuckDB, so both sides start from identical rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = dt.date(2001, 1, 1)

_MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"

LEDGER_COLUMNS = {
    "id": f"substr(sha1(concat('person-', CAST(o_custkey AS STRING), '|', CAST({_MONTH} AS STRING), '|', CAST(o_orderkey AS STRING))), 1, 12)",
    "person": "concat('person ', CAST(o_custkey AS STRING))",
    "person_slug": "concat('person-', CAST(o_custkey AS STRING))",
    "quote": "concat('order ', CAST(o_orderkey AS STRING), ' has priority ', lower(o_orderpriority))",
    "claim": "CAST(o_orderkey AS STRING)",
    "type": "CASE WHEN o_orderkey % 10 = 0 THEN 'stance' WHEN o_orderkey % 10 = 1 THEN 'factual' ELSE 'prediction' END",
    "topic": "concat('topic-', CAST(o_orderkey % 3 AS STRING))",
    "said_date": _MONTH,
    "target_date": f"CASE WHEN o_orderkey % 10 IN (0, 1) OR o_orderkey % 7 = 0 THEN NULL ELSE {_MONTH} + CAST(30 + (o_orderkey * 37) % 700 AS INT) END",
    "verdict": (
        "CASE WHEN o_orderkey % 10 IN (0, 1) THEN 'pending' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'correct' "
        "WHEN o_orderstatus = 'F' THEN 'incorrect' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'correct' "
        "WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 1 THEN 'incorrect' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 2 THEN 'partial' "
        "WHEN o_orderstatus = 'P' THEN 'unresolvable' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'too_early' END"
    ),
    "implied_probability": (
        "CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0.95 WHEN '2' THEN 0.85 WHEN '3' THEN 0.7 WHEN '4' THEN 0.5 ELSE 0.25 END AS DOUBLE)"
    ),
    "specificity": "CAST(1 + o_orderkey % 5 AS INT)",
    "resolved_on": (
        f"CASE WHEN o_orderstatus = 'O' OR o_orderkey % 5 = 0 OR o_orderkey % 10 IN (0, 1) THEN NULL "
        f"ELSE {_MONTH} + CAST(10 + (o_orderkey * 53) % 900 AS INT) END"
    ),
    "source_title": "concat('episode ', CAST(o_orderkey % 97 AS STRING))",
    "source_url": "concat('https://example.com/episode/', CAST(o_orderkey % 97 AS STRING))",
    "origin": "CASE WHEN o_orderkey % 3 = 1 THEN 'extracted' ELSE 'seed' END",
    "extracted_on": f"CASE WHEN o_orderkey % 3 = 1 THEN {_MONTH} + CAST(5 + o_orderkey % 60 AS INT) END",
    "disputed": "o_orderstatus = 'P' AND o_orderkey % 4 = 3 AND o_orderkey % 8 = 7",
    "hedge": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'for sure' WHEN '2' THEN '' WHEN '3' THEN 'probably' WHEN '4' THEN 'maybe' ELSE 'unlikely' END",
}

HEDGED_COLUMNS = {
    "doc_id": "doc_id",
    "hedge": (
        "CASE doc_id % 16 WHEN 0 THEN 'for sure' WHEN 1 THEN 'A hundred percent' WHEN 2 THEN 'very likely' WHEN 3 THEN 'unlikely' "
        "WHEN 4 THEN 'I think we will' WHEN 5 THEN 'fifty-fifty' WHEN 6 THEN 'willing' WHEN 7 THEN '' WHEN 8 THEN 'no chance' "
        "WHEN 9 THEN 'it may' WHEN 10 THEN 'we expected that' WHEN 11 THEN 'hopefully' WHEN 12 THEN 'not likely' "
        "WHEN 13 THEN 'extremely likely' WHEN 14 THEN 'no doubt' ELSE 'doubt' END"
    ),
    "claim": (
        "concat(CASE doc_id % 4 WHEN 0 THEN 'Acme will ship ' WHEN 1 THEN 'Acme will not ship ' "
        "WHEN 2 THEN 'Acme never ships ' ELSE 'Acme is not going to ship ' END, text)"
    ),
}

_VERDICTS = "WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'partial' WHEN 3 THEN 'unresolvable' ELSE 'too_early' END"


def _vote(j: int, judge: str) -> tuple[str, str, str]:
    k = "o_orderkey"
    pick = f"CASE WHEN {k} % 9 = 0 THEN ({k} + {j}) % 5 WHEN {k} % 4 = {j} THEN ({k} + 1) % 5 ELSE {k} % 5 END"
    percent = f"(({k} * 13 + {j} * 29) % 101)"
    conf = f"CAST(CASE WHEN {k} % 3 = 0 THEN CAST({percent} AS DOUBLE) ELSE CAST({percent} AS DOUBLE) / 100 END AS DOUBLE)"
    return judge, f"CASE {pick} {_VERDICTS}", conf


# (judge, verdict, confidence) of each order's votes.
VOTES = (_vote(0, "A"), _vote(1, "B"), _vote(2, "C"))

_SITE = "concat('site', CAST(l_suppkey % 5 AS STRING), '.example.com/a/', CAST(l_partkey % 7 AS STRING)"
_JUDGE = "CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END"

EVIDENCE_COLUMNS = {
    "claim_id": "l_orderkey",
    "judge": _JUDGE,
    "pos": "l_linenumber * 10000000 + l_partkey",
    "part": "l_partkey",
    "url": f"concat('https://www.', {_SITE}), '/?utm_source=x&id=', CAST(l_linenumber % 3 AS STRING), '#top')",
    "title": "concat('part ', CAST(l_partkey AS STRING))",
    "date": "CAST(l_shipdate AS DATE)",
    "snippet": "l_returnflag",
}

PAGE_COLUMNS = {
    "claim_id": "l_orderkey",
    "judge": _JUDGE,
    "pos": "l_linenumber * 10000000 + l_partkey",
    "url": f"concat('http://', {_SITE}), '?id=', CAST(l_linenumber % 3 AS STRING), '&UTM_medium=y')",
}


def select_sql(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ",\n  ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f"\nFROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as a claim ledger with nested source and grading; unused columns are pruned from the scan."""
    return as_claims(project(table(spark, sf_dir, "orders"), LEDGER_COLUMNS))


def as_claims(flat: DataFrame, *extra: str) -> DataFrame:
    """The flat projection with nested source and grading, in the claims schema; `extra` columns are kept as they are."""
    graded = ~F.col("verdict").isin("pending", "too_early")
    none = F.lit(None)
    return flat.select(
        "id", "person", "person_slug", "quote", F.lit(True).alias("quote_verified"), "claim", "type", "topic", "said_date", "target_date",
        F.when(F.col("target_date").isNotNull(), F.lit(False)).alias("target_date_inferred"),
        F.concat(F.lit("order "), "claim", F.lit(" ships")).alias("resolution_criteria"),
        "hedge", "implied_probability", "specificity",
        F.struct(
            F.col("source_title").alias("title"), F.col("source_url").alias("url"), F.col("said_date").alias("date"),
            F.lit("podcast").alias("kind"), none.cast("double").alias("timestamp_sec"), none.cast("string").alias("deep_link"),
        ).alias("source"),
        "verdict",
        F.when(
            graded,
            F.struct(
                F.col("verdict").alias("verdict"), F.lit(0.9).alias("confidence"),
                F.concat(F.lit("Recorded as "), "verdict", F.lit(".")).alias("rationale"),
                F.array(
                    F.struct(
                        F.concat(F.lit("https://news.example.org/"), "claim").alias("url"), F.concat(F.lit("report "), "claim").alias("title"),
                        F.col("resolved_on").alias("date"), F.concat(F.lit("what happened to order "), "claim").alias("snippet"),
                    )
                ).alias("evidence"),
                F.col("resolved_on").alias("resolved_on"), none.cast("boolean").alias("lateness_applies"),
                none.cast("double").alias("lateness_months"), none.cast("timestamp").alias("graded_at"),
                F.lit("human:seed").alias("graded_by"),
                none.cast("array<struct<judge:string,verdict:string,confidence:double>>").alias("judges"),
                F.col("disputed").alias("disputed"),
            ),
        ).alias("grading"),
        none.cast("struct<label:string,previous_claim_id:string,note:string,labeled_by:string>").alias("drift"),
        none.cast("struct<page:string,row:int,timeline_written:boolean,resolved_quality:string>").alias("link"),
        "origin", F.col("extracted_on").cast("timestamp").alias("extracted_at"), *extra,
    )
