"""Fine-tuning export: graded claims with evidence as chat lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saidso.functions.dates import iso
from saidso.schemas import OUTCOME_VERDICTS

def exportable() -> Column:
    g = F.col("grading")
    return (
        g["verdict"].isin(*OUTCOME_VERDICTS) & (F.size(g["evidence"]) > 0) & ~F.coalesce(g["disputed"], F.lit(False))
    )


def grader_input() -> Column:
    """Claim, deadline and numbered evidence, as the grader sees them."""
    evidence = F.transform(
        F.col("grading.evidence"),
        lambda e, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(e["title"], e["url"]),
            F.when(e["date"].isNotNull(), F.concat(F.lit(" ("), iso(e["date"]), F.lit(")"))).otherwise(""), F.lit(" "), e["url"],
            F.when(F.coalesce(e["snippet"], F.lit("")) != "", F.concat(F.lit("\n    "), e["snippet"])).otherwise(""),
        ),
    )
    criteria = F.coalesce(F.nullif(F.col("resolution_criteria"), F.lit("")), F.lit("not stated"))
    head = F.array(
        F.concat(F.lit("Speaker: "), F.col("person")),
        F.concat(F.lit("Said: "), iso(F.col("said_date")), F.lit(" in \""), F.col("source.title"), F.lit("\" "), F.col("source.url")),
        F.concat(F.lit("Quote: \""), F.col("quote"), F.lit("\"")),
        F.concat(F.lit("Claim ("), F.col("type"), F.lit("): "), F.col("claim")),
        F.concat(F.lit("Deadline: "), F.coalesce(iso(F.col("target_date")), F.lit("none stated"))),
        F.concat(F.lit("Resolution criteria: "), criteria),
        F.lit(""),
        F.lit("Evidence:"),
    )
    return F.array_join(F.concat(head, evidence), "\n")


def training_lines(claims: DataFrame, brief: str) -> DataFrame:
    """(person_slug, said_date, id, value): one JSON chat per exportable claim, after the system message `brief`."""
    answer = F.to_json(
        F.struct(
            F.col("grading.verdict").alias("verdict"), F.col("grading.confidence").alias("confidence"), F.col("grading.rationale").alias("rationale"),
            iso(F.col("grading.resolved_on")).alias("resolvedOn"),
        ),
        {"ignoreNullFields": "false"},
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    chat = F.struct(
        F.array(message("system", F.lit(brief)), message("user", grader_input()), message("assistant", answer)).alias("messages")
    )
    return claims.where(exportable()).select("person_slug", "said_date", "id", F.to_json(chat).alias("value"))


def write_training_lines(claims: DataFrame, path: str, brief: str) -> None:
    """JSON lines in ledger order: range-partitioned by (person, day, id), so file order is ledger order."""
    lines = training_lines(claims, brief).orderBy("person_slug", "said_date", "id")
    lines.select("value").write.mode("overwrite").text(path)
