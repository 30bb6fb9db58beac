"""Date columns: calendar dates, day arithmetic, lateness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.4375


def calendar_date(s: Column) -> Column:
    """The date a 'YYYY-MM-DD' string names, NULL for any other form and for impossible days."""
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def months_between_exact(start: Column, end: Column) -> Column:
    return days_between(start, end) / F.lit(DAYS_PER_MONTH)


def iso(d: Column) -> Column:
    return d.cast("string")


def lateness_applies(verdict: Column, target: Column, resolved: Column) -> Column:
    """Whether lateness means anything: a deadline, an outcome verdict, and a date (or a miss that never happened)."""
    judged = target.isNotNull() & verdict.isin("correct", "partial", "incorrect")
    return F.coalesce(judged & (resolved.isNotNull() | (verdict == "incorrect")), F.lit(False))


def lateness_months(verdict: Column, target: Column, resolved: Column) -> Column:
    """Months past the deadline, one decimal, at least 0.1 when late; NULL when it never happened or does not apply."""
    months = months_between_exact(target, resolved)
    late = F.when(months <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.1), F.floor(months * 10 + 0.5) / 10))
    return F.when(lateness_applies(verdict, target, resolved) & resolved.isNotNull(), late)


def came_true_late(type_: Column, verdict: Column, target: Column, resolved: Column) -> Column:
    """A prediction whose outcome came after its deadline, whether judged correct or a miss."""
    late = (type_ == "prediction") & verdict.isin("correct", "incorrect") & (resolved > target)
    return F.coalesce(late, F.lit(False))
