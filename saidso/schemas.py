"""Explicit schemas of the ledger tables. Nothing is inferred from data."""

from pyspark.sql import types as T


def _s(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, t, True) for name, t in fields])


STR, INT, DBL, BOOL, DATE, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampType()

SOURCE = _s(("title", STR), ("url", STR), ("date", DATE), ("kind", STR), ("timestamp_sec", DBL), ("deep_link", STR))
EVIDENCE = _s(("url", STR), ("title", STR), ("date", DATE), ("snippet", STR))
JUDGE_VOTE = _s(("judge", STR), ("verdict", STR), ("confidence", DBL))
GRADING = _s(
    ("verdict", STR), ("confidence", DBL), ("rationale", STR), ("evidence", T.ArrayType(EVIDENCE)), ("resolved_on", DATE),
    ("lateness_applies", BOOL), ("lateness_months", DBL), ("graded_at", TS), ("graded_by", STR),
    ("judges", T.ArrayType(JUDGE_VOTE)), ("disputed", BOOL),
)
DRIFT = _s(("label", STR), ("previous_claim_id", STR), ("note", STR), ("labeled_by", STR))
LINK = _s(("page", STR), ("row", INT), ("timeline_written", BOOL), ("resolved_quality", STR))

CLAIMS = _s(
    ("id", STR), ("person", STR), ("person_slug", STR), ("quote", STR), ("quote_verified", BOOL), ("claim", STR),
    ("type", STR), ("topic", STR), ("said_date", DATE), ("target_date", DATE), ("target_date_inferred", BOOL),
    ("resolution_criteria", STR), ("hedge", STR), ("implied_probability", DBL), ("specificity", INT),
    ("source", SOURCE), ("verdict", STR), ("grading", GRADING), ("drift", DRIFT), ("link", LINK),
    ("origin", STR), ("extracted_at", TS),
)

SEGMENTS = _s(("transcript_id", STR), ("seg_no", INT), ("start", DBL), ("speaker", STR), ("text", STR))

CITATION = _s(("url", STR), ("title", STR))

# Allowed values of the enum columns (fixed values).
CLAIM_TYPES = ("prediction", "stance", "factual")
VERDICTS = ("correct", "incorrect", "partial", "unresolvable", "too_early", "pending")
DRIFT_LABELS = (
    "first", "reaffirmed", "pushed_later", "pulled_earlier", "goalposts_moved", "reversed", "escalated", "softened",
)
SOURCE_KINDS = ("podcast", "interview", "x", "blog", "earnings_call", "keynote", "article", "other")
TRANSCRIPT_SOURCES = ("youtube", "page", "audio", "unknown")

OPEN_VERDICTS = ("pending", "too_early")
GRADED_VERDICTS = ("correct", "incorrect", "partial")
OUTCOME_VERDICTS = ("correct", "incorrect", "partial", "unresolvable")
NOTABLE_DRIFT = ("pushed_later", "pulled_earlier", "goalposts_moved", "reversed")
DRIFT_EVENTS = ("pushed_later", "goalposts_moved", "reversed")
