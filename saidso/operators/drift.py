"""How a story moves: deadline drift inside each (person, topic) chain, and label merging.

A chain can hold a third of the ledger, so nothing here windows over claims.
Claims first collapse to distinct (chain, day said, deadline) rows with partial
aggregation, days collapse to occasions, and only the occasions of a chain
(bounded by the calendar) are ever ordered in one task. A label depends on the
claim only through (chain, day said, deadline), so the labels join back on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saidso.functions.dates import days_between, iso
from saidso.functions.wording import neutral_or
from saidso.schemas import NOTABLE_DRIFT

SLIP_DAYS = 60
CHAIN = ("person_slug", "topic")

TRANSITION_LABELS = (
    "reaffirmed", "pushed_later", "pulled_earlier", "goalposts_moved", "reversed", "escalated", "softened",
)
JUDGMENT_LABELS = ("goalposts_moved", "reversed", "escalated", "softened")
CLAIM_CHANGE_LABELS = ("goalposts_moved", "reversed")
SLIP_LABELS = ("pushed_later", "pulled_earlier")


def deadline_groups(claims: DataFrame) -> DataFrame:
    """Distinct (chain, day said, deadline) with the ids that can speak for it."""
    still_open = ~F.col("verdict").eqNullSafe("correct")
    return claims.groupBy(*CHAIN, "said_date", "target_date").agg(
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.min(F.when(still_open, F.col("id"))).alias("open_id"),
        F.count("*").alias("n"),
    )


def _closest(deadlines: Column, id_field: str, to: Column) -> Column:
    """The deadline nearest to `to`; ties go to the smallest id."""
    return F.array_min(
        F.transform(
            deadlines,
            lambda d: F.struct(
                F.abs(days_between(d["target_date"], to)).alias("gap"), d[id_field].alias("id"), d["target_date"].alias("target_date")
            ),
        )
    )


def label_keys(claims: DataFrame) -> DataFrame:
    """One drift label per distinct (chain, day said, deadline)."""
    day = W.partitionBy(*CHAIN).orderBy("said_date").rowsBetween(W.unboundedPreceding, -1)
    entry = F.struct("target_date", "first_id", "open_id")
    dated = F.col("target_date").isNotNull()
    occasions = (
        deadline_groups(claims)
        .repartition(*CHAIN)
        .groupBy(*CHAIN, "said_date")
        .agg(
            F.max("last_id").alias("last_id"),
            F.collect_list(F.when(dated, entry)).alias("deadlines"),
            F.collect_list("target_date").alias("dated_targets"),
            F.bool_or(~dated).alias("has_undated"),
        )
    )
    # Two selects: in one, the explode would run below the window and repeat occasions.
    seen = occasions.select(
        *CHAIN,
        "said_date",
        F.last("last_id").over(day).alias("previous_id"),
        F.last(F.when(F.size("deadlines") > 0, F.col("deadlines")), ignorenulls=True).over(day).alias("earlier"),
        F.concat("dated_targets", F.when(F.col("has_undated"), F.array(F.lit(None).cast("date"))).otherwise(F.array().cast("array<date>"))).alias("targets"),
    ).withColumn("target_date", F.explode("targets"))
    to = F.col("target_date")
    open_ones = F.filter("earlier", lambda d: d["open_id"].isNotNull())
    first = F.col("previous_id").isNull()
    no_compare = to.isNull() | F.col("earlier").isNull()
    met = F.size(open_ones) == 0
    pick = F.when(met, _closest(F.col("earlier"), "first_id", to)).otherwise(_closest(open_ones, "open_id", to))
    out = seen.withColumn("pick", F.when(~first & ~no_compare, pick)).withColumn("met", met)
    shift = days_between(F.col("pick.target_date"), to)
    was = F.col("pick.target_date")
    measured = ~first & ~no_compare & ~F.col("met")
    label = (
        F.when(first, "first")
        .when(measured & (shift >= SLIP_DAYS), "pushed_later")
        .when(measured & (shift <= -SLIP_DAYS), "pulled_earlier")
        .otherwise("reaffirmed")
    )
    note = (
        F.when(first & to.isNull(), F.lit("First recorded claim on this topic."))
        .when(first, F.concat(F.lit("First recorded claim on this topic, with a deadline of "), iso(to), F.lit(".")))
        .when(no_compare, F.lit("Restated the claim; no earlier deadline to compare."))
        .when(F.col("met"), F.concat(F.lit("The earlier deadline ("), iso(was), F.lit(") was met; this sets a new one, "), iso(to), F.lit(".")))
        .when(shift >= SLIP_DAYS, F.concat(F.lit("Deadline moved from "), iso(was), F.lit(" to "), iso(to), F.lit(".")))
        .when(shift <= -SLIP_DAYS, F.concat(F.lit("Deadline moved earlier, from "), iso(was), F.lit(" to "), iso(to), F.lit(".")))
        .when(was == to, F.concat(F.lit("Restated with the same deadline, "), iso(to), F.lit(".")))
        .otherwise(F.concat(F.lit("Restated with a deadline of "), iso(to), F.lit(" (previously "), iso(was), F.lit(").")))
    )
    previous = F.when(first, F.lit(None)).when(no_compare, F.col("previous_id")).otherwise(F.col("pick.id"))
    return out.select(
        *CHAIN,
        "said_date",
        "target_date",
        F.struct(
            label.alias("label"), previous.alias("previous_claim_id"), note.alias("note"), F.lit(None).cast("string").alias("labeled_by")
        ).alias("detected"),
    )


def detect_drift(claims: DataFrame) -> DataFrame:
    """`claims` with a `detected` drift struct; hot chains are split by the skew join, never gathered."""
    c, k = claims.alias("c"), label_keys(claims).alias("k")
    on = (
        (F.col("c.person_slug") == F.col("k.person_slug"))
        & (F.col("c.topic") == F.col("k.topic"))
        & (F.col("c.said_date") == F.col("k.said_date"))
        & F.col("c.target_date").eqNullSafe(F.col("k.target_date"))
    )
    return c.join(k, on, "left").select("c.*", "k.detected")


def apply_drift(claims: DataFrame, keep_curated: bool = True) -> DataFrame:
    """Set `drift` to the measured label; a seed claim's hand-written label ("human:...") survives."""
    curated = (F.col("origin") == "seed") & F.col("drift.labeled_by").startswith("human:")
    new = F.when(F.coalesce(curated, F.lit(False)), F.col("drift")).otherwise(F.col("detected")) if keep_curated else F.col("detected")
    return detect_drift(claims).withColumn("drift", new).drop("detected")


def drift_on_touched(claims: DataFrame, touched: DataFrame) -> DataFrame:
    """Re-label only the chains `touched` names (incremental runs)."""
    keys = touched.select(*CHAIN).distinct()
    return detect_drift(claims.join(keys, list(CHAIN), "left_semi"))


def _mentions_all_dates(text: Column, source: Column) -> Column:
    return F.forall(F.regexp_extract_all(source, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), lambda d: F.contains(text, d))


def merge_transition(det: Column, label: Column, note: Column, labeled_by: Column) -> Column:
    """The measured label combined with a proposed one; measured slips only yield to a changed claim."""
    d_label, d_note = det["label"], det["note"]
    slipped = d_label.isin(*SLIP_LABELS)
    ignore = (d_label == "first") | ~label.isin(*JUDGMENT_LABELS) | (slipped & ~label.isin(*CLAIM_CHANGE_LABELS))
    plain = F.concat(F.lit("Labeled "), F.replace(label, F.lit("_"), F.lit(" ")), F.lit(" relative to the previous claim."))
    said = neutral_or(F.trim(F.coalesce(note, F.lit(""))), plain)
    said = F.when(said == "", plain).otherwise(said)
    full = F.when(slipped & ~_mentions_all_dates(said, d_note), F.concat(said, F.lit(" "), d_note)).otherwise(said)
    merged = F.struct(
        label.alias("label"), det["previous_claim_id"].alias("previous_claim_id"), full.alias("note"), labeled_by.alias("labeled_by")
    )
    return F.when(label.isNull() | ignore, det).otherwise(merged)


def merge_labels(claims: DataFrame, proposed: DataFrame, relabel: bool = False) -> DataFrame:
    """Claims with `drift` from the measured label, proposed labels and curated labels.

    `proposed`: person_slug, topic, claim_id, label, note, labeled_by, ordinal.
    The first valid row per id wins; ids outside the named chain, the chain's
    first claim, unknown labels and one-occasion chains are ignored.
    """
    row = F.struct("ordinal", "label", "note", "labeled_by")
    best = (
        proposed.where(F.col("label").isin(*TRANSITION_LABELS))
        .groupBy(*CHAIN, F.col("claim_id").alias("id"))
        .agg(F.min(row).alias("p"))
    )
    chain_first = claims.groupBy(*CHAIN).agg(
        F.min(F.struct("said_date", "id"))["id"].alias("chain_first_id"),
        (F.min("said_date") < F.max("said_date")).alias("has_transitions"),
    )
    joined = detect_drift(claims).join(best, [*CHAIN, "id"], "left").join(chain_first, [*CHAIN], "left")
    usable = F.col("has_transitions") & (F.col("id") != F.col("chain_first_id"))
    merged = merge_transition(F.col("detected"), F.when(usable, F.col("p.label")), F.col("p.note"), F.col("p.labeled_by"))
    curated = F.coalesce(
        (F.col("origin") == "seed") & F.col("drift.labeled_by").startswith("human:") & F.col("has_transitions"), F.lit(False)
    )
    drift = merged if relabel else F.when(curated, F.col("drift")).otherwise(merged)
    return joined.withColumn("drift", drift).drop("detected", "p", "chain_first_id", "has_transitions")


def label_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """People with a claim whose (label, previous id, note) changes between two (id, person_slug, drift) tables."""

    def key(d: Column) -> Column:
        return F.struct(d["label"].alias("l"), F.coalesce(d["previous_claim_id"], F.lit("")).alias("p"), d["note"].alias("n"))

    before = old.select("id", F.col("drift").alias("before"))
    return (
        new.where(F.col("drift").isNotNull())
        .join(before, "id", "left")
        .where(F.col("before").isNull() | ~key(F.col("drift")).eqNullSafe(key(F.col("before"))))
        .select("person_slug")
        .distinct()
    )


def chain_counts(claims: DataFrame) -> DataFrame:
    """One row per chain over claims that carry drift labels: size, span, first and last deadline, label counts."""
    order = F.struct("said_date", "id", "target_date")
    dated = F.when(F.col("target_date").isNotNull(), order)
    labels = ("pushed_later", "pulled_earlier", "goalposts_moved", "reversed", "escalated", "softened")
    return claims.groupBy(*CHAIN).agg(
        F.count("*").alias("claims"),
        F.min("said_date").alias("first_said"),
        F.max("said_date").alias("last_said"),
        F.min(dated)["target_date"].alias("first_deadline"),
        F.max(dated)["target_date"].alias("last_deadline"),
        F.count("target_date").alias("dated"),
        F.count_if(F.col("drift.label").isin(*NOTABLE_DRIFT)).alias("notable"),
        F.count_if(~F.col("type").eqNullSafe("factual")).alias("opinions"),
        *[F.count_if(F.col("drift.label") == l).alias(l) for l in labels],
        *[F.min(F.when(F.col("drift.label") == l, F.struct("said_date", "id"))).alias(f"{l}_at") for l in labels],
    )


def _times(n: Column) -> Column:
    return F.when(n == 1, "once").when(n == 2, "twice").otherwise(F.concat(n.cast("string"), F.lit(" times")))


def _deadline_text(d: Column) -> Column:
    """A year end reads as the year, a month end as the month, any other day in full."""
    return (
        F.when((F.month(d) == 12) & (F.dayofmonth(d) == 31), F.year(d).cast("string"))
        .when(d == F.last_day(d), F.date_format(d, "MMM yyyy"))
        .otherwise(F.date_format(d, "MMM d, yyyy"))
    )


STORY_TEXT = {
    "pushed_later": "deadline pushed later", "pulled_earlier": "deadline pulled earlier", "goalposts_moved": "goalposts moved",
    "reversed": "reversed", "escalated": "escalated", "softened": "softened",
}


def chain_steps(claims: DataFrame, counts: DataFrame) -> DataFrame:
    """The deadlines of every chain with two or more claims, one row per step, ordered by (said_date, id)."""
    step = F.coalesce(iso(F.col("target_date")), F.concat(F.lit("no deadline (said "), iso(F.col("said_date")), F.lit(")")))
    long_chains = counts.where(F.col("claims") >= 2).select(*CHAIN)
    return claims.join(long_chains, list(CHAIN), "left_semi").select(*CHAIN, "said_date", "id", step.alias("step"), "drift")


def chain_summaries(counts: DataFrame) -> DataFrame:
    """Two renderings per chain: one sentence on how it moved, and the short story line (NULL when nothing moved)."""

    def said(column: str, text: str) -> Column:
        return F.when(F.col(column) > 0, F.concat(F.lit(text + " "), _times(F.col(column))))

    first, last = _deadline_text(F.col("first_deadline")), _deadline_text(F.col("last_deadline"))
    arrow = F.when((F.col("dated") >= 2) & (first != last), F.concat(first, F.lit(" → "), last))
    parts = F.array_compact(
        F.array(said("pushed_later", "Deadline pushed later"), arrow, said("goalposts_moved", "goalposts moved"), said("reversed", "reversed"))
    )
    n = F.when(F.col("claims") == 1, "1 claim").otherwise(F.concat(F.col("claims").cast("string"), F.lit(" claims")))
    span = F.concat(n, F.lit(", "), F.date_format("first_said", "MMM yyyy"), F.lit(" to "), F.date_format("last_said", "MMM yyyy"))
    sentence = F.array_join(parts, ", ")
    cased = F.concat(F.upper(F.substring(sentence, 1, 1)), sentence.substr(F.lit(2), F.length(sentence)))
    # In the order the moves first happened.
    moves = F.array_compact(
        F.array(
            *[
                F.when(F.col(l) > 0, F.struct(F.col(f"{l}_at").alias("at"), F.concat(F.lit(text + " "), _times(F.col(l))).alias("text")))
                for l, text in STORY_TEXT.items()
            ]
        )
    )
    story = F.transform(F.sort_array(moves), lambda m: m["text"])
    years = F.concat(F.lit(" ("), F.year("first_said").cast("string"), F.lit(" to "), F.year("last_said").cast("string"), F.lit(")."))
    return counts.withColumn(
        "summary", F.when(F.size(parts) == 0, span).otherwise(F.concat(cased, F.lit(". "), span, F.lit(".")))
    ).withColumn(
        "story",
        F.when(F.size(story) > 0, F.concat(F.lit("Story on "), F.col("topic"), F.lit(": "), F.array_join(story, ", "), years)),
    )


def printed_stories(counts: DataFrame) -> DataFrame:
    """Chains worth printing: at least two claims, one of them not a plain fact."""
    return counts.where((F.col("claims") >= 2) & (F.col("opinions") > 0))


def moving_chains(counts: DataFrame, top: int = 4) -> DataFrame:
    """The chains that moved most: notable moves, then length, then topic."""
    return (
        counts.where((F.col("claims") >= 2) & (F.col("notable") > 0))
        .orderBy(F.col("notable").desc(), F.col("claims").desc(), "topic", "person_slug")
        .limit(top)
    )


def latest_move(claims: DataFrame) -> DataFrame:
    """Per person, the latest claim whose label is notable; claims said the same day fall to ledger order."""
    newest = F.min_by(F.struct("id", "topic", "said_date", F.col("drift.label").alias("label")), F.struct((-F.unix_date("said_date")).alias("d"), F.col("id")))
    return (
        claims.where(F.col("drift.label").isin(*NOTABLE_DRIFT))
        .groupBy("person_slug")
        .agg(newest.alias("m"))
        .select("person_slug", "m.*")
    )


DRIFT_TEXT = {
    "pushed_later": "Deadline pushed",
    "pulled_earlier": "Deadline pulled in",
    "goalposts_moved": "Goalposts moved",
    "reversed": "Reversed",
    "escalated": "Escalated",
    "softened": "Softened",
}


def drift_text(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DRIFT_TEXT.items() for x in kv]), label)
