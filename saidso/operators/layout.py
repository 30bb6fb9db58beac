"""Transcript layout: where every segment sits in its transcript, computed block by block.

A transcript may hold a third of all segments, so prefix sums and "last known
value" lookups never run over a whole transcript in one task. Segments are cut
into blocks of consecutive numbers; blocks are summarized with partial
aggregation, the short list of blocks is windowed, and each block is finished on
its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saidso.functions.tokens import LAST_SEEN

BLOCK_SEGMENTS = 4096


def spread(segments: DataFrame, keys: list[str], order: str, block: int = BLOCK_SEGMENTS) -> DataFrame:
    """Rows placed by (keys, block): the one shuffle of the rows, which the passes of `in_order` then build on."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.withColumn("_block", F.floor(F.col(order) / block)).repartition(n, *keys, "_block")


def in_order(
    df: DataFrame,
    keys: list[str],
    order: str,
    running: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    block: int = BLOCK_SEGMENTS,
    more: bool = False,
) -> DataFrame:
    """Per row, within `keys` and by the integer column `order`: sums over earlier rows (`running`),
    the last non-null value before (`previous`), and the first non-null value after (`following`)."""
    running, previous, following = running or {}, previous or {}, following or {}
    everything = {**running, **previous, **following}
    keep = [c for c in df.columns if c != "_block"]
    # A block number left by an earlier pass keeps its partitioning; `more` leaves it for the next pass.
    cut = F.col("_block") if "_block" in df.columns else F.floor(F.col(order) / block).alias("_block")
    rows = df.select(*keep, *[c.alias(f"_v_{n}") for n, c in everything.items()], cut)
    at = F.col(order)

    def v(n: str) -> Column:
        return F.col(f"_v_{n}")

    def seen(n: str) -> Column:
        return F.when(v(n).isNotNull(), at)

    blocks = rows.groupBy(*keys, "_block").agg(
        *[F.sum(v(n)).alias(f"_b_{n}") for n in running],
        *[F.max_by(v(n), seen(n)).alias(f"_b_{n}") for n in previous],
        *[F.min_by(v(n), seen(n)).alias(f"_b_{n}") for n in following],
    )
    back = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(*keys).orderBy("_block").rowsBetween(1, W.unboundedFollowing)
    carry = blocks.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_b_{n}").over(back), F.lit(0)).alias(f"_c_{n}") for n in running],
        *[F.last(f"_b_{n}", ignorenulls=True).over(back).alias(f"_c_{n}") for n in previous],
        *[F.first(f"_b_{n}", ignorenulls=True).over(ahead).alias(f"_c_{n}") for n in following],
    )
    inner = W.partitionBy(*keys, "_block").orderBy(order)
    before, after = inner.rowsBetween(W.unboundedPreceding, -1), inner.rowsBetween(1, W.unboundedFollowing)
    out = rows.join(carry, [*keys, "_block"]).select(
        *keep,
        *(["_block"] if more else []),
        *[(F.col(f"_c_{n}") + F.coalesce(F.sum(v(n)).over(before), F.lit(0))).alias(n) for n in running],
        *[F.coalesce(F.last(v(n), ignorenulls=True).over(before), F.col(f"_c_{n}")).alias(n) for n in previous],
        *[F.coalesce(F.first(v(n), ignorenulls=True).over(after), F.col(f"_c_{n}")).alias(n) for n in following],
    )
    return out


def speaker_label() -> Column:
    name = F.trim(F.coalesce("speaker", F.lit("")))
    return F.when(name != "", F.concat(name, F.lit(": "))).otherwise("")


def layout(
    segments: DataFrame, previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None, more: bool = False, drop: tuple[str, ...] = ()
) -> DataFrame:
    """Segments with `offset`, `text_start`, `n_chars` (characters into the transcript text) and `start_sec`.

    One line per segment, labelled with its speaker, joined by newlines; `start_sec`
    is the segment's start or the nearest earlier one; `opening` is the last visible
    character before the segment's own words. Columns in `drop` are read but not shuffled.
    """
    tail = F.regexp_extract(F.concat(speaker_label(), "text"), LAST_SEEN, 1)
    s = segments.withColumn("_label", F.length(speaker_label())).withColumn("n_chars", F.col("_label") + F.length("text"))
    s = s.withColumn("_end", F.nullif(tail, F.lit(""))).drop(*drop)
    placed = in_order(
        s,
        ["transcript_id"],
        "seg_no",
        running={"offset": F.col("n_chars") + 1},
        previous={"_start": F.col("start"), "_tail": F.col("_end"), **(previous or {})},
        following=following,
        more=more,
    )
    opening = F.when(F.col("_label") > 0, ":").otherwise(F.coalesce("_tail", F.lit("")))
    return (
        placed.withColumn("text_start", F.col("offset") + F.col("_label"))
        .withColumn("start_sec", F.coalesce("start", "_start"))
        .withColumn("opening", opening)
        .drop("_start", "_tail", "_label", "_end")
    )


def transcript_lengths(placed: DataFrame) -> DataFrame:
    return placed.groupBy("transcript_id").agg(F.max(F.col("offset") + F.col("n_chars")).alias("n_chars"))


def locate(offsets: DataFrame, placed: DataFrame, bin_chars: int = 4096) -> DataFrame:
    """Interval join of character offsets to segments: (…, seg_no, start_sec) of the last line starting at or before each.

    Lines are listed under every bin of characters they cover, so both sides meet
    on (transcript, bin) and the range check is local.
    """
    spans = placed.select(
        "transcript_id", "seg_no", "start_sec", F.col("offset").alias("_from"), (F.col("offset") + F.col("n_chars") + 1).alias("_to"),
    ).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / bin_chars), F.floor((F.col("_to") - 1) / bin_chars))))
    asked = offsets.withColumn("_bin", F.floor(F.col("char_offset") / bin_chars))
    hit = asked.join(spans, ["transcript_id", "_bin"]).where((F.col("char_offset") >= F.col("_from")) & (F.col("char_offset") < F.col("_to")))
    return hit.drop("_bin", "_from", "_to")


def trim_minutes(segments: DataFrame, minutes: float) -> DataFrame:
    """The leading `minutes` of every transcript: by start times, or by 900 characters a minute when untimed.

    Timed: everything before the first segment at or past the limit. Untimed: the
    budget is spent in order and the last segment is cut at a word.
    """
    limit, budget = minutes * 60, int(minutes * 900)
    cut_at = segments.groupBy("transcript_id").agg(
        F.min(F.when(F.col("start") >= limit, F.col("seg_no"))).alias("_cut"), F.count("start").alias("_timed"), F.min("seg_no").alias("_first"),
    )
    placed = in_order(segments, ["transcript_id"], "seg_no", running={"_used": F.length("text") + 1})
    j = placed.join(cut_at, "transcript_id")
    room = F.lit(budget) - F.col("_used")
    piece = F.left(F.col("text"), F.greatest(room, F.lit(0)).cast("int"))
    at_word = F.length(piece) - F.length(F.substring_index(piece, " ", -1)) - 1
    cut = F.trim(F.when(at_word > room * 0.5, F.left(piece, at_word.cast("int"))).otherwise(piece))
    text = F.when((F.col("_timed") > 0) | (F.length("text") <= room), F.col("text")).otherwise(cut)
    keep = F.when(F.col("_timed") > 0, F.col("_cut").isNull() | (F.col("seg_no") < F.col("_cut"))).otherwise(
        (room > 0) & ((F.length("text") <= room) | (cut != ""))
    )
    # Nothing left: the first segment stays, whole.
    kept = j.withColumn("_keep", keep).withColumn("_text", text)
    empty = kept.groupBy("transcript_id").agg((F.count_if("_keep") == 0).alias("_none"))
    k = kept.join(empty, "transcript_id")
    first = F.col("_none") & (F.col("seg_no") == F.col("_first"))
    return k.where(F.col("_keep") | first).withColumn("text", F.when(first, F.col("text")).otherwise(F.col("_text"))).select(*segments.columns)
