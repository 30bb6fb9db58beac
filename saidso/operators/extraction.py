"""Candidate claims to ledger claims: hedge near the quote, grounding, building the row, dropping near-duplicates."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saidso.functions import tokens as K
from saidso.functions.binding import let
from saidso.functions.dates import calendar_date, iso
from saidso.functions.hedge import claim_probability
from saidso.functions.ids import claim_id, slugify
from saidso.functions.urls import deep_link
from saidso.operators.layout import in_order
from saidso.operators.quotes import verify_quotes
from saidso.session import materialize

LOOK_BEHIND, LOOK_AHEAD = 2, 3
MIN_QUOTE_WORDS = 5
NEAR_DUPLICATE = 0.8

_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_EDGE, _STOP = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# How a claim spells its deadline, in the order they are blanked.
DATE_PHRASES = (
    rf"{_EDGE}\d{{4}}-\d{{2}}-\d{{2}}{_STOP}",
    rf"(?i){_EDGE}{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?{_STOP}",
    rf"(?i){_EDGE}\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH}",
)
# Fixed values.
DEADLINE_TOKENS = ("first", "second", "third", "fourth", "q1", "q2", "q3", "q4", "h1", "h2")
FRACTION_PERCENT = {"half": "50", "third": "33", "quarter": "25"}
GROUNDING_STOPWORDS = tuple(
    (
        "a an and are as at be been by can could did do does for from had has have he her his i if in into is it its "
        "more most not of on or our she so than that the their them they this to was we were which who will with would "
        "about after also any before being between both each end first last least less many much must next no none only "
        "other over per same should some such then there these those through under until upon very what when where while "
        "year years month months quarter within company companys"
    ).split()
)


def _contains_words(words: Column, phrase: Column) -> Column:
    """Word lists: `phrase` occurs in `words` as whole words."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(phrase, " "), F.lit(" ")))


def hedge_near_quote(matches: DataFrame, segments: DataFrame) -> DataFrame:
    """(candidate_id, hedge_heard): the hedge is in the matched words or in a line close by that the speaker may have said.

    `matches`: candidate_id, transcript_id, hedge, speaker, matched_text, first_seg,
    last_seg. The band join lists each match's few segment numbers, so it is an
    equi-join on (transcript, segment).
    """
    m = (
        matches.withColumn("want", K.match_words(F.col("hedge")))
        .withColumn("inside", K.match_words(F.col("matched_text")))
        .withColumn("speaker_words", K.match_words(F.col("speaker")))
        .withColumn("own", (F.size("want") > 0) & F.coalesce(_contains_words(F.col("inside"), F.col("want")), F.lit(False)))
    )
    asked = m.where((F.size("want") > 0) & ~F.col("own") & F.col("first_seg").isNotNull())
    near = asked.select(
        "candidate_id", "transcript_id", "want", "speaker_words", "first_seg", "last_seg",
        F.explode(F.sequence(F.greatest(F.col("first_seg") - LOOK_BEHIND, F.lit(0)), F.col("last_seg") + LOOK_AHEAD)).alias("seg_no"),
    )
    s = segments.select("transcript_id", "seg_no", F.nullif(F.coalesce("speaker", F.lit("")), F.lit("")).alias("label"), "text")
    j = (
        near.join(s, ["transcript_id", "seg_no"])
        .withColumn("label_words", K.match_words(F.col("label")))
        .withColumn("line_words", K.match_words(F.col("text")))
    )
    by_speaker = (
        F.col("seg_no").between(F.col("first_seg"), F.col("last_seg")) | F.col("label").isNull() | K.same_speaker(F.col("label_words"), F.col("speaker_words"))
    )
    heard = j.where(by_speaker & _contains_words(F.col("line_words"), F.col("want"))).select("candidate_id").distinct().withColumn("close", F.lit(True))
    return m.join(heard, "candidate_id", "left").select("candidate_id", (F.col("own") | F.coalesce("close", F.lit(False))).alias("hedge_heard"))


def clean_hedge(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(s), "^[\"'“”‘’]+|[\"'“”‘’]+$", ""))


def grounding_words(df: DataFrame) -> DataFrame:
    """Word lists a grounding check needs, as columns: quote, claim without its date phrases, speaker."""
    text = F.col("claim")
    for phrase in DATE_PHRASES:
        text = F.regexp_replace(text, phrase, " ")
    return (
        df.withColumn("quote_words", K.match_words(F.col("quote")))
        .withColumn("claim_words", K.match_words(text))
        .withColumn("name_words", K.match_words(F.col("person")))
    )


def grounding_problem() -> Column:
    """Why a claim says more than its quote, or NULL; over `grounding_words` columns, said_date and target_date."""
    q, c = F.col("quote_words"), F.col("claim_words")
    short = F.concat(
        F.lit("quote is too short to carry a claim ("), F.size(q).cast("string"), F.lit(f" words; at least {MIN_QUOTE_WORDS} needed)")
    )
    fractions = F.create_map(*[F.lit(x) for kv in FRACTION_PERCENT.items() for x in kv])
    known = F.concat(
        K.number_signature(q), K.number_signature(K.join_product_codes(q)), F.array_compact(F.transform(q, lambda w: F.try_element_at(fractions, w)))
    )
    said, target = F.year("said_date"), F.coalesce(F.year("target_date"), F.year("said_date"))

    def deadline(n: Column) -> Column:
        year = n.try_cast("int")
        return n.isin(*DEADLINE_TOKENS) | (n.rlike(r"^\d{4}$") & (year >= said - 1) & (year <= F.greatest(said, target) + 1))

    def extra_numbers(k: Column) -> Column:
        def missing(words: Column) -> Column:
            return F.filter(K.number_signature(words), lambda n: ~F.array_contains(k, n) & ~F.coalesce(deadline(n), F.lit(False)))

        written = missing(c)
        return F.when((F.size(written) > 0) & (F.size(missing(K.join_product_codes(c))) > 0), F.array_distinct(written))

    extra = let(known, extra_numbers)
    names = F.when(F.size("name_words") > 0, F.col("name_words")).otherwise(F.array(F.lit("")))

    def stems(words: Column) -> Column:
        content = F.filter(
            words, lambda w: (F.length(w) >= 4) & ~w.rlike(r"\d") & ~w.isin(*GROUNDING_STOPWORDS) & ~F.array_contains(names, w)
        )
        return F.transform(content, lambda w: F.substring(w, 1, 4))

    return (
        F.when(F.size(q) < MIN_QUOTE_WORDS, short)
        .when(extra.isNotNull(), F.concat(F.lit("claim has numbers the quote does not: "), F.array_join(extra, ", ")))
        .when(~F.arrays_overlap(stems(c), stems(q)), F.lit("claim shares no content words with the quote"))
    )


def extract_claims(candidates: DataFrame, segments: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified, grounded candidates as ledger claims (with `ordinal` and `transcript_id`), and the dropped ones with reasons.

    `candidates`: candidate_id, transcript_id, ordinal, speaker, host, quote, claim,
    type, topic, target_date (string), target_date_inferred, resolution_criteria,
    hedge, specificity. `sources`: transcript_id, source (with its date).
    """
    c = candidates.withColumn("quote", F.trim("quote")).withColumn("claim", F.trim("claim"))
    blank = (F.coalesce("quote", F.lit("")) == "") | (F.coalesce("claim", F.lit("")) == "")
    missing = c.where(blank).select("candidate_id", "quote", F.lit("missing quote or claim text").alias("reason"))
    checked = materialize(verify_quotes(c.where(~blank), segments))
    unverified = checked.where(~F.col("verified")).select("candidate_id", "quote", F.coalesce("reason", F.lit("quote not found in transcript")).alias("reason"))
    good = checked.where("verified").withColumn("hedge", clean_hedge(F.col("hedge")))
    heard = hedge_near_quote(good, segments)
    j = good.join(heard, "candidate_id").join(sources.select("transcript_id", "source"), "transcript_id")
    said = F.col("source.date")
    deadline = calendar_date(F.col("target_date").cast("string"))
    kept_deadline = F.when((F.col("type") == "prediction") & (deadline >= said), deadline)
    sec = F.col("timestamp_sec").cast("double")
    link = deep_link(F.col("source.url"), sec)
    built = (
        j.withColumn("person", F.col("speaker"))
        .withColumn("person_slug", slugify(F.col("speaker")))
        .withColumn("said_date", said)
        .withColumn("target_date", kept_deadline)
        .withColumn("quote", F.concat("matched_text", F.coalesce("closing", F.lit(""))))
        .withColumn("hedge", F.when(F.col("hedge_heard"), F.col("hedge")).otherwise(""))
        .withColumn("topic", F.coalesce(F.nullif(slugify(F.col("topic")), F.lit("")), F.lit("general")))
        .withColumn("target_date_inferred", F.when(F.col("target_date").isNotNull(), F.col("target_date_inferred")))
        .withColumn("resolution_criteria", F.trim("resolution_criteria"))
        .withColumn("specificity", F.coalesce(F.least(F.lit(5), F.greatest(F.lit(1), F.col("specificity"))), F.lit(1)).cast("int"))
        .withColumn(
            "source",
            F.col("source").withField("timestamp_sec", F.coalesce(sec, F.col("source.timestamp_sec"))).withField("deep_link", F.coalesce(link, F.col("source.deep_link"))),
        )
        .withColumn("implied_probability", claim_probability(F.col("hedge"), F.col("claim")))
    )
    built = grounding_words(built.withColumn("id", claim_id(F.col("person_slug"), F.col("said_date"), F.col("claim"))))
    graded = materialize(built.withColumn("ungrounded", grounding_problem()))
    dropped = graded.where(F.col("ungrounded").isNotNull()).select("candidate_id", "quote", F.col("ungrounded").alias("reason"))
    claims = graded.where(F.col("ungrounded").isNull()).select(
        "transcript_id", "ordinal", "id", "person", "person_slug", "quote", F.lit(True).alias("quote_verified"), "claim", "type", "topic", "said_date", "target_date",
        "target_date_inferred", "resolution_criteria", "hedge", "implied_probability", "specificity", "source", F.lit("pending").alias("verdict"),
        F.lit("extracted").alias("origin"),
    )
    return claims, missing.unionByName(unverified).unionByName(dropped)


# ---- Near-duplicates -------------------------------------------------------------

RUN_ROWS = 4096
#: Rows of a component that one task settles.
PART_ROWS = 20_000
#: Keys a Python worker hands on at a time, about.
KEY_ROWS = 200_000
#: Segments that similar word sets share at least; unlike sets rarely share as many.
AGREED = 4


def _similar(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, True).otherwise(shared / union >= NEAR_DUPLICATE)


#: Sizes of word sets fall into classes that end at these; a set of at most 5/4 the size is in the same class or the next.
TOPS = [1]
while TOPS[-1] < 1 << 31:
    TOPS.append(-(-5 * TOPS[-1] // 4))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_keys(words: np.ndarray, block: int, size_class: int) -> np.ndarray:
    """A key for each segment of a set of word hashes, equal where two sets of a block hold the same words in it.

    Sets of sizes a and b with Jaccard similarity of 0.8 differ in at most (a + b) / 9 words. There are `AGREED` segments more
    than words that the largest sets of the class may differ in, so as many at least hold no difference.
    """
    n = 2 * TOPS[size_class] // 9 + AGREED
    held = np.zeros(n, np.uint64)
    np.add.at(held, (words % np.uint64(n)).astype(np.intp), words)
    place = (np.arange(n, dtype=np.uint64) << np.uint64(8)) + np.uint64(size_class)
    return _mix(held ^ _mix(place ^ np.uint64(block)))


def parity_sketch(words: np.ndarray, size_class: int) -> np.ndarray:
    """As many bits as the sets of the class have words at most, each the parity of the words it stands for: two sets differ in no fewer words than bits."""
    n = (TOPS[size_class] + 63) // 64 * 64
    odd = np.bincount((_mix(words) % np.uint64(n)).astype(np.intp), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _hashes(values: pa.ListArray) -> list[np.ndarray]:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ends = np.cumsum(pc.list_value_length(values).to_numpy(zero_copy_only=False))[:-1]
    return np.split(flat, ends)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, n, own: the keys of each set in its own class, and in the next one where that has sets near its size."""
    for batch in batches:
        nodes, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "block"))
        parts, rows = [], 0
        for node, block, words in zip(nodes, blocks.view(np.uint64), _hashes(batch.column("hashes"))):
            n = len(words)
            own = bisect_left(TOPS, n)
            for c in range(own, own + 1 + (5 * n // 4 > TOPS[own])):
                keys = segment_keys(words, block, c).view(np.int64)
                parts.append((keys, np.full(len(keys), node), np.full(len(keys), n, np.int32), np.full(len(keys), c == own)))
                rows += len(keys)
            if rows >= KEY_ROWS:
                yield _key_batch(parts)
                parts, rows = [], 0
        if parts:
            yield _key_batch(parts)


def _key_batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["key", "node", "n", "own"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, and the sketches of each set in its own class and the next."""
    for batch in batches:
        words = _hashes(batch.column("hashes"))
        size = [len(w) for w in words]
        own, above = ([parity_sketch(w, bisect_left(TOPS, len(w)) + up) for w in words] for up in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(size, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(above, pa.list_(pa.int64()))],
            names=["node", "n", "own", "above"],
        )


def _node(key: str) -> Column:
    return F.xxhash64(key)


def _sets(variants: DataFrame, block: str, key: str, words: str) -> DataFrame:
    """node, block, hashes: the word sets in numbers."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return variants.select(_node(key).alias("node"), _node(block).alias("block"), hashes.alias("hashes")).where(F.size("hashes") > 0)


def _candidates(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that agree in enough segments and may be near by size. `sets`: node, block, hashes."""
    keyed = sets.mapInArrow(_keyed, "key long, node long, n int, own boolean")
    shared = keyed.repartition("key").dropDuplicates(["key", "node", "n"])
    shared = materialize(shared.withColumn("times", F.count("*").over(W.partitionBy("key"))).where("times > 1").drop("times"))
    x, y = shared.where("own").alias("x"), shared.alias("y")
    near = (5 * F.least("x.n", "y.n") >= 4 * F.greatest("x.n", "y.n")) & ((~F.col("y.own")) | (F.col("x.node") < F.col("y.node")))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & near)
    pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return materialize(pairs.groupBy("a", "b").agg(F.count("*").alias("times")).where(F.col("times") >= AGREED).select("a", "b"))


def _within(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sketches do not rule out 0.8."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sketches = materialize(sets.join(asked, "node", "left_semi").mapInArrow(_sketched, "node long, n int, own array<long>, above array<long>").dropDuplicates(["node", "n"]))
    side = lambda at: sketches.select(F.col("node").alias(at), F.struct("n", "own", "above").alias(f"_{at}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    p, q = F.col("_a"), F.col("_b")
    small = F.when(p["n"] <= q["n"], p).otherwise(q)
    large = F.when(p["n"] <= q["n"], q).otherwise(p)
    same = F.when(F.size(small["own"]) == F.size(large["own"]), small["own"])
    # Classes of one word of bits look alike in length: the higher sketch is of the same bits then.
    low = F.coalesce(same, small["above"])
    apart = F.aggregate(F.zip_with(low, large["own"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return met.where((F.size(low) != F.size(large["own"])) | (9 * apart <= p["n"] + q["n"])).select("a", "b")


def similar_variants(variants: DataFrame, block: str = "block_key", key: str = "variant", words: str = "words") -> DataFrame:
    """Pairs (a, b) of distinct word sets in one block with Jaccard similarity of at least 0.8; a set may be listed more than once.

    Sets meet on equal segments, and parity sketches rule out nearly all that are not similar, so that words are sent only
    for pairs that most likely are. Both are exact; hashes that collide only make more to compare.
    """
    v = variants.select(block, key, words)
    sets = _sets(v, block, key, words)
    pairs = materialize(_within(_candidates(sets), sets))
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    full = materialize(v.withColumn("node", _node(key)).join(asked, "node", "left_semi").dropDuplicates([block, key]))
    side = lambda at, to: full.select(F.col("node").alias(at), F.col(block).alias(f"_{to}"), F.col(key).alias(to), F.col(words).alias(f"{to}w"))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where((F.col("_x") == F.col("_y")) & (F.col("x") != F.col("y")))
    return met.where(_similar(F.col("xw"), F.col("yw"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components, by smallest-label spreading with pointer jumping.

    Each round is written to the shared folder, so a lost executor never replays
    earlier rounds; the driver only sees one number per round.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        own = labels.join(near, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("was"))
        jump = own.select(F.col("node").alias("label"), F.col("label").alias("up"))
        nxt = materialize(own.join(jump, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "was"))
        if nxt.where("label <> was").isEmpty():
            return nxt.select("node", F.col("label").alias("component"))
        labels = nxt.select("node", "label")


def _collapse_runs(rows: DataFrame, rounds: int = 2) -> DataFrame:
    """Drop a row when the row before it in its component repeats its variant, id and specificity.

    Repeating the last step of the greedy pass changes nothing. Windows are cut by
    row number, so none holds more than a fixed span however many copies there are.
    """
    span = RUN_ROWS
    for _ in range(rounds):
        w = W.partitionBy("component", F.floor(F.col("ordinal") / span)).orderBy("ordinal")
        same = F.struct("variant", "id", "specificity")
        rows = rows.withColumn("_p", F.lag(same).over(w)).where(F.col("_p").isNull() | (F.col("_p") != same)).drop("_p")
        span *= RUN_ROWS
    return rows


SLOT = "place long, ordinal long, variant string, id string, specificity int"


def _seated(rows: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
    """The slots that a part of a component opens or fills anew. `rows`: ordinal, variant, id, specificity, alike; `slots`: those that a row here may match."""
    holders: dict[str, set[int]] = defaultdict(set)
    now = {}

    def seat(place: int, row: tuple) -> None:
        if place in now:
            for key in now[place][1:3]:
                holders[key].discard(place)
        now[place] = row
        for key in row[1:3]:
            holders[key].add(place)

    for place, *row in slots.sort_values("place").itertuples(index=False):
        seat(place, tuple(row))
    given = dict(now)
    for row, alike in zip(rows[["ordinal", "variant", "id", "specificity"]].itertuples(index=False, name=None), rows["alike"]):
        matched = [p for key in (*alike, row[1], row[2]) for p in holders.get(key, ())]
        if not matched:
            seat(row[0], row)
        elif row[3] > now[min(matched)][3]:
            seat(min(matched), row)
    changed = [(place, *row) for place, row in now.items() if given.get(place) != row]
    return pd.DataFrame(changed, columns=["place", "ordinal", "variant", "id", "specificity"])


def settle_components(rows: DataFrame, near: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(ordinal, place) of the rows that stay: in seen order, the more specific of two duplicates, ties to the first.

    `rows`: component, ordinal, variant, id, specificity; `near`: pairs (a, b) of similar variants. A component is taken in
    parts of bounded size, the same part of all components in one round; what a part needs to know of earlier ones is which
    slots its rows may match, and those come by a join on the wording or id that holds them now.
    """
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    alike = both.groupBy(F.col("a").alias("variant")).agg(F.collect_list("b").alias("alike"))
    slim = rows.select("component", F.col("ordinal").cast("long").alias("ordinal"), "variant", "id", "specificity")
    ranked = in_order(slim, ["component"], "ordinal", running={"rank": F.lit(1)})
    ranked = ranked.join(alike, "variant", "left").withColumn("alike", F.coalesce("alike", F.array().cast("array<string>")))
    ranked = materialize(ranked.withColumn("part", F.floor(F.col("rank") / part_rows)).drop("rank"))
    last = ranked.groupBy("component").agg(F.max("part").alias("last"))
    last = materialize(last)
    rounds = (last.agg(F.max("last")).first()[0] or 0) + 1
    spark, done = rows.sparkSession, None
    slots = spark.createDataFrame([], f"component {rows.schema['component'].dataType.simpleString()}, {SLOT}")
    columns = slots.columns
    for turn in range(rounds):
        now = ranked.where(F.col("part") == turn).drop("part")
        asks = now.select("component", F.explode(F.concat(F.col("alike"), F.array("variant", "id"))).alias("key")).distinct()
        held = slots.withColumn("key", F.explode(F.array("variant", "id")))
        near_slots = held.join(asks, ["component", "key"], "left_semi").select(*columns).distinct()
        turned = now.groupBy("component").cogroup(near_slots.groupBy("component")).applyInPandas(_numbered, f"component {slots.schema['component'].dataType.simpleString()}, {SLOT}")
        turned = materialize(turned)
        slots = slots.join(turned.select("component", "place"), ["component", "place"], "left_anti").select(*columns).unionByName(turned.select(*columns))
        ended = slots.join(last.where(F.col("last") <= turn), "component", "left_semi")
        if turn + 1 == rounds:
            ended = slots
        ended = materialize(ended.select("ordinal", "place"))
        done = ended if done is None else done.unionByName(ended)
        if turn + 1 < rounds:
            slots = materialize(slots.join(last.where(F.col("last") > turn), "component", "left_semi"))
    return done


def _numbered(rows: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return pd.DataFrame(columns=["component", "place", "ordinal", "variant", "id", "specificity"])
    out = _seated(rows.sort_values("ordinal"), slots[["place", "ordinal", "variant", "id", "specificity"]])
    out.insert(0, "component", rows["component"].iloc[0])
    return out


def dedupe_claims(claims: DataFrame, scope: tuple[str, ...] = ("transcript_id",)) -> DataFrame:
    """Claims without near-identical repeats inside `scope`, with `place`, the ordinal of the slot each survivor holds.

    `claims`: unique `ordinal` (seen order), id, person_slug, type, target_date,
    claim, specificity. Only claims of one block (person, type, deadline, numbers,
    negations) can be duplicates, or claims with one id. Exact copies of a word set
    form one variant and are settled by aggregation; only components that join
    several variants go through the ordered pass, with repeats collapsed first.
    """
    w = claims.withColumn("_words", K.match_words(F.col("claim")))
    base = materialize(
        w.select(
            *scope, "ordinal", "id", "specificity", F.array_sort(F.array_distinct("_words")).alias("words"),
            F.sha2(
                F.concat_ws(
                    "\x01", *[F.col(c).cast("string") for c in scope], "person_slug", "type", F.coalesce(iso(F.col("target_date")), F.lit("")),
                    F.array_join(K.number_signature(F.col("_words")), ","), K.negation_count(F.col("_words")).cast("string"),
                ),
                256,
            ).alias("block_key"),
        ).withColumn("variant", F.sha2(F.concat_ws("\x01", "block_key", F.array_join("words", " ")), 256))
    )
    near = materialize(similar_variants(base))
    # One id in several blocks ties their variants together, each to the smallest.
    per_id = base.select(*scope, "id", "variant").distinct()
    smallest = per_id.groupBy(*scope, "id").agg(F.min("variant").alias("a"), F.max("variant").alias("z")).where("a <> z").drop("z")
    by_id = per_id.join(smallest, [*scope, "id"]).where("variant <> a").select("a", F.col("variant").alias("b"))
    nodes = components(near.unionByName(by_id))
    joined = base.join(nodes, base["variant"] == nodes["node"], "left")
    alone = (
        joined.where(F.col("component").isNull())
        .groupBy("variant")
        .agg(F.min(F.struct((-F.col("specificity")).alias("s"), "ordinal"))["ordinal"].alias("ordinal"), F.min("ordinal").alias("place"))
        .select("ordinal", "place")
    )
    linked = joined.where(F.col("component").isNotNull()).select("component", "variant", "id", "specificity", "ordinal")
    kind = claims.schema["ordinal"].dataType.simpleString()
    settled = settle_components(_collapse_runs(linked), near).select(F.col("ordinal").cast(kind).alias("ordinal"), F.col("place").cast(kind).alias("place"))
    return claims.join(alone.unionByName(settled), "ordinal")


