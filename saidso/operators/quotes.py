"""Quote verification: was this said, where, and by whom.

An approximate-substring join between candidate quotes and transcripts. A match
within d edits contains one of d+1 pieces of the quote intact, so a few words of
every piece are looked up in an index of runs of words; only the token blocks
they hit are aligned. Blocks have a fixed size, so neither a long transcript nor
a quote that occurs everywhere ever lands in one task, and a match is found the
same way wherever its transcript is cut:

- a unit of work is (candidate, block); it aligns the block with n+d tokens on
  either side and reports matches that end past the block's start. A match of at
  most d edits is at most n+d tokens long, so every match containing a hit in the
  block is inside the window, and its cost and start equal those of an alignment
  over the whole transcript;
- every match is checked on its own (speaker, numbers, negation, time, names), and
  the best acceptable one is a minimum, merged with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from saidso.functions import tokens as K
from saidso.functions.binding import let
from saidso.functions.urls import deep_link
from saidso.functions.wording import WS
from saidso.operators.layout import in_order, layout, spread
from saidso.session import materialize

MIN_QUOTE_SCORE = 0.85
BLOCK_TOKENS = 512
#: Words of a run that is looked up; shorter where the pieces of a quote are.
RUN = 5
HALO = RUN - 1
TOKEN_FIELDS = ("norms", "segs", "words", "names", "voices")

SPANS = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType()) for n in ("s", "e", "dist", "kind")])
)


# ---- Alignment ---------------------------------------------------------------


def _align(quotes: list[np.ndarray], windows: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per pair: cost and start of the best match ending at every window position.

    Word-level approximate substring search, one window column at a time for many
    pairs together. Ties prefer a substitution, then a skipped window word, then a
    skipped quote word.
    """
    order = sorted(range(len(quotes)), key=lambda u: (len(quotes[u]), len(windows[u])))
    at = 0
    while at < len(order):
        group = order[at : at + max(1, 60_000 // (len(quotes[order[min(at + 500, len(order) - 1)]]) + 1))]
        at += len(group)
        n = np.array([len(quotes[u]) for u in group])
        size = n.max()
        width = max(len(windows[u]) for u in group)
        q = np.zeros((len(group), size), dtype=np.int64)
        w = np.zeros((len(group), width), dtype=np.int64)
        for r, u in enumerate(group):
            q[r, : len(quotes[u])] = quotes[u]
            w[r, : len(windows[u])] = windows[u]
        steps = np.arange(size + 1, dtype=np.int32)
        rows = np.arange(len(group))
        prev = np.tile(steps, (len(group), 1))
        starts = np.zeros_like(prev)
        cost = np.empty((len(group), width), dtype=np.int32)
        start = np.empty((len(group), width), dtype=np.int32)
        t, ts = np.empty_like(prev), np.empty_like(prev)
        for j in range(width):
            starts[:, 0] = j
            swap = prev[:, :-1] + (q != w[:, j : j + 1])
            skip = prev[:, 1:] + 1
            fewer = skip < swap
            t[:, 0], ts[:, 0] = 0, j + 1
            t[:, 1:] = np.where(fewer, skip, swap)
            ts[:, 1:] = np.where(fewer, starts[:, 1:], starts[:, :-1])
            t -= steps
            low = np.minimum.accumulate(t, axis=1)
            source = np.maximum.accumulate(np.where(t == low, steps, 0), axis=1)
            prev = low + steps
            starts = np.take_along_axis(ts, source, axis=1)
            cost[:, j] = prev[rows, n]
            start[:, j] = starts[rows, n]
        for r, u in enumerate(group):
            yield u, cost[r, : len(windows[u])], start[r, : len(windows[u])]


def _distance(a: np.ndarray, b: np.ndarray) -> int:
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pandas_udf(SPANS)
def _spans(quote: pd.Series, window: pd.Series, region: pd.Series, budget: pd.Series, after: pd.Series) -> pd.Series:
    """Matches [s, e) within `budget` edits ending past `after`, and their single-line pieces (kind 1)."""
    quotes, windows = list(quote), list(window)
    out: list[list[dict]] = [[] for _ in quotes]
    for u, cost, start in _align(quotes, windows):
        ends = np.nonzero((cost <= budget[u]) & (start <= np.arange(len(cost))))[0]
        lines = region[u]
        for e in ends[ends + 1 > after[u]]:
            s, e = int(start[e]), int(e) + 1
            out[u].append({"s": s, "e": e, "dist": int(cost[e - 1]), "kind": 0})
            if lines[s] == lines[e - 1]:
                continue
            a = s
            while a < e:
                b = a + 1
                while b < e and lines[b] == lines[a]:
                    b += 1
                d = _distance(quotes[u], windows[u][a:b])
                if d <= budget[u]:
                    out[u].append({"s": a, "e": b, "dist": d, "kind": 1})
                a = b
    return pd.Series(out)


@pandas_udf(T.IntegerType())
def _closest(quote: pd.Series, window: pd.Series) -> pd.Series:
    """Fewest edits between the quote and any part of the window."""
    best = [len(q) for q in quote]
    for u, cost, _ in _align(list(quote), list(window)):
        if len(cost):
            best[u] = min(best[u], int(cost.min()))
    return pd.Series(best)


# Costly and called once per row: never to be copied into another operator by the optimizer.
_spans, _closest = _spans.asNondeterministic(), _closest.asNondeterministic()


# ---- Tables --------------------------------------------------------------------


def token_table(segments: DataFrame) -> DataFrame:
    """Segments with `tokens` (fillers dropped), `names` and `pos`, the position of the first token in its transcript.

    Words are cut once and written; the ordered passes read those files, column by column.
    """
    rows = spread(segments.select("transcript_id", "seg_no", "start", "speaker", "text"), ["transcript_id"], "seg_no")
    raw = rows.withColumn("_raw", K.raw_words(F.col("text"))).withColumn("_tok", K.numbered_norms(F.col("_raw")))
    # A capitalized first word is a name only if the line before it did not end a sentence: flagged here, decided below.
    lead = F.regexp_replace(F.get(F.split("text", K.WORD, 2), F.lit(0)), K.LOOK_BACK, "")
    cut = materialize(
        raw.withColumn("names", K.entity_flags(F.col("text"), F.col("_raw"), F.lit("x"))).withColumn("opens", lead == "").drop("_raw")
    )
    placed = layout(
        cut,
        previous={"_before": F.try_element_at("_tok", F.lit(-1))["norm"]},
        following={"_after": F.try_element_at("_tok", F.lit(1))["norm"]},
        more=True,
        drop=("text",),
    )
    ends = F.col("opening").isin("", ".", "!", "?", ":")
    kept = placed.withColumn("tokens", K.keep_tokens(F.col("_tok"), F.col("_before"), F.col("_after"))).withColumn(
        "names", F.transform("names", lambda f, i: f & ~((i == 0) & F.col("opens") & ends))
    )
    lean = materialize(kept.select("transcript_id", "seg_no", "_block", "speaker", "tokens", "names"))
    return in_order(lean, ["transcript_id"], "seg_no", running={"pos": F.size("tokens")})


def token_blocks(tokens: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """Fixed-size runs of a transcript's token stream, as parallel arrays.

    (transcript_id, block, start, norms, segs, words, names, voices, halo): per token
    its form, segment, raw word position, name flag and speaker; `halo` is the
    words after the block that a run starting in it may have, so every run can be read from it.
    """
    n, pos = F.size("tokens"), F.col("pos")
    cut = tokens.where(n > 0).withColumn(
        "block", F.explode(F.sequence(F.floor(F.greatest(pos - HALO, F.lit(0)) / block), F.floor((pos + n - 1) / block)))
    )
    lo, hi = F.col("block") * block, (F.col("block") + 1) * block

    def own(start: Column, end: Column) -> Column:
        return F.slice("tokens", (start - pos + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))

    core_from, core_to = F.greatest(pos, lo), F.least(pos + n, hi)
    halo_from, halo_to = F.greatest(pos, hi), F.least(pos + n, hi + HALO)
    voice = F.nullif(F.trim(F.coalesce("speaker", F.lit(""))), F.lit(""))
    piece = F.struct(
        core_from.alias("start"),
        F.transform("own", lambda t: t["norm"]).alias("norms"),
        F.transform("own", lambda t: F.col("seg_no")).alias("segs"),
        F.transform("own", lambda t: t["word"]).alias("words"),
        F.transform("own", lambda t: F.get("names", t["word"])).alias("names"),
        F.transform("own", lambda t: F.col("voice")).alias("voices"),
    )
    halo = F.struct(halo_from.alias("start"), F.transform(own(halo_from, halo_to), lambda t: t["norm"]).alias("norms"))
    pieces = (
        cut.withColumn("own", own(core_from, core_to))
        .withColumn("voice", voice)
        .select("transcript_id", "block", F.when(core_to > core_from, piece).alias("core"), F.when(halo_to > halo_from, halo).alias("halo"))
    )
    merged = pieces.groupBy("transcript_id", "block").agg(
        F.sort_array(F.collect_list("core")).alias("parts"), F.sort_array(F.collect_list("halo")).alias("halo")
    )
    flat = [F.flatten(F.transform("parts", lambda p: p[f])).alias(f) for f in TOKEN_FIELDS]
    return merged.where(F.size("parts") > 0).select(
        "transcript_id", "block", F.get("parts", F.lit(0))["start"].alias("start"), *flat,
        F.flatten(F.transform("halo", lambda h: h["norms"])).alias("halo"),
    )


def _runs(norms: Column, k: int, upto: Column) -> Column:
    """Hashes of all k-word runs starting at the first `upto` positions."""

    def hashes(a: Column) -> Column:
        starts = F.slice(a, F.lit(1), F.greatest(F.least(upto, F.size(a) - (k - 1)), F.lit(0)))
        return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(a, i + j) for j in range(1, k)]))

    return let(norms, hashes)


def block_index(blocks: DataFrame, k: int = RUN) -> DataFrame:
    """(transcript_id, block, run): the distinct k-word runs starting in each block."""
    runs = _runs(F.concat("norms", "halo"), k, F.size("norms"))
    return blocks.select("transcript_id", "block", F.explode(F.array_distinct(runs)).alias("run"))


def prepare_quotes(candidates: DataFrame, min_score: float = MIN_QUOTE_SCORE) -> DataFrame:
    """Candidates with their tokens, edit budget and names."""
    wanted = ["candidate_id", "quote", "speaker", "host"] + (["transcript_id"] if "transcript_id" in candidates.columns else [])
    q = candidates.select(*wanted)
    form = r"^\s*([^:\n]{1,60}):\s+(?=\S)"
    label = F.regexp_extract("quote", form, 1)
    copied = (label != "") & K.same_speaker(K.match_words(label), K.match_words(F.col("speaker")))
    # The quote without a leading 'Name: ' that names the speaker.
    q = q.withColumn("said", F.when(copied, F.regexp_replace("quote", form, "")).otherwise(F.col("quote")))
    q = q.withColumn("q", K.match_words(F.col("said"))).withColumn("n", F.size("q"))
    return (
        q.withColumn("budget", F.floor(F.col("n") * (1 - min_score) + 1e-9).cast("int"))
        .withColumn("codes", F.transform("q", lambda w: F.xxhash64(w)))
        .withColumn("q_names", K.entity_words(F.col("said")))
        .withColumn("speaker_words", K.match_words(F.col("speaker")))
        .withColumn("host_words", K.match_words(F.col("host")))
    )


def _pieces(places: Iterable[int], *mark: Column) -> Column:
    """The words at `places` of each of budget+1 equal pieces of the quote, hashed after `mark`."""
    return F.transform(
        F.sequence(F.lit(0), F.col("budget")),
        lambda i: let(
            F.floor(i * F.col("n") / (F.col("budget") + 1)).cast("int"), lambda s: F.xxhash64(*mark, *[F.get("q", s + j) for j in places])
        ),
    )


def _run_length() -> Column:
    """Words a run may have so that it stays inside its piece: RUN, or as many as the shortest piece has."""
    return F.least(F.lit(RUN), F.floor(F.col("n") / (F.col("budget") + 1)))


def _traces(k: int) -> list[tuple[str, range]]:
    """What a run of k words that goes over several lines leaves in one of them: a mark, and the places of those words in the run.

    Over two lines, one of them ends (<) or starts (>) with half the run or more; over more, a line in between is all of it (=).
    """
    half = (k + 1) // 2
    ends = [("<", range(half)), (">", range(k - half, k))]
    return [] if k == 1 else ends + [("=", range(j, j + m)) for m in range(1, k - 1) for j in range(1, k - m)]


def _line_ends(words: Column, k: int) -> Column:
    """Hashes of what runs of k words may have left at the ends of a line."""
    half = (k + 1) // 2

    def marked(mark: str, w: Column, places: range) -> Column:
        return F.xxhash64(F.lit(mark), *[F.get(w, F.lit(i)) for i in places])

    def ends(w: Column) -> Column:
        n = F.size(w)
        last = F.xxhash64(F.lit("<"), *[F.get(w, n - i) for i in range(half, 0, -1)])
        both = F.when(n >= half, F.array(last, marked(">", w, range(half)))).otherwise(F.array().cast("array<bigint>"))
        whole = [F.when(n == m, marked("=", w, range(m))) for m in range(1, k - 1)]
        return F.concat(both, F.array_compact(F.array(F.coalesce(*whole)))) if whole else both

    def shapes(w: Column) -> Column:
        # The neighbouring lines decide whether a 'know' in front or a 'you' at the end belongs to a dropped 'you know'.
        cut = [F.slice(w, F.lit(1 + a), F.greatest(F.size(w) - (a + b), F.lit(0))) for a, b in ((0, 0), (1, 0), (0, 1), (1, 1))]
        open_ended = (F.get(w, F.lit(0)) == "know") | (F.get(w, F.size(w) - 1) == "you")
        return F.when(open_ended, F.array(*cut)).otherwise(F.array(w))

    return F.flatten(F.transform(shapes(words), ends))


def reached(quotes: DataFrame, segments: DataFrame) -> DataFrame:
    """transcript_id of every transcript that may hold some piece of a quote word for word; no other can match.

    Read off single lines, so that nothing is laid out, placed or shuffled for transcripts that no quote comes from:
    a run lies inside a line, or leaves a trace at the end of one.
    """
    lengths = sorted(r[0] for r in quotes.select(_run_length().cast("int")).distinct().collect()) or [RUN]
    parts = [
        quotes.where(_run_length() == k).select(F.explode(F.flatten(F.array(_pieces(range(k)), *[_pieces(p, F.lit(m)) for m, p in _traces(k)]))).alias("run"))
        for k in lengths
    ]
    marks = materialize(reduce(DataFrame.unionByName, parts).distinct())
    lines = segments.select("transcript_id", K.match_words(F.col("text")).alias("w"))
    held = [x for k in lengths for x in (_runs(F.col("w"), k, F.size("w")), *([_line_ends(F.col("w"), k)] if k > 1 else []))]
    # The outer form keeps the optimizer from computing the list once more to see that it is not empty.
    hits = lines.select("transcript_id", F.explode_outer(F.concat(*held)).alias("run")).join(marks, "run", "left_semi")
    return materialize(hits.select("transcript_id").distinct())


def _units(quotes: DataFrame, blocks: DataFrame, scoped: bool) -> DataFrame:
    """(candidate_id, transcript_id, block): where some piece of the quote occurs word for word."""
    on = ["transcript_id", "run"] if scoped else ["run"]
    key = ["candidate_id", "transcript_id"] if scoped else ["candidate_id"]
    found = None
    for k in range(1, RUN + 1):
        part = quotes.where(_run_length() == k)
        if k < RUN and part.isEmpty():
            continue
        runs = part.select(*key, F.explode(_pieces(range(k))).alias("run")).distinct()
        hits = block_index(blocks, k).join(runs, on).select("candidate_id", "transcript_id", "block")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def _windows(
    units: DataFrame, quotes: DataFrame, blocks: DataFrame, reach: Column, scoped: bool, block: int, fields: tuple[str, ...] = TOKEN_FIELDS
) -> DataFrame:
    """Units with the tokens of their block and `reach` tokens on either side."""
    keys = ["candidate_id", "transcript_id"] if scoped else ["candidate_id"]
    q = quotes.withColumn("reach", reach)
    u = units.join(q.select(*keys, "reach"), keys)
    around = F.ceil(F.col("reach") / block)
    wanted = u.withColumn("other", F.explode(F.sequence(F.greatest(F.col("block") - around, F.lit(0)), F.col("block") + around)))
    near = blocks.select("transcript_id", F.col("block").alias("other"), "start", *fields)
    got = (
        wanted.join(near, ["transcript_id", "other"])
        .groupBy("candidate_id", "transcript_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("other", "start", *fields))).alias("near"))
        .join(q, keys)
    )
    base = F.get("near", F.lit(0))["start"]
    lo = F.greatest(F.col("block") * block - F.col("reach") - base, F.lit(0)).cast("int")
    hi = ((F.col("block") + 1) * block + F.col("reach") - base).cast("int")
    return got.select(
        "candidate_id", "transcript_id", "block", *[c for c in q.columns if c not in ("candidate_id", "transcript_id")],
        (base + lo).alias("base"),
        (F.col("block") * block - base - lo).cast("int").alias("after"),
        *[F.slice(F.flatten(F.transform("near", lambda x: x[f])), lo + 1, hi - lo).alias(f) for f in fields],
    )


def verify_quotes(
    candidates: DataFrame, segments: DataFrame, min_score: float = MIN_QUOTE_SCORE, scoped: bool = True, block: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per candidate (scoped), or per candidate and transcript it matches (unscoped).

    `candidates`: candidate_id, quote, speaker, host and, when scoped, transcript_id.
    Adds verified, score, reason, matched_text, char_offset, end_offset,
    timestamp_sec, matched_speaker, first_seg, last_seg. `min_score` is above 0:
    at 0 nothing of a quote need occur, and no index could find it.
    """
    if not 0 < min_score <= 1:
        raise ValueError("min_score must be above 0 and at most 1")
    # Read several times below: written once, so the planner also knows which side is small.
    quotes = materialize(prepare_quotes(candidates, min_score))
    usable = quotes.where(F.col("n") > 0)
    if not scoped:
        segments = materialize(segments.join(reached(usable, segments), "transcript_id", "left_semi"))
    blocks = materialize(token_blocks(token_table(segments), block))
    units = _units(usable, blocks, scoped)
    win = _windows(units, usable, blocks, F.col("n") + F.col("budget"), scoped, block)
    # Aligned in as many tasks as there are, however few the bytes: the work is in the alignment.
    win = win.repartition(int(win.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spans = _spans(F.col("codes"), F.transform("norms", lambda w: F.xxhash64(w)), F.col("segs"), F.col("budget"), F.col("after"))
    key = ["candidate_id", "transcript_id"]
    at = win.withColumn("span", F.explode(spans))
    for f in TOKEN_FIELDS:
        at = at.withColumn(f, F.slice(f, F.col("span.s") + 1, F.col("span.e") - F.col("span.s")))
    at = at.withColumn("voices", F.array_distinct(F.array_compact("voices"))).withColumn("voice", F.get("voices", F.lit(0)))
    at = at.withColumn("voice_words", K.match_words(F.col("voice")))
    crossing = F.concat(F.lit("quote runs across lines by "), F.array_join("voices", " and "))
    label = K.label_problem(
        F.col("voice"), F.col("voice_words"), F.col("speaker"), F.col("speaker_words"), F.col("host"), F.col("host_words")
    )
    who = F.when(F.size("voices") > 1, crossing).when(F.col("voice").isNotNull(), label)
    names = F.array_distinct(F.filter("norms", lambda w, i: F.get("names", i)))
    near = F.when(
        F.col("span.dist") > 0,
        F.coalesce(K.time_change(F.col("q"), F.col("norms")), K.name_change(F.col("q_names"), F.col("q"), names, F.col("norms"))),
    )
    problem = F.coalesce(who, K.meaning_change(F.col("q"), F.col("norms")), near)
    gap = F.abs(F.col("span.e") - F.col("span.s") - F.col("n"))
    rank = F.struct(
        F.col("span.dist").alias("dist"), gap.alias("gap"), (F.col("base") + F.col("span.s")).alias("start"), F.col("span.kind").alias("kind"),
        (F.col("base") + F.col("span.e")).alias("end"),
    )
    # One entry per line of the match: first and last kept word.
    runs = F.transform(
        F.array_distinct("segs"),
        lambda s: F.struct(
            s.alias("seg_no"),
            F.element_at("words", F.array_position("segs", s).cast("int")).alias("a"),
            F.element_at("words", (F.array_position("segs", s) + F.size(F.filter("segs", lambda x: x == s)) - 1).cast("int")).alias("b"),
        ),
    )
    graded = at.select(*key, "n", rank.alias("rank"), problem.alias("problem"), "voice", runs.alias("runs"))
    ok = F.col("problem").isNull()
    best = materialize(graded).groupBy(*key).agg(
        F.min(F.when(ok, F.struct("rank", "voice", "runs"))).alias("good"),
        F.min(F.when(~ok, F.struct("rank", "problem"))).alias("bad"),
        F.first("n").alias("n"),
    )
    located = _locate(best.where(F.col("good").isNotNull()), segments)

    def score(dist: Column) -> Column:
        return F.floor(F.greatest(1 - dist / F.col("n"), F.lit(0.0)) * 1000 + 0.5) / 1000

    found = best.join(located, key, "left").select(
        *key,
        F.col("good").isNotNull().alias("verified"),
        score(F.coalesce("good.rank.dist", "bad.rank.dist")).alias("score"),
        F.when(F.col("good").isNull(), F.col("bad.problem")).alias("reason"),
        "matched_text", "char_offset", "end_offset", "timestamp_sec", F.col("good.voice").alias("matched_speaker"), "first_seg", "last_seg", "closing",
    )
    if not scoped:
        return candidates.join(found, "candidate_id")
    rest = usable.join(found.select("candidate_id"), "candidate_id", "left_anti")
    everywhere = rest.select("candidate_id", "transcript_id").join(blocks.select("transcript_id", "block"), "transcript_id")
    wide = _windows(everywhere, rest, blocks, F.col("n") * 2, True, block, ("norms",))
    nearest = (
        materialize(wide.select("candidate_id", _closest(F.col("codes"), F.transform("norms", lambda w: F.xxhash64(w))).alias("d")))
        .groupBy("candidate_id")
        .agg(F.min("d").alias("d"))
    )
    missed = (
        rest.join(nearest, "candidate_id", "left")
        .withColumn("score", score(F.coalesce("d", "n")))
        .select(
            "candidate_id",
            F.lit(False).alias("verified"),
            "score",
            F.concat(
                F.lit("not found in transcript (closest match scores "), _plain(F.col("score")), F.lit(", need "), _plain(F.lit(float(min_score))), F.lit(")")
            ).alias("reason"),
        )
    )
    empty = quotes.where(F.col("n") == 0).select(
        "candidate_id", F.lit(False).alias("verified"), F.lit(0.0).alias("score"), F.lit("empty quote").alias("reason")
    )
    results = found.drop("transcript_id").unionByName(missed.unionByName(empty), allowMissingColumns=True)
    return candidates.join(results, "candidate_id")


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")


def _locate(best: DataFrame, segments: DataFrame) -> DataFrame:
    """Verbatim words, character offsets and time of each accepted match, from the lines it runs over.

    Positions come from a layout that shuffles no text; text is fetched for matched lines only.
    """
    key = ["candidate_id", "transcript_id"]
    lines = best.select(*key, F.explode("good.runs").alias("r")).select(*key, "r.*")
    places = layout(segments, drop=("text", "speaker")).select("transcript_id", "seg_no", "text_start", "start_sec")
    j = lines.join(segments.select("transcript_id", "seg_no", "text"), ["transcript_id", "seg_no"]).join(places, ["transcript_id", "seg_no"])
    gaps, words = F.split(F.col("text"), K.WORD), K.raw_words(F.col("text"))

    def chars(a: Column, n: Column) -> Column:
        return F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))

    j = j.withColumn("_g", gaps).withColumn("_w", words)
    j = j.withColumn("_from", chars(F.col("_g"), F.col("a") + 1) + chars(F.col("_w"), F.col("a"))).withColumn(
        "_to", chars(F.col("_g"), F.col("b") + 1) + chars(F.col("_w"), F.col("b") + 1)
    )
    piece = F.substr(F.col("text"), F.col("_from") + 1, F.col("_to") - F.col("_from"))
    rest = F.substr(F.col("text"), F.col("_to") + 1)
    got = j.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("seg_no", piece.alias("t")))).alias("_p"),
        F.min(F.struct("seg_no", (F.col("text_start") + F.col("_from")).alias("at"), "start_sec")).alias("_first"),
        F.max(F.struct("seg_no", (F.col("text_start") + F.col("_to")).alias("at"), F.regexp_extract(rest, r"^[.!?…]+[\"”’)]?", 0).alias("closing"))).alias("_last"),
    )
    joined = F.trim(F.regexp_replace(F.array_join(F.transform("_p", lambda p: p["t"]), " "), f"{WS}+", " "))
    return got.select(
        *key,
        joined.alias("matched_text"),
        F.col("_first.at").cast("int").alias("char_offset"),
        F.col("_last.at").cast("int").alias("end_offset"),
        F.floor("_first.start_sec").cast("int").alias("timestamp_sec"),
        F.col("_first.seg_no").alias("first_seg"),
        F.col("_last.seg_no").alias("last_seg"),
        F.col("_last.closing").alias("closing"),
    )


def match_link(url: Column, sec: Column) -> Column:
    return deep_link(url, sec)
