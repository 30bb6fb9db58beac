"""Live versions of the ledger jobs on Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from saidso.functions.binding import let
from saidso.operators.votes import UNITS, normalize_confidence, round2
from saidso.sources.ledger_store import BUCKETS, upsert_store


def live_upsert(stream: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge every micro-batch of claims into the ledger under `root`; each rewrites the buckets of its own claims only.

    The stream's `ordinal` says which of two claims came first. With it, a batch replayed after a failure merges to the
    same ledger, since the upsert is idempotent and its order does not depend on how the batch was read. Other writers may
    work on the same ledger meanwhile.
    """
    if "ordinal" not in stream.columns:
        raise ValueError("the stream needs a column `ordinal` that orders its claims")

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_store(batch, root, buckets=buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_dedupe(stream: DataFrame, time: str = "extracted_at", delay: str = "2 days", key: str = "id") -> DataFrame:
    """Each id once; state is kept only as long as the watermark allows repeats."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def new_per_day(stream: DataFrame, time: str, *keys: str, delay: str = "2 days") -> DataFrame:
    """New statements per day and source."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("day"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("day.start").cast("date").alias("day"), *keys, "n")
    )


def new_per_month(stream: DataFrame, time: str, *keys: str, delay: str = "2 days") -> DataFrame:
    """New statements over the last 30 days and source, one window per day."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, "30 days", "1 day").alias("days"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("days.start").cast("date").alias("first_day"), F.col("days.end").cast("date").alias("end_day"), *keys, "n")
    )


VOTE_OUT = "claim_id string, verdict string, confidence double, disputed boolean, need_judge string"


class VotePanel(StatefulProcessor):
    """Per claim: a verdict at two equal votes; a third judge is asked for when two differ; a timeout is a dispute.

    Once decided, a claim keeps one flag, so that late votes change nothing; its votes are dropped.
    """

    def __init__(self, wait_ms: int | None) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.votes = handle.getListState("votes", "judge string, verdict string, confidence double")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        seen = {v[0]: v for v in self.votes.get()} if self.votes.exists() else {}
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                seen.setdefault(r.judge, (r.judge, r.verdict, float(r.confidence)))
        panel = [seen[j] for j in sorted(seen)]
        self.votes.put(panel)
        out = self._decide(key[0], panel)
        if out is None:
            if self.wait_ms is not None and not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            return
        if out[4] is None:
            self.done.update((True,))
            self.votes.clear()
            if self.wait_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
        yield pd.DataFrame([out], columns=["claim_id", "verdict", "confidence", "disputed", "need_judge"])

    def _decide(self, claim, panel):
        verdicts = [v[1] for v in panel]
        for verdict in verdicts:
            same = [v[2] for v in panel if v[1] == verdict]
            if len(same) >= 2:
                units = sum(int(min(1.0, max(0.0, c / 100 if 1 < c <= 100 else c)) * 1_000_000 + 0.5) for c in same)
                return (claim, verdict, int(units / (len(same) * 1_000_000.0) * 100 + 0.5) / 100, False, None)
        if len(panel) >= 3:
            return (claim, "unresolvable", 0.5, True, None)
        return (claim, None, None, None, "C") if len(panel) == 2 else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.done.exists():
            self.done.update((True,))
            self.votes.clear()
            yield pd.DataFrame([(key[0], "unresolvable", 0.5, True, None)], columns=["claim_id", "verdict", "confidence", "disputed", "need_judge"])

    def close(self) -> None:
        pass


def _outcome(panel: Column) -> Column:
    """(verdict, confidence, disputed, need_judge) of the votes of a panel in judge order, or NULL; as `VotePanel` decides."""
    none = F.lit(None).cast("string")
    same = lambda v: F.filter(panel, lambda x: x["verdict"].eqNullSafe(v["verdict"]))
    twins = F.get(F.filter(F.transform(panel, same), lambda s: F.size(s) >= 2), 0)
    total = F.aggregate(F.transform(twins, lambda v: v["units"]), F.lit(0).cast("long"), lambda acc, u: acc + u)
    agreed = F.struct(
        F.get(twins, 0)["verdict"].alias("verdict"), round2(total / (F.size(twins) * float(UNITS))).alias("confidence"), F.lit(False).alias("disputed"), none.alias("need_judge")
    )
    split = F.struct(F.lit("unresolvable").alias("verdict"), F.lit(0.5).alias("confidence"), F.lit(True).alias("disputed"), none.alias("need_judge"))
    wanting = F.struct(none.alias("verdict"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("disputed"), F.lit("C").alias("need_judge"))
    return F.when(twins.isNotNull(), agreed).when(F.size(panel) >= 3, split).when(F.size(panel) == 2, wanting)


def _settled_votes(votes: DataFrame) -> DataFrame:
    """Votes without a timeout, as one aggregate per claim: the votes heard, each with its batch. A judge's first vote counts,
    a batch is judged as a whole, and a claim decided by an earlier batch is not emitted again."""
    vote = F.struct(F.current_timestamp().alias("at"), "judge", "verdict", F.floor(normalize_confidence(F.col("confidence")) * UNITS + 0.5).cast("long").alias("units"))
    heard = votes.select("claim_id", vote.alias("v")).groupBy("claim_id").agg(F.collect_list("v").alias("heard")).withColumn("last", F.array_max(F.transform("heard", lambda v: v["at"])))

    def panel(until: Column) -> Column:
        # Earlier batches first, whatever order the votes were merged in.
        known = F.array_sort(F.filter("heard", lambda v: v["at"] <= until))
        firsts = F.filter(known, lambda v, i: F.array_position(F.transform(known, lambda k: F.coalesce(k["judge"], F.lit(""))), F.coalesce(v["judge"], F.lit(""))) == i + 1)
        return F.array_sort(F.transform(firsts, lambda v: F.struct(v["judge"].alias("judge"), v["verdict"].alias("verdict"), v["units"].alias("units"))))

    earlier = F.array_distinct(F.filter(F.transform("heard", lambda v: v["at"]), lambda at: at < F.col("last")))
    decided = F.exists(earlier, lambda at: let(panel(at), lambda p: F.coalesce(_outcome(p)["need_judge"].isNull() & _outcome(p).isNotNull(), F.lit(False))))
    out = heard.where(~decided).select("claim_id", let(panel(F.col("last")), _outcome).alias("o")).where("o IS NOT NULL")
    return out.select("claim_id", "o.*")


def live_votes(stream: DataFrame, wait: dt.timedelta | None = dt.timedelta(hours=1)) -> DataFrame:
    """`stream`: claim_id, judge, verdict, confidence. Without `wait` no vote ever times out, and no timer or Python state is needed."""
    votes = stream.select(F.col("claim_id").cast("string").alias("claim_id"), "judge", "verdict", "confidence")
    if wait is None:
        return _settled_votes(votes)
    return votes.groupBy("claim_id").transformWithStateInPandas(
        statefulProcessor=VotePanel(int(wait.total_seconds() * 1000)), outputStructType=VOTE_OUT, outputMode="Update", timeMode="ProcessingTime"
    )


DRIFT_OUT = "person_slug string, topic string, said_date date, target_date date, label string, previous_claim_id string, shift_days int"
EPOCH = dt.date(1970, 1, 1)


#: Chains share this many states at most, so that a batch costs a call for each of them and not for each chain.
DRIFT_BUCKETS = 1 << 14
DRIFT_STATE = "entries binary"
_DRIFT_ENTRIES = pa.schema([*((c, pa.string()) for c in ("person_slug", "topic")), *((c, pa.int32()) for c in ("said", "target")), *((c, pa.string()) for c in ("first_id", "last_id", "open_id", "label", "previous"))])


def _read_entries(packed: bytes) -> dict:
    chains = defaultdict(dict)
    with pa.ipc.open_stream(packed) as stream:
        for person, topic, said, target, *entry in zip(*(c.to_pylist() for c in stream.read_all().columns)):
            chains[person, topic][said, target] = tuple(entry)
    return chains


def _packed_entries(chains: dict) -> bytes:
    rows = [(*chain, *k, *g) for chain, groups in chains.items() for k, g in groups.items()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DRIFT_ENTRIES)], schema=_DRIFT_ENTRIES)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DRIFT_ENTRIES) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def drift_of_bucket(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The (person, topic) chains of a bucket: drift labels as claims arrive. A late older claim re-labels its successors, so
    updates are emitted.

    A label belongs to (day said, deadline), like in the batch job, so state and output hold one entry per such pair: the
    calendar bounds them, not the number of claims in a chain. Chains share buckets, as a call for every chain costs more than
    its labels; only chains that changed are labelled again.
    """
    chains = _read_entries(state.get[0]) if state.exists else defaultdict(dict)
    changed = {}
    for pdf in rows:
        for person, topic, id, verdict, said, target in zip(*(pdf[c].tolist() for c in ("person_slug", "topic", "id", "verdict", "said", "target"))):
            groups = chains[person, topic]
            k = (int(said), None if target is None or target != target else int(target))
            old = groups.get(k, (id, id, None, None, None))
            opens = [x for x in (old[2], id if verdict != "correct" else None) if x]
            new = (min(old[0], id), max(old[1], id), min(opens) if opens else None, old[3], old[4])
            if new != groups.get(k):
                groups[k] = new
                changed[person, topic] = groups
    if not changed:
        return
    out = []
    for chain, groups in changed.items():
        labels = _drift_labels(groups)
        for k, g in list(groups.items()):
            label, previous, shift = labels[k]
            if (label, previous) != (g[3], g[4]):
                groups[k] = (*g[:3], label, previous)
                target = None if k[1] is None else EPOCH + dt.timedelta(days=k[1])
                out.append((*chain, EPOCH + dt.timedelta(days=k[0]), target, label, previous, shift))
    state.update((_packed_entries(chains),))
    if out:
        yield pd.DataFrame(out, columns=["person_slug", "topic", "said_date", "target_date", "label", "previous_claim_id", "shift_days"], dtype=object)


def _drift_labels(groups):
    """Label, claim compared with and days moved of every (day said, deadline), in one sweep over the days."""
    days = defaultdict(list)
    for (said, target), g in groups.items():
        days[said].append((target, g))
    out, last_id, last_dated = {}, None, []
    for said in sorted(days):
        for target, _ in days[said]:
            if last_id is None:
                out[said, target] = ("first", None, None)
            elif target is None or not last_dated:
                out[said, target] = ("reaffirmed", last_id, None)
            elif still_open := [(abs(target - t), g[2], t) for t, g in last_dated if g[2]]:
                _, previous, was = min(still_open)
                shift = target - was
                out[said, target] = ("pushed_later" if shift >= 60 else "pulled_earlier" if shift <= -60 else "reaffirmed", previous, shift)
            else:
                out[said, target] = ("reaffirmed", min((abs(target - t), g[0]) for t, g in last_dated)[1], None)
        last_id = max(g[1] for _, g in days[said])
        last_dated = [(t, g) for t, g in days[said] if t is not None] or last_dated
    return out


def live_drift(stream: DataFrame, buckets: int = DRIFT_BUCKETS) -> DataFrame:
    """`stream`: id, person_slug, topic, said_date, target_date, verdict. Emits a row per (day said, deadline) whose label changed.
    A checkpoint is continued with the number of `buckets` it began with."""
    days = stream.select("person_slug", "topic", "id", "verdict", F.unix_date("said_date").alias("said"), F.unix_date("target_date").cast("double").alias("target"))
    bucket = F.pmod(F.xxhash64("person_slug", "topic"), F.lit(buckets))
    return days.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(drift_of_bucket, DRIFT_OUT, DRIFT_STATE, "update", GroupStateTimeout.NoTimeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A sibling session whose state lives in RocksDB, which keyed state with timers and maps needs."""
    s = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        s.conf.set(name, spark.conf.get(name))
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return s


def run_available(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Process what is there now; every emitted row lands in a table under `folder`, with the batch that emitted it.

    A batch has a folder of its own, so one that is replayed replaces what it wrote.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    fields = [T.StructField(f.name, f.dataType) for f in stream.schema.fields] + [T.StructField("batch_id", T.LongType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{folder}/out")


DEADLINE_OUT = "id string, kind string, target_date date"


class DeadlineTimer(StatefulProcessor):
    """Per open claim: 'coming_due' 31 days before its deadline and 'came_due' once it has passed, in event time."""

    DAY_MS = 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "target long, stage int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        target = None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                target = None if (pd.isna(r.target) or not r.open) else int(r.target)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if target is None:
            self.due.clear()
            return
        self.due.update((target, 0))
        self.handle.registerTimer((target - 31) * self.DAY_MS)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.due.exists():
            return
        target, stage = self.due.get()
        day = EPOCH + dt.timedelta(days=int(target))
        if stage == 0:
            self.due.update((target, 1))
            self.handle.registerTimer((target + 1) * self.DAY_MS)
        else:
            self.due.clear()
        yield pd.DataFrame([(key[0], "coming_due" if stage == 0 else "came_due", day)], columns=["id", "kind", "target_date"])

    def close(self) -> None:
        pass


def live_deadlines(stream: DataFrame, time: str = "seen_at", delay: str = "1 day") -> DataFrame:
    """`stream`: id, target_date, verdict, type and the event time that moves the clock."""
    open_one = (F.col("type") == "prediction") & F.col("verdict").isin("pending", "too_early")
    s = stream.withWatermark(time, delay).select("id", time, F.unix_date("target_date").cast("double").alias("target"), F.coalesce(open_one, F.lit(False)).alias("open"))
    return s.groupBy("id").transformWithStateInPandas(
        statefulProcessor=DeadlineTimer(), outputStructType=DEADLINE_OUT, outputMode="Update", timeMode="EventTime"
    )


RECHECK_OUT = "slug string, due_at timestamp"


class RecheckTimer(StatefulProcessor):
    """Per followed person: due when `every` has passed since the last check, and again after each further `every` without one."""

    def __init__(self, every_ms: int) -> None:
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "checked_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        checked = self.last.get()[0] if self.last.exists() else 0
        for pdf in rows:
            stamps = pd.to_datetime(pdf["checked_at"]).dropna()
            if len(stamps):
                checked = max(checked, int(stamps.max().timestamp() * 1000))
        self.last.update((checked,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        now, due = timerValues.getCurrentProcessingTimeInMs(), checked + self.every_ms
        if due <= now:
            yield self._row(key, due)
        # The next cycle that has not begun.
        self.handle.registerTimer(due if due > now else due + (now - due) // self.every_ms * self.every_ms + self.every_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.handle.registerTimer(due + self.every_ms)
        yield self._row(key, due)

    @staticmethod
    def _row(key, due_ms: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], pd.Timestamp(due_ms, unit="ms"))], columns=["slug", "due_at"])

    def close(self) -> None:
        pass


def live_rechecks(stream: DataFrame, every: dt.timedelta) -> DataFrame:
    """`stream`: slug, checked_at (NULL for a follow without a check)."""
    return stream.groupBy("slug").transformWithStateInPandas(
        statefulProcessor=RecheckTimer(int(every.total_seconds() * 1000)), outputStructType=RECHECK_OUT, outputMode="Update", timeMode="ProcessingTime"
    )


def files_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)
