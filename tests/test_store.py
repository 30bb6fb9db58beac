"""The bucketed ledger: batches rewrite their own buckets, writers lose nothing, old versions go."""

import threading

import pytest
from pyspark.sql import functions as F

from saidso.operators.ledger import upsert
from saidso.schemas import CLAIMS
from saidso.sources import ledger_store as LS
from saidso.streaming import jobs as ST
from test_ledger import claim


def batch(spark, ids, **over):
    rows = [(*claim(f"c{i}", **over), n) for n, i in enumerate(ids)]
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CLAIMS.fields)
    return spark.createDataFrame(rows, f"{names}, ordinal int")


def state(df):
    return sorted((r.id, r.verdict, r.claim) for r in df.collect())


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    root = f"{tmp_path}/ledger"
    assert LS.read_store(spark, root).count() == 0 and LS.upsert_store(batch(spark, []), root).number == 0
    first = LS.upsert_store(batch(spark, range(200)), root, buckets=16)
    assert first.number == 1 and len(first.folders) == 16
    second = LS.upsert_store(batch(spark, [3, 1000], verdict="correct", resolved="2021-01-01"), root)
    assert second.number == 2 and second.buckets == 16 and 1 <= len(second.touched) <= 2
    assert {b for b in first.folders if first.folders[b] != second.folders[b]} == set(second.touched)
    want = upsert(upsert(spark.createDataFrame([], CLAIMS), batch(spark, range(200))).drop("change"), batch(spark, [3, 1000], verdict="correct", resolved="2021-01-01"))
    assert state(LS.read_store(spark, root)) == state(want)
    assert state(LS.read_store(spark, root, 1)) == state(batch(spark, range(200)))
    LS.upsert_store(batch(spark, [5]), root)
    gone = LS.sweep_store(spark, root, keep=1, older_than=-1)
    assert "manifests/000000000001.json" in gone and any(g.startswith("data/") for g in gone)
    assert state(LS.read_store(spark, root)) == state(want)
    whole = LS.replace_store(batch(spark, range(7)), root)
    assert whole.number == 4 and state(LS.read_store(spark, root)) == state(batch(spark, range(7)))


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/ledger"
    LS.upsert_store(batch(spark, range(40)), root, buckets=4)
    both, real, first = threading.Barrier(2), LS.current, set()

    def together(session, at):
        seen = real(session, at)
        if threading.get_ident() not in first:  # both start from one manifest
            first.add(threading.get_ident())
            both.wait(60)
        return seen

    monkeypatch.setattr(LS, "current", together)
    threads = [threading.Thread(target=LS.upsert_store, args=(batch(spark, ids), root)) for ids in (range(30, 60), range(50, 90))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert state(real and LS.read_store(spark, root, real(spark, root).number)) == state(batch(spark, range(90)))


def test_the_stream_merges_overlapping_batches(spark, tmp_path):
    for n, (ids, over) in enumerate([(range(0, 30), {}), (range(20, 50), dict(verdict="correct", resolved="2021-01-01")), (range(10, 25), {})]):
        batch(spark, ids, **over).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(batch(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ST.live_upsert(stream, f"{tmp_path}/ledger", f"{tmp_path}/state", 8).awaitTermination()
    assert LS.current(spark, f"{tmp_path}/ledger").number == 3
    got = LS.read_store(spark, f"{tmp_path}/ledger")
    assert got.count() == 50 and got.where(F.col("verdict") == "correct").count() == 30


def test_a_taken_name_is_refused(spark, tmp_path):
    files = LS._Files(spark, f"{tmp_path}/x")
    assert files.put("manifests/1.json", "a") and not files.put("manifests/1.json", "b")
    with pytest.raises(RuntimeError):
        LS.ATTEMPTS, kept = 0, LS.ATTEMPTS
        try:
            LS.upsert_store(batch(spark, [1]), f"{tmp_path}/x")
        finally:
            LS.ATTEMPTS = kept
