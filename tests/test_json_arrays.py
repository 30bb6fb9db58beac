"""Objects of JSON arrays in files of any layout, split anywhere."""

import json
import random
from pathlib import Path

from saidso.plans.rule_queries import QUERIES
from saidso.session import run_folder
from saidso.sources import json_arrays as J
from saidso.sources import ledger_files as LF


def test_elements_of_awkward_files(spark, tmp_path):
    rng = random.Random(1)
    odd = ['}', '{', '"', "\\", "[", "],", "a}{\"b", "\n", "é\U0001f600", "\\\"}", ""]
    want = {}
    for i, (wrap, indent) in enumerate([(w, d) for w in (False, True) for d in (None, 2)]):
        items = [{"id": str(n), "text": "".join(rng.choice(odd) for _ in range(rng.randint(0, 6))), "in": {"a": [{"b": rng.choice(odd)}], "c": {}}} for n in range(300)]
        (tmp_path / f"{i}.json").write_text(json.dumps({"version": 1, "claims": items} if wrap else items, indent=indent, ensure_ascii=bool(i % 2)) + "\n" * i)
        want[f"{i}.json"] = items
    (tmp_path / "4.json").write_text("[]")
    (tmp_path / "5.json").write_text('{"version": 1, "claims": []}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found, files = J.elements(spark, str(tmp_path))
        got = {}
        for r in sorted(found.collect(), key=lambda r: r.n):
            got.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.json))
        assert got == want
        assert {r.file.rsplit("/", 1)[1]: r.listed for r in files.collect()} == {f"{i}.json": i in (0, 1, 4) for i in range(6)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_elements_across_many_chunks(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    items = [{"id": n, "text": "".join(rng.choice(['}', '{"', "\\", "],", "é", "x"]) for _ in range(rng.choice([0, 3, 400]))), "in": [{"a": {}}] * rng.randint(0, 3)} for n in range(500)]
    (tmp_path / "list.json").write_text("﻿ \n" + json.dumps(items, indent=1, ensure_ascii=False))
    (tmp_path / "cut.json").write_text(json.dumps({"version": 1, "claims": items[:9]})[:-4])
    for size in (1, 100, 5000):
        monkeypatch.setattr(J, "CHUNK", size)
        found, files = J.elements(spark, str(tmp_path))
        got = {}
        for r in sorted(found.collect(), key=lambda r: r.n):
            got.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.json))
        assert got == {"list.json": items, "cut.json": items[:8]}
        assert {r.file.rsplit("/", 1)[1]: (r.listed, r.some) for r in files.collect()} == {"list.json": (True, True), "cut.json": (False, True)}


def test_ledger_files_take_a_fraction_of_their_text(spark):
    with run_folder(spark) as folder:
        assert QUERIES["part_scan"](spark, "/root/testdata/sf0.01").count() == 15_000
        stored = sum(p.stat().st_size for p in Path(folder.removeprefix("file:")).rglob("*") if p.is_file())
    # The claims as text take 10 MB.
    assert stored < 4_000_000
