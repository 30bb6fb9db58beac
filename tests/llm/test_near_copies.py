"""Near-duplicates by five-word similarity against brute force."""

import random
from collections import defaultdict

import corpus_pipeline
from saidso.llm import jaccard, simhash

DOCS = "doc_id long, text string"


def shingle_set(text):
    w = [x.lower() for x in (text or "").split()]
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """The smallest id of each component of rows (id, text) at a similarity of four fifths."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    least = {i: i for i, _ in rows}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a == b or 5 * both >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                least[y] = x
    return {i: top(i) for i, _ in rows}


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
        rows += [changed(rng, base, rng.randint(0, len(base) // 30)) for _ in range(4)]
    hot = [f"h{i}" for i in range(300)]
    rows += [changed(rng, hot, rng.randint(1, 10)) for _ in range(120)]
    rows += [None, "", " \n", "one two", "One  TWO", "one two three", "é b c d e f", "x " * 40_000]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "old") for i, t in rows], DOCS + ", note string")
    want = components(rows)
    sizes = defaultdict(int)
    for x in want.values():
        sizes[x] += 1
    assert len(sizes) > 60 and max(sizes.values()) > 60
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs.select("doc_id", "text")).collect()} == want
    again = docs.unionByName(docs.where("doc_id % 3 = 0"))
    kept = corpus_pipeline.distinct_documents(spark, again, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(sizes)
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_pipeline_stage_drops_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = components(rows)
    assert len({*want.values()}) < len({shingle_set(t) for _, t in rows})
    assert sorted(r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()) == sorted({*want.values()})


def test_simhash_broadcasts_no_table_that_grows(spark, monkeypatch):
    plans, keep = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, changed(rng, base, 1)) for i in range(40)] + [(100 + i, f"word{i}") for i in range(40)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert len({r.component_id for r in found.collect()}) > 1
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


def test_documents_that_share_an_id_are_not_near_copies(spark):
    rng = random.Random(9)
    a, b, c = ([f"{x}{rng.randrange(5000)}" for _ in range(100)] for x in "abc")
    texts = [" ".join(a), " ".join(b), changed(rng, a, 1), " ".join(c), changed(rng, c, 1)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, DOCS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()]
    assert sorted(kept[:], key=str) in [sorted([rows[0], rows[1], x], key=str) for x in rows[3:]]
    # By fingerprints: three texts of a's, b's and c's words stay, whatever their ids.
    exact = spark.createDataFrame([rows[0], rows[1], rows[3], (2, texts[0]), (None, texts[3])], DOCS)
    assert sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(exact).collect()) == sorted([(1, texts[0]), (1, texts[1]), (0, texts[3])])
