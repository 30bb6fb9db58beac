"""SimHash, top-k, packing, toxicity, page text and the pipeline against brute force, round trips and held-out rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from test_near_copies import components
from tokenizers import Tokenizer

import corpus_pipeline
from saidso.llm import decontamination, packing, secret_scans, simhash, topk, toxicity
from saidso.llm import html_extraction as X
from saidso.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
PATH = public_tokenizers.path("byte_bpe_50k.json")

# ---- SimHash -------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(nodes, linked):
    least = {n: n for n in nodes}
    def top(x):
        while least[x] != x:
            x = least[x]
        return x
    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        least[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("radius", [2, 3])
def test_links_join_what_is_linked(spark, radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(6)] + [0, 1 << 63, (1 << 64) - 1]
    fps = set(seeds)
    # A crowd around one seed, which fills its buckets, and chains and strays around the others.
    for _ in range(500):
        x = seeds[0]
        for b in rng.sample(range(14), rng.randint(0, 6)):
            x ^= 1 << (b * 4 + 3)
        fps.add(x)
    for s in seeds[1:]:
        x = s
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, radius + 1)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    a = np.array(fps, np.uint64)
    want = grouped(fps, [(x, fps[j]) for i, x in enumerate(fps) for j in np.nonzero(np.bitwise_count(a ^ np.uint64(x)) <= radius)[0] if j > i])
    links = simhash.links(df, radius)
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links.collect()]
    assert all((x ^ y).bit_count() <= radius for x, y in found)
    assert grouped(fps, found) == want
    assert grouped(fps, [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.stars(df, radius).collect()]) == want
    labels = {r.node % (1 << 64): r.label % (1 << 64) for r in simhash.components(links).collect()}
    parts = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert parts({x: labels.get(x, x) for x in fps}) == parts(want)


def test_components_of_a_long_chain(spark):
    order = random.Random(1).sample(range(200), 200)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(500, 501), (501, 501)], "a long, b long")
    assert {r.node: r.label for r in simhash.components(edges).collect()} == {**dict.fromkeys(range(200), 0), 500: 500, 501: 500}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(400)] for _ in range(4)]
    rows = []
    for i in range(90):
        w = list(base[i % 4])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(400)] = rng.choice(vocab)
        rows.append((i + 10, " ".join(w) if i % 3 else "\n\t".join(w).upper()))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one two"), (6, "ÀB one"), (None, rows[0][1]), rows[5], (None, "alone here with no id at all"), (7, "x " * 40_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", fp string, _k int")
    got = simhash.near_duplicates(docs).collect()
    want_fp = [plain_fingerprint(t) for _, t in rows]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter((d, f) for (d, _), f in zip(rows, want_fp))
    fps = sorted(set(want_fp))
    groups = grouped(fps, [(x, y) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 3])
    least = defaultdict(list)
    for (d, _), f in zip(rows, want_fp):
        least[groups[f]].append(d)
    for r in got:
        assert r.component_id == min((d for d in least[groups[r.fp % (1 << 64)]] if d is not None), default=None)
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len(least) and sorted(r.doc_id or -1 for r in kept) == sorted(min((d for d in v if d is not None), default=-1) for v in least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


# ---- Top-k ---------------------------------------------------------------------


def best_of(rows, queries, k):
    usable = {}
    whole = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in sorted((i, v) for i, v in whole if i in queries):
        usable.setdefault(i, v)
    out = set()
    for i, v in usable.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def test_top_k_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(150)] + [(2000, None), (2001, [1.0, None, 0.0, 1.0]), (2100, [float("nan"), 0.0, 0.0, 0.0]), (2200, [float("inf")] * 4), (None, [1.0] * 4), (2300, [1.0, 2.0]), (2301, [3.0, 4.0]), (2400, []), (2500, [1e9, -1e9, 1e9, 1.0]), (300, [0.1, 0.2, 0.3, 0.4])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    for k in (1, 10):
        got = topk.top_k(df, df.where("vec_id % 100 = 0"), k).collect()
        assert len(got) == len(set(map(tuple, got)))
        ids = {i for i, _ in rows if i is not None and i % 100 == 0}
        assert {tuple(r) for r in got} == {x for x in best_of(rows, ids, k)}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


# ---- Packing -------------------------------------------------------------------


def test_packing_round_trip(spark):
    texts = ["", None, "Hello  world \n\n x ", " lead", "a b c", "trail ", "<|endoftext|> there", "é  ñ　x", "'s it's  don't\t", "word" * 5000, "one two three. " * 2000, "x y\r\nz", "日本語 テキスト 🙂 ok"] + [" ".join(f"t{j}" for j in range(i * 7 % 600)) for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (14, texts[14])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", ids string")
    got = packing.pack_documents(docs.coalesce(1), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]
    by_doc, space = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()))
        space[r.sequence_id].append((r.offset, r.length))
    for d, ids in want:
        if d != 14:
            pieces = sorted(by_doc[d])
            assert [p[0] for p in pieces] == list(range(len(pieces))) and sum((p[2] for p in pieces), []) == ids
            assert [p[1] for p in pieces] == [sum(len(q[2]) for q in pieces[:k]) for k in range(len(pieces))]
            assert len(ids) > 2048 or len(pieces) == 1
            assert all(len(p[2]) == 2048 for p in pieces[1:])
    assert len(by_doc[14]) == 2
    for places in space.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(ids) for _, ids in want)
    assert len(space) <= 1.02 * total / 2048 + 2
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (7, 6, 4, 8)] == [(0, 0), (1, 0), (1, 6), (2, 0)]
    assert bins.place(9) == (3, 0)  # two are open, so the fullest, number 2, closes
    assert bins.place(2) == (0, 7) and bins.place(1) == (0, 9)


# ---- Toxicity -------------------------------------------------------------------


def test_toxicity_on_the_held_out_fold(spark):
    rows = Q.op8_toxicity(spark, "/root/testdata/sf0.1").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    good = [s for s, t in judged if t]
    bad = [s for s, t in judged if not t]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    assert sum(s >= 0.3 for s in good) > 0.7 * len(good) and sum(s >= 0.3 for s in bad) < 0.02 * len(bad)


def test_toxicity_on_awkward_rows(spark):
    docs = spark.createDataFrame([(i, "you are a scumbag really" if i % 3 == 0 else "a fine day for all of us", "x") for i in range(120)] + [(500, None, "x"), (501, "", "x"), (None, "scumbag", "x"), (502, "scumbag " * 20_000, "x")], DOCS + ", score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (3, None), (3, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.scored(docs, model).collect()}
    assert all(got[i][1] == (i % 3 == 0) for i in range(120)) and got[None][1] == got[502][1] == 1
    assert got[500] == got[501] and 0 <= got[500][0] <= 1
    for none in (labels.limit(0), labels.where("toxic = 0")):
        flat = toxicity.fit(docs, none)
        assert len({r.score for r in toxicity.scored(docs, flat).collect()}) == 1
    assert toxicity.scored(docs.limit(0), model).count() == 0 and toxicity.fit(docs.limit(0), labels).score("x") >= 0
    assert toxicity.passed(docs, model).count() == 80 + 2 * (got[500][1] == 0) and toxicity.passed(docs, model).columns == docs.columns


# ---- Page text ------------------------------------------------------------------


def test_page_text_of_the_driver_tables(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op3_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_held_out_composed_pages():
    texts = [f"Sentence {i} tells about {'and '.join(f'thing{j} ' for j in range(i % 9 + 2))}, as it should." for i in range(200)]
    plain = [f"<html><body><nav><a href=x>a</a></nav><article><h1>{t}</h1><p>{t}</p></article><footer>f</footer></body></html>" for t in texts[:40]]
    trees = X.train(plain)
    right = 0
    for page in (pages := X.composed(texts, 120, seed=991)):
        marks = [True, *(m == "1" for m in re.findall(r"data-k=(\d)", page))]
        bare = re.sub(r" ?data-k=\d", "", page)
        want = "\n\n".join(t for n, t in X.parse(bare).runs if marks[n])
        right += X.main_texts([bare], trees)[0] == want
    assert right >= 0.9 * len(pages)


def test_awkward_pages(spark):
    pages = spark.createDataFrame(
        [
            (1, "u", None, "old"), (2, "u", "", "old"), (3, None, "<article><p>A &amp; B&#33;<br>c<script>var x='</p>'</script><p>  two\n lines <b>bold</b></article>", "old"), (4, "u", "<nav><a href=/>x</a></nav>", "old"),
            (5, "u", "<div " + "a='" * 500, "old"), (6, "u", "<div>" * 3000 + "deep", "old"), (7, "u", "<article><p>" + "long text, with words. " * 20_000 + "</p></article>", "old"), (7, "u", "<article><p>x < y and a<!-- c --> b</p></article>", "old"),
        ],
        "page_id long, url string, html string, text string",
    )
    got = X.extract_text(pages, trees=X.train(["<nav><a href=/>m</a></nav><article><h1>Title of it</h1><p>Some words of text here, as always.</p></article><footer>foot of page</footer>"])).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.page_id].append(r.text)
    assert len(got) == 8 and by_id[1] == by_id[2] == by_id[4] == [""]
    assert by_id[3] == ["A & B! c\n\ntwo lines bold"] and "x < y and a b" in by_id[7] and max(map(len, by_id[7])) == 23 * 20_000 - 1
    assert X.extract_text(pages.limit(0)).count() == 0


def test_decoding_is_consistent():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 9)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        margin = np.array([rng.uniform(-2, 2) for _ in range(n)])
        kept = X.decoded(parents, margin)
        assert all(kept[p] for k, p in zip(kept, parents) if k and p >= 0)
        best = max(sum(margin[i] for i in range(n) if m >> i & 1) for m in range(1 << n) if all(not m >> i & 1 or parents[i] < 0 or m >> parents[i] & 1 for i in range(n)))
        assert abs(sum(margin[i] for i in range(n) if kept[i]) - best) < 1e-9


# ---- Pipeline --------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, columns = docs.collect(), docs.columns
    clean = corpus_pipeline.clean_language(spark, docs, SF).collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(clean) == sorted(r for r in rows if model.score(r.text) < toxicity.THRESHOLD) and len(clean) > 0.8 * len(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == columns
    distinct = corpus_pipeline.distinct_documents(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in distinct) == sorted({*components([(r.doc_id, r.text) for r in rows]).values()})
    leaks = {r.doc_id for r in decontamination.contained(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and sorted(r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, SF).collect()) == sorted(r.doc_id for r in rows if r.doc_id not in leaks)
    masked = {r.doc_id: r for r in corpus_pipeline.masked_secrets(spark, docs, SF).collect()}
    hits = {r.doc_id for r in secret_scans.scan_secrets(docs.select("doc_id", "text")).where(F.size("spans") > 0).collect()}
    assert all(("[secret]" in masked[r.doc_id].text) == (r.doc_id in hits) and (r.doc_id in hits or masked[r.doc_id] == r) for r in rows)
    kept = {*components([(r.doc_id, r.text) for r in clean]).values()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept - leaks


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
