"""Transcripts, quotes, chunks and near-duplicates against restatements and brute force on small fixtures."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saidso.functions import tokens as K
from saidso.operators import chunks as C
from saidso.operators import extraction as X
from saidso.operators import layout as LY
from saidso.operators import quotes as Qt
from saidso.functions.urls import public_url
from saidso.functions.wording import topic_label
from saidso.sources import captions as CP
from saidso.sources import pages as PG


def test_number_signature(spark):
    cases = {
        "ten thousand robots": ["10000"], "10,000 robots": ["10000"], "two hundred and fifty thousand": ["250000"], "2027 2028": ["2027", "2028"], "1.1 million": ["1100000"],
        "9" * 45: ["1e+45"], "9" * 400: ["Infinity"], "12" + "0" * 15: ["12" + "0" * 15], "0.0000000000004": ["4e-13"], "3.25": ["3.25"], "0.001": ["0.001"], "123456789012345": ["123456789012000"],
        "a dozen": ["12"], "thousands of f2": ["1000", "f2"], "twenty five percent": ["25"], "first half": ["first"], "no numbers": [], "five and six": ["5", "6"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", K.number_signature(K.match_words(F.col("t"))).alias("n")).collect():
        assert r.n == sorted(cases[r.t]), r.t


def test_match_words_and_labels(spark):
    df = spark.createDataFrame([("Um, you know — Éric’s 1,000 won't, 50% up.",)], "t string")
    assert df.select(K.match_words(F.col("t")).alias("w")).first().w == ["erics", "1000", "wont", "50", "percent", "up"]
    rows = [("Dana", "Dana Founder", "Sam Host"), ("Sam", "Dana Founder", "Sam Host"), ("Host", "Dana Founder", None), ("Speaker 1", "Dana Founder", None), ("Guest", "Dana Founder", None), ("Bob", "Dana Founder", None)]
    w = lambda c: K.match_words(F.col(c))
    got = spark.createDataFrame(rows, "l string, w string, h string").select(K.label_problem(F.col("l"), w("l"), F.col("w"), w("w"), F.col("h"), w("h")).alias("p")).collect()
    assert [r.p is None for r in got] == [True, False, False, True, True, False]


def test_in_order_matches_plain_windows(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, rng.random()]), rng.randint(0, 9)) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, x double, n int")
    got = LY.in_order(df, ["k"], "i", {"s": F.col("n")}, {"p": F.col("x")}, {"f": F.col("x")}, block=7)
    w = W.partitionBy("k").orderBy("i")
    want = df.withColumn("s", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "p", F.last("x", True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("f", F.first("x", True).over(w.rowsBetween(1, W.unboundedFollowing)))
    assert sorted(map(tuple, got.select("k", "i", "s", "p", "f").collect())) == sorted(map(tuple, want.select("k", "i", "s", "p", "f").collect()))


def restated(quote, segments, budget):
    """Best acceptable place by trying every substring: (verified, dist, gap, start, end)."""
    words = [(w, s) for s, text in enumerate(segments) for w in text.split()]
    toks = [w for w, _ in words]

    def dist(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    best = None
    for e in range(1, len(toks) + 1):
        options = [(dist(quote, toks[s:e]), s) for s in range(max(0, e - len(quote) - budget), e)]
        low = min(d for d, _ in options)
        if low <= budget:
            best = low if best is None else min(best, low)
    return best


def test_verify_quotes_equals_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{chr(97 + i)}" for i in range(9)]
    transcripts = {t: [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25))) for _ in range(12)] for t in ("x", "y")}
    segs = [(t, i, None, None, s) for t, lines in transcripts.items() for i, s in enumerate(lines)]
    cands = []
    for n in range(24):
        t = rng.choice(["x", "y"])
        words = " ".join(transcripts[t]).split()
        size, at = rng.choice([2, 5, 8, 14, 22]), rng.randint(0, 60)
        quote = words[at : at + size]
        for _ in range(rng.randint(0, 3)):
            quote[rng.randrange(len(quote))] = rng.choice(vocab)
        cands.append((n, t, " ".join(quote), None, None))
    c = spark.createDataFrame(cands, "candidate_id int, transcript_id string, quote string, speaker string, host string")
    s = spark.createDataFrame(segs, "transcript_id string, seg_no int, start double, speaker string, text string")
    got = {r.candidate_id: r for r in Qt.verify_quotes(c, s, block=16).collect()}
    assert len(got) == len(cands)
    for n, t, quote, _, _ in cands:
        q = quote.split()
        low = restated(q, transcripts[t], int(len(q) * 0.15 + 1e-9))
        assert got[n].verified == (low is not None), (n, quote)
        if low is not None:
            assert abs(got[n].score - (1 - low / len(q))) < 6e-4
            text = "\n".join(transcripts[t])
            cut = text[got[n].char_offset : got[n].end_offset]
            assert " ".join(cut.split()) == got[n].matched_text


def test_verify_quotes_at_lower_scores(spark):
    rng = random.Random(23)
    vocab = [f"w{chr(97 + i)}" for i in range(20)]
    line = [rng.choice(vocab) for _ in range(70)]
    s = spark.createDataFrame([("x", i, None, None, " ".join(line[i * 10 : i * 10 + 10])) for i in range(7)], "transcript_id string, seg_no int, start double, speaker string, text string")
    for min_score in (0.5, 0.7, 0.95):
        cands = []
        for n in range(1, 25):
            at = rng.randint(0, 40)
            quote = line[at : at + n]
            for _ in range(rng.randint(0, int(n * (1 - min_score) + 1))):
                quote[rng.randrange(n)] = rng.choice(vocab)
            cands.append((n, "x", " ".join(quote), None, None))
        c = spark.createDataFrame(cands, "candidate_id int, transcript_id string, quote string, speaker string, host string")
        got = {r.candidate_id: r for r in Qt.verify_quotes(c, s, min_score=min_score, block=16).collect()}
        for n, _, quote, _, _ in cands:
            q = quote.split()
            low = restated(q, [" ".join(line)], int(len(q) * (1 - min_score) + 1e-9))
            assert got[n].verified == (low is not None), (min_score, quote)
            if low is not None:
                assert abs(got[n].score - (1 - low / len(q))) < 6e-4


def test_transcripts_that_no_quote_comes_from_are_not_laid_out(spark):
    rng = random.Random(31)
    vocab = [f"w{chr(97 + i)}" for i in range(12)] + ["you", "know", "um"]
    segs, quotes = [], []
    for t in range(30):
        words = [rng.choice(vocab) for _ in range(60)]
        quotes += [words[a : a + n] for a, n in ((rng.randint(0, 30), rng.choice([1, 2, 7, 9, 14, 22])),) if t % 3 == 0]
        at = no = 0
        while at < len(words):
            n = rng.choice([0, 1, 1, 2, 3, 5])
            segs.append((f"t{t:02}", no, None, None, " ".join(words[at : at + n])))
            at, no = at + n, no + 1
    for t in range(30, 40):
        segs += [(f"t{t}", i, None, None, f"other words {t} {i}") for i in range(9)]
    s = spark.createDataFrame(segs, "transcript_id string, seg_no int, start double, speaker string, text string")
    c = spark.createDataFrame([(i, " ".join(q), None, None) for i, q in enumerate(quotes)], "candidate_id int, quote string, speaker string, host string")
    pairs = c.crossJoin(s.select("transcript_id").distinct()).withColumn("of", F.col("candidate_id"))
    each = pairs.withColumn("candidate_id", F.concat("of", F.lit("/"), "transcript_id"))
    want = Qt.verify_quotes(each, s, block=16).where("coalesce(reason, '') NOT LIKE 'not found%' AND reason IS DISTINCT FROM 'empty quote'")
    shown = ("transcript_id", "verified", "score", "reason", "matched_text", "char_offset")
    want = sorted(map(tuple, want.select("of", *shown).collect()), key=str)
    got = sorted(map(tuple, Qt.verify_quotes(c, s, scoped=False, block=16).select("candidate_id", *shown).collect()), key=str)
    assert got == want and len(got) > len(quotes)
    long = Qt.prepare_quotes(c).where("n >= 7")
    near = {r.transcript_id for r in Qt.reached(long, s).collect()}
    assert near and not near & {f"t{t}" for t in range(30, 40)}
    assert {r[1] for r in got if len(quotes[r[0]]) > 12} <= near


def test_pages_decode_and_drop_without_bounds(spark):
    cases = {
        "<p>&#x0000000000000041;&#0000000000000066; &#x110000; &#99999999999999999999;</p>": "AB &#x110000; &#99999999999999999999;",
        "<p>a</p>" + "<nav>x" * 9 + "</nav>" * 9 + "<p>b</p>": "a\n\nb",
        "<p>a</p>" + "<aside><form><nav>x</nav></form></aside>" * 7 + "<p>&amp;lt; b</p>": "a\n\n&lt; b",
    }
    df = spark.createDataFrame([(h, w) for h, w in cases.items()], "html string, want string")
    for r in PG.page_text(df).collect():
        assert " ".join(r.text.split()) == " ".join(r.want.split()), r


def test_numeric_hosts_and_long_words(spark):
    cases = {"http://0x00000000000000000008.8.8.8/a": True, "http://0x0000000000000000007f.0.0.1/a": False, "http://0xffffffffffffffffff.1.1.1/a": False, "http://017700000001/": False, "http://8.8.8.8/": True, "http://99999999999999999999/": False}
    df = spark.createDataFrame(list(cases.items()), "url string, want boolean")
    for r in df.withColumn("got", public_url(F.col("url"))).collect():
        assert r.got == r.want, r.url
    long = "a" * 3000
    assert spark.createDataFrame([(f"{long}-b",)], "t string").select(topic_label(F.col("t")).alias("l")).first().l == f"A{long[1:]} b"


def test_long_caption_files_take_linear_time(spark):
    lines = spark.range(200_000).select(F.lit("a").alias("file"), F.col("id").alias("no"), F.col("id").cast("double").alias("start"), F.lit(None).cast("string").alias("speaker"), F.concat(F.lit("line "), F.floor(F.col("id") / 2)).alias("text"))
    assert CP.drop_rolling(lines).count() == 100_000


def test_files_of_unknown_shape_are_named(spark):
    files = [("a.json", '{"segments":[{"start":"1","text":"hi"}]}'), ("b.json", '{"foo":1}'), ("c.json", "no json"), ("d.json", '[{"start":"2","text":"yo"}]'), ("e.srt", "1\n00:00:01,000 --> 00:00:02,000\nhello\n"), ("f.txt", "Ann: one")]
    segments, unread = CP.route_segments(spark.createDataFrame(files, "file string, content string"))
    assert sorted((r.transcript_id, r.text) for r in segments.collect()) == [("a.json", "hi"), ("d.json", "yo"), ("e.srt", "hello"), ("f.txt", "Ann: one")]
    assert sorted(r.file for r in unread.collect()) == ["b.json", "c.json"]


def test_chunks_cover_the_text(spark):
    rng = random.Random(3)
    lines = [" ".join("word." if rng.random() < 0.2 else "word" for _ in range(rng.randint(1, 40))) for _ in range(80)]
    s = spark.createDataFrame([("t", i, float(i), "Ann" if i % 2 else None, x) for i, x in enumerate(lines)], "transcript_id string, seg_no int, start double, speaker string, text string")
    text = "\n".join(("Ann: " if i % 2 else "") + x for i, x in enumerate(lines))
    for size, overlap in ((200, 40), (90, 0)):
        got = sorted(C.chunk_transcripts(s, size, overlap).collect(), key=lambda r: r.chunk_index)
        assert got[0].start_char == 0 and got[-1].end_char == len(text)
        for a, b in zip(got, got[1:]):
            assert a.start_char < b.start_char <= a.end_char + 1 and len(a.text) <= size
        for r in got:
            assert text[r.start_char : r.end_char] == r.text
            assert r.start_sec == text[: r.start_char].count("\n")


def test_dedupe_equals_the_greedy_pass(spark, monkeypatch):
    rng = random.Random(7)
    vocab = [f"w{chr(97 + i)}" for i in range(14)]
    base = [[rng.choice(vocab) for _ in range(10)] for _ in range(4)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(10)] = rng.choice(vocab)
        rows.append(("t", i, f"id{rng.randint(0, 400)}", "ann", rng.choice(["prediction", "stance"]), " ".join(words), rng.randint(1, 5)))
    kept = []
    for r in rows:
        def same(k):
            a, b = set(k[5].split()), set(r[5].split())
            return k[2] == r[2] or (k[4] == r[4] and len(a & b) / len(a | b) >= 0.8)
        at = next((n for n, (k, _) in enumerate(kept) if same(k)), None)
        if at is None:
            kept.append((r, r[1]))
        elif r[6] > kept[at][0][6]:
            kept[at] = (r, kept[at][1])
    df = spark.createDataFrame(rows, "transcript_id string, ordinal int, id string, person_slug string, type string, claim string, specificity int").withColumn("target_date", F.lit(None).cast("date"))
    got = sorted((r.place, r.ordinal) for r in X.dedupe_claims(df).collect())
    assert got == sorted((p, r[1]) for r, p in kept)
    monkeypatch.setattr(X.settle_components, "__defaults__", (7,))
    assert sorted((r.place, r.ordinal) for r in X.dedupe_claims(df).collect()) == got


def test_a_chain_of_claims_is_settled_in_parts(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("c").alias("component"), F.col("id").alias("ordinal"), F.concat(F.lit("v"), F.col("id")).alias("variant"), F.concat(F.lit("i"), F.col("id")).alias("id"), F.lit(1).alias("specificity"))
    near = spark.range(1, n).select(F.concat(F.lit("v"), F.col("id") - 1).alias("a"), F.concat(F.lit("v"), F.col("id")).alias("b"))
    got = X.settle_components(rows, near)
    assert got.where("ordinal <> place OR ordinal % 2 = 1").count() == 0 and got.count() == n // 2


def test_grounding(spark):
    rows = [
        ("we will ship ten thousand robots next year", "Acme will ship 10,000 robots by 2021", None), ("we will ship robots next year", "Acme will ship 500 robots", "claim has numbers the quote does not: 500"),
        ("yes next year", "Acme ships", "too short"), ("nothing here is about that at all", "Acme builds rockets", "shares no content words"), ("half of revenue will come from abroad", "50% of revenue comes from abroad", None),
    ]
    df = spark.createDataFrame(rows, "quote string, claim string, want string").withColumn("person", F.lit("Ann")).withColumn("said_date", F.lit("2020-05-01").cast("date")).withColumn("target_date", F.lit("2021-12-31").cast("date"))
    for r in X.grounding_words(df).withColumn("got", X.grounding_problem()).collect():
        assert (r.got is None) if r.want is None else (r.want in r.got), r


def test_captions(spark):
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v Dana>hello <c>there</c>\nstill me</v>\nnot me\n\n00:00:03.000 --> 00:00:04.000\nnot me\n[Music]\nnot me and more\n"
    f = spark.createDataFrame([("a.vtt", vtt)], "file string, content string")
    got = [(r.start, r.speaker, r.text) for r in CP.vtt_segments(f).orderBy("seg_no").collect()]
    assert got == [(1.0, "Dana", "hello there"), (1.0, "Dana", "still me"), (1.0, None, "not me and more")]
    plain = "Intro text\n[00:01:02] Ann Lee: hello\nand more\n\nnew paragraph\nBob (1:05) hi\nNote: not a speaker\n\nCarl: one\nCarl: two\n"
    p = spark.createDataFrame([("a.txt", plain)], "file string, content string")
    got = [(r.start, r.speaker, r.text) for r in CP.plain_segments(p).orderBy("seg_no").collect()]
    assert got == [
        (None, None, "Intro text"), (62.0, "Ann Lee", "hello and more"), (None, "Ann Lee", "new paragraph"), (65.0, "Bob", "hi Note: not a speaker"), (None, "Carl", "one"), (None, "Carl", "two"),
    ]
