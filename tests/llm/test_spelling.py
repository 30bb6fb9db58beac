"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from saidso.llm import spelling

DOCS = "doc_id long, text string"


def plain_vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def text_of(rng, stems, times):
    words = []
    for _ in range(times):
        w = rng.choice(stems)
        if rng.random() < 0.5:
            at, c = rng.randrange(len(w) + 1), rng.choice("abcdé×ÀZ")
            w = rng.choice([w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :]])
        words.append(w)
    return rng.choice([" ", "-", "1", "\n", "\U0001f600"]).join(words)


def test_variants_equal_brute_force(spark):
    rng = random.Random(2)
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randint(6, 12))) for _ in range(12)] + ["aaaaaaaa", "Straße×lang", "abcabcabcabc"]
    texts = [text_of(rng, stems, 60) for _ in range(80)] + [None, "", "a", "Receive receive RECEIVE " * 40, "recieves reciever receeive receive", "q" * 3_000, "q" * 3_000, "q" * 3_001, "q" * 3_001]
    rows = [*enumerate(texts), (None, "Nameless nameless nameless"), (3, texts[3])]
    words = plain_vocabulary(rows)
    want = plain_variants(words)
    assert any(v[0] is not None and v[1] != v[0] for v in want.values()) or any(v[0] for v in want.values())
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS + ", n int, word string")
    assert found(spelling.variants(docs)) == want
    assert found(spelling.variants(docs.limit(0))) == {}


def test_roots_follow_forms_to_the_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(18)] + [("x", "y")], "word string, form string")
    assert dict(spelling.roots(forms).collect()) == {f"w{i}": "w18" for i in range(18)} | {"x": "y"}


@pytest.mark.parametrize("block", [8, 64])
def test_crowded_keys_are_cut_into_parts(spark, block):
    rng = random.Random(4)
    words = {f"hot{a}{b}{c}end" for a in "abcde" for b in "abcde" for c in "abcde"} | {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(300)}
    counts = {w: rng.randint(2, 40) for w in words}
    want = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    got = {r.word: r for r in spelling.near_words(spark.createDataFrame([*counts.items()], "word string, n long"), block).collect()}
    assert {w: r.n_near for w, r in got.items()} == {w: len(v) for w, v in want.items() if v}
    assert all((r.form_n, r.form) == (max(counts[v] for v in want[w]), min(v for v in want[w] if counts[v] == max(counts[x] for x in want[w]))) for w, r in got.items())


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 300):
        for letters in (1, 2, 60):
            text = np.append(rng.integers(1, letters + 1, size), 0)
            assert spelling.suffixes(text).tolist() == sorted(range(size + 1), key=lambda i: text[i:].tolist())
