"""Spelling variants: words one letter apart, found in an FM-index of the delimited vocabulary by a two-part search scheme.

One error leaves either the left or the right part of a word whole. A search matches one part exactly, from its end of the
word inwards, and goes on across the other part with one replaced, inserted or deleted letter, up to the delimiter there. It
holds an interval of suffix ranks, which each letter narrows by two looks into the table of ranks: leftwards over the
vocabulary's text, rightwards over its mirror image. As both ends of a word are delimited, no search has to turn round, so
each direction keeps its own interval and neither has to be carried over to the other index.

The vocabulary is dealt out so that no index holds all of it: a word lies under its length and the (length - 1) // 2 letters at
its start, and again under those at its end; one error leaves one of the two unchanged. A word asks under the three lengths it
may meet. Words and questions come to blocks of about BLOCK words by a hash of that key, and a key of more words or questions
than a block holds is cut into parts that all meet. A pair that both searches would find is reported by the one from the left.
Blocks return counts and the best word, not pairs.

Defined results: a null or empty text has no words; a null id counts as an empty one; the words of repeated rows count
again; of two near words of equal count the smaller in code-point order is the form; an empty table gives an empty table; extra
columns are not read. Words may have any length; an index grows with the letters of its block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saidso.session import materialize

#: Runs of letters, how often one is misread, and what a word must have.
LETTERS, ODDS, LENGTH, TIMES = "[A-Za-zÀ-ÿ]", 31, 7, 2
#: How much more often a word must occur to be the form of another.
RATIO = 10
#: Words of a block, and letters that a row of ranks is kept for.
BLOCK, STEP = 8192, 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = LENGTH) -> DataFrame:
    """(run, word) of every run of letters that may give a word of `shortest` letters; one run in ODDS loses a letter."""
    # A shorter run gives no word; a match of the shortest length or more always starts where its run starts.
    each = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    named = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode(each).alias("run"))
    h = F.crc32(F.concat_ws(":", "_id", "run"))
    named = named.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return named.select("run", F.when(F.col("h") % ODDS == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = LENGTH, times: int = TIMES) -> DataFrame:
    """word and n of the words that are long and frequent enough."""
    words = runs(docs, doc_id, text, shortest).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


class Index:
    """An FM-index over delimited words, searched leftwards: the delimiter after a word, its letters from the last, the delimiter before it.

    `ranks` has, for every STEP places of the text's last column, how often each symbol occurs before; the few symbols in
    between are counted there and then.
    """

    def __init__(self, words: list[str]):
        joined = "\0" + "\0".join(words) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(points, return_inverse=True)
        self.size = len(self.alphabet)
        # The text ends in a symbol smaller than all others, so no two suffixes are equal.
        text = np.append(text + 1, 0)
        order = suffixes(text)
        last = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size + 1))])
        count = len(text) // STEP + 1
        self.last = np.append(last, np.full(count * STEP - len(last), self.size + 1)).astype(np.int32)
        step = np.bincount(np.repeat(np.arange(count), STEP) * (self.size + 2) + self.last, minlength=count * (self.size + 2)).reshape(count, -1)
        self.ranks = np.zeros((count, self.size + 2), np.int32)
        np.cumsum(step[:-1], axis=0, out=self.ranks[1:], dtype=np.int32)
        # Word i starts after the i-th delimiter; a whole match starts at the delimiter.
        start = np.flatnonzero(text == 1)
        self.word = np.full(len(text), -1)
        self.word[start[:-1]] = np.arange(len(words))
        self.word = self.word[order]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the last column before each place."""
        row = place // STEP
        window = self.last[(row * STEP)[:, None] + np.arange(STEP)]
        within = (window == symbol[:, None]) & (np.arange(STEP) < (place - row * STEP)[:, None])
        return self.ranks[row, symbol] + within.sum(axis=1)

    def extended(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of what was matched with one more symbol to the left; symbol 0 is one that does not occur."""
        known = symbol > 0
        base = self.first[symbol]
        low, high = base + self.rank(symbol, low), base + self.rank(symbol, high)
        return low, np.where(known, high, low)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every letter that stands left of what was matched: the interval it extends, the letter, and its interval."""
        many = high - low
        # A narrow interval is read; of a wide one, all letters are looked up.
        narrow = np.flatnonzero(many <= 2 * self.size)
        at = np.repeat(low[narrow] - np.concatenate([[0], np.cumsum(many[narrow])[:-1]]), many[narrow]) + np.arange(many[narrow].sum())
        pair = np.unique(np.repeat(narrow, many[narrow]) * (self.size + 2) + self.last[at])
        wide = np.flatnonzero(many > 2 * self.size)
        every = (wide[:, None] * (self.size + 2) + np.arange(2, self.size + 1)).ravel()
        pair = np.concatenate([pair, every])
        of, symbol = pair // (self.size + 2), pair % (self.size + 2)
        letter = symbol > 1
        of, symbol = of[letter], symbol[letter]
        down, up = self.extended(low[of], high[of], symbol)
        some = up > down
        return of[some], symbol[some], down[some], up[some]

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of all words, one after the other, where each starts, and how long it is."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(symbol, self.size - 1)] == points
        length = np.fromiter(map(len, words), np.int64, len(words))
        return np.where(known, symbol + 1, 0), np.cumsum(length) - length, length

    def near(self, words: list[str], change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, word) of all words whose last (their length - 1) // 2 letters are those of the question and that differ
        by one letter: replaced (change 0), one more in the index's word (1) or one less (-1). No pair comes twice."""
        text, start, length = self.coded(words)
        exact = (length + change - 1) // 2
        who = np.arange(len(words))
        low, high = self.extended(np.zeros(len(who), np.int64), np.full(len(who), len(self.word)), np.ones(len(who), np.int64))
        # done: letters of the question that are matched or skipped; wrong: whether the error is made.
        done, wrong = np.zeros(len(who), np.int64), np.zeros(len(who), bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            ended = wrong & (done == length[who])
            if ended.any():
                down, up = self.extended(low[ended], high[ended], np.ones(ended.sum(), np.int64))
                at = np.repeat(down - np.concatenate([[0], np.cumsum(up - down)[:-1]]), up - down) + np.arange((up - down).sum())
                found.append((np.repeat(who[ended], up - down), self.word[at]))
            going = ~ended
            who, low, high, done, wrong = who[going], low[going], high[going], done[going], wrong[going]
            left = done < length[who]
            next_symbol = np.where(left, text[np.minimum(start[who] + length[who] - 1 - done, max(len(text) - 1, 0))] if len(text) else 0, 0)
            parts = []
            down, up = self.extended(low, high, next_symbol)
            step = left & (up > down)
            parts.append((who[step], down[step], up[step], done[step] + 1, wrong[step]))
            may = ~wrong & (done >= exact[who])
            less = may & left & (change[who] == -1)
            parts.append((who[less], low[less], high[less], done[less] + 1, np.ones(less.sum(), bool)))
            branch = np.flatnonzero(may & ((change[who] == 1) | (left & (change[who] == 0))))
            of, symbol, down, up = self.children(low[branch], high[branch])
            of = branch[of]
            replaced = change[who[of]] == 0
            some = ~replaced | (symbol != next_symbol[of])
            of, down, up, replaced = of[some], down[some], up[some], replaced[some]
            parts.append((who[of], down, up, done[of] + replaced, np.ones(len(of), bool)))
            who, low, high, done, wrong = (np.concatenate(x) for x in zip(*parts))
            if len(who):
                # One more or one less of the same letter in a row is one word on several ways: they meet in one state.
                state = np.lexsort((wrong, done, high, low, who))
                fresh = np.ones(len(state), bool)
                fresh[1:] = np.any([np.diff(x[state]) != 0 for x in (who, low, high, done, wrong.astype(np.int8))], axis=0)
                who, low, high, done, wrong = (x[state[fresh]] for x in (who, low, high, done, wrong))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        question, word = (np.concatenate(x) for x in zip(*found))
        pair = np.unique(question * len(self.word) + word)
        return pair // len(self.word), pair % len(self.word)


def suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array: ranks of a few symbols, doubled until all differ."""
    size, width = len(text), int(text.max()) + 1
    step, key = 1, text.astype(np.int64)
    while width ** (2 * step) < 1 << 62 and step < 16:
        key = key * width**step + np.append(key[step:], np.zeros(min(step, size), np.int64))[:size]
        step *= 2
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.zeros(size, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if size == 0 or rank[order[-1]] == size - 1:
            return order
        key = rank * (size + 1) + np.append(rank[step:] + 1, np.zeros(min(step, size), np.int64))[:size]
        step *= 2


def searched(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Of one block: for every word that asks, how many near words it has here, and the most frequent of them."""
    result = {"word": [], "n_near": [], "form_n": [], "form": []}
    for left in (True, False):
        questions, words = (t.filter(pc.equal(t["left"], left)) for t in (asked, held))
        if not questions.num_rows or not words.num_rows:
            continue
        question, change, word, n = questions["asks"].to_pylist(), questions["change"].to_numpy(), words["word"].to_pylist(), words["n"].to_numpy()
        turned = (lambda w: w[::-1]) if left else (lambda w: w)
        i, j = Index([turned(w) for w in word]).near([turned(q) for q in question], change)
        if not left:
            # What starts alike is found from the left.
            own = np.fromiter((question[a][: (len(word[b]) - 1) // 2] != word[b][: (len(word[b]) - 1) // 2] for a, b in zip(i, j)), bool, len(i))
            i, j = i[own], j[own]
        if not len(i):
            continue
        place = np.argsort(np.argsort(np.array(word, object)))  # code-point order
        order = np.lexsort((place[j], -n[j], i))
        i, j = i[order], j[order]
        start = np.flatnonzero(np.append(True, np.diff(i) != 0))
        result["word"] += [question[a] for a in i[start]]
        result["n_near"] += np.diff(np.append(start, len(i))).tolist()
        result["form_n"] += n[j[start]].tolist()
        result["form"] += [word[b] for b in j[start]]
    return pa.table({"word": pa.array(result["word"], pa.string()), "n_near": pa.array(result["n_near"], pa.int64()), "form_n": pa.array(result["form_n"], pa.int64()), "form": pa.array(result["form"], pa.string())})


def _key(left: bool, length: Column) -> Column:
    """The letters at one end that a word of `length` lies under."""
    half = F.floor((length - 1) / 2).cast("int")
    return F.substring("word", F.lit(1), half) if left else F.substring("word", F.char_length("word") - half + 1, half)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form and form_n (the most frequent near word and its count) of the `words` (word, n) that have near words."""
    length = F.char_length("word")
    lies = F.array(*(F.struct(F.lit(left).alias("left"), length.alias("length"), _key(left, length).alias("end")) for left in (True, False)))
    asks = F.array(*(F.struct(F.lit(left).alias("left"), (length + c).alias("length"), _key(left, length + c).alias("end"), F.lit(c).alias("change")) for left in (True, False) for c in (-1, 0, 1)))
    key = F.xxhash64("k.left", "k.length", "k.end")
    held = words.select("word", "n", F.explode(lies).alias("k")).select("word", "n", "k.left", key.alias("key"))
    asked = words.select("word", F.explode(asks).alias("k")).select(F.col("word").alias("asks"), "k.left", "k.change", key.alias("key"))
    # A key of one word has no answer to that word's own question.
    sizes = held.groupBy("key").agg(F.count("*").alias("n_held"))
    sizes = materialize(sizes)
    large = materialize(sizes.where(F.col("n_held") > block))
    many = asked.join(large, "key").groupBy("key").agg(F.count("*").alias("n_asked"), F.max("n_held").alias("n_held"))
    parts = materialize(many.select("key", F.ceil(F.col("n_held") / block).alias("parts"), F.ceil(F.col("n_asked") / (4 * block)).alias("turns")))
    blocks = max(1, -(-2 * words.count() // block))
    one = F.lit(1).cast("long")

    def dealt(rows: DataFrame, word: str, own: str, other: str, place: str, spread: str) -> DataFrame:
        """Rows with their block: in one of the `own` parts of their key, beside each of the `other`."""
        rows = rows.join(parts, "key", "left").withColumns({"block": F.pmod("key", F.lit(blocks)), place: F.pmod(F.xxhash64(word, F.lit(1)), F.coalesce(own, one))})
        return rows.withColumn(spread, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, one) - 1))).drop("key", "parts", "turns")

    held = dealt(held, "word", "parts", "turns", "part", "turn")
    asked = dealt(asked.join(sizes, "key").where("change <> 0 OR n_held > 1").drop("n_held"), "asks", "turns", "parts", "turn", "part")
    by = ["block", "part", "turn"]
    found = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(searched, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root (the last of its forms) of the words of `forms` (word, form).

    A form occurs RATIO times as often as its word, so there are no more than 19 in a row, and five rounds of taking the form's form reach the end.
    """
    reached = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not reached.join(further, "root", "left_semi").limit(1).count():
            return reached
        reached = materialize(reached.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    words = materialize(vocabulary(docs, doc_id, text))
    near = near_words(words)
    fits = F.col("form_n") >= ratio * F.col("n")
    rows = words.join(near, "word", "left")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
