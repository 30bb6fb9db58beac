"""Toxicity: a linear classifier over character n-grams, whose features are scaled by naive Bayes log-count ratios.

Features say whether a text holds an n-gram of 3 to 6 characters (lower-cased, a space before and after), hashed into
2^BITS places. From labelled texts come, per place, the log of the ratio of its smoothed share among toxic to its share
among other texts; the FEATURES places that tell the classes apart most (by chi-square) stay, each scaled by its ratio,
and a logistic regression over them is trained. The whole text counts, however long.

Fitting reads at most SAMPLE labelled texts, those with the smallest hash of their id; that bound is all that fitting
needs on the driver: SAMPLE lists of features and one count per place and task. Scoring covers every text, in batches.

Defined results: a null or empty text holds no n-gram and is scored by the intercept alone; without labels, or with one
class only, every text gets that class's smoothed share; null labels or ids are not learned from; an id labelled twice is toxic
if one label says so; repeated rows get equal scores; input columns named as results are replaced; an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saidso.llm.sampling import smallest_hashes
from saidso.session import materialize

BITS = 20
SIZES = (3, 4, 5, 6)
SAMPLE = 12_000
FEATURES = 6_000
#: Labelled texts that must hold a place for it to be a feature.
LEAST = 4
#: Tasks that count places, so as many arrays of counts reach the driver.
TASKS = 8
THRESHOLD = 0.3


def places(text: str | None) -> np.ndarray:
    """The place of every n-gram of the text, repeats included."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = codes * np.uint64(0x9E3779B97F4A7C15)
    rolled, found = codes, []
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in SIZES:
            found.append((((rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    """A weight per place, zero for those that are no feature, and the intercept."""

    weights: np.ndarray
    intercept: float

    def margin(self, text: str | None) -> float:
        at = places(text)
        at = np.unique(at[self.weights[at] != 0])
        return float(self.intercept + self.weights[at].sum(dtype=np.float64))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(text), -60, 60))))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic (0 or 1) of at most `sample` ids outside the held-out fold, one row of each id."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = smallest_hashes(materialize(known), sample, "_id")
    # At most `sample` ids and labels.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_toxic").alias("toxic")).drop("_id")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class hold each place: one compressed array for the whole task."""
    counts, texts = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[int(toxic > 0)][np.unique(places(text))] += 1
            texts[int(toxic > 0)] += 1
    yield pa.RecordBatch.from_pydict({"counts": [zlib.compress(counts.tobytes(), 1)], "texts": [texts.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    texts = materialize(labelled(docs, labels, sample).repartition(TASKS))
    counts, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for row in texts.repartition(TASKS).mapInArrow(_counts, "counts binary, texts binary").collect():  # TASKS rows
        counts += np.frombuffer(zlib.decompress(row.counts), np.int32).reshape(2, -1)
        n += np.frombuffer(row.texts, np.int64)
    share = (n[1] + 1) / (n.sum() + 2)
    if not n.all():
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    p, q = counts[1] + 1.0, counts[0] + 1.0
    ratio = np.log((p / (n[1] + 2)) / (q / (n[0] + 2)))
    held = counts.sum(axis=0)
    expected = held * (n[1] / n.sum())
    chi = np.where(held >= LEAST, (counts[1] - expected) ** 2 / np.maximum(expected * (1 - held / n.sum()), 1e-9), 0)
    best = np.sort(np.argsort(-chi, kind="stable")[:features])
    best = best[chi[best] > 0]
    number = np.full(1 << BITS, -1, np.int32)
    number[best] = np.arange(len(best), dtype=np.int32)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.unique(f[f >= 0]) for f in (number[places(t)] for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").cast(pa.int32()), "held": [f.astype("<i4").tobytes() for f in lists]})

    rows = texts.mapInArrow(chosen, "toxic int, held binary").collect()  # at most `sample` rows
    lists = [np.frombuffer(r.held, "<i4") for r in rows]
    weights, intercept = regression(lists, np.array([r.toxic > 0 for r in rows], float), ratio[best])
    table = np.zeros(1 << BITS, np.float32)
    table[best] = weights
    return Model(table, intercept)


def regression(lists: list[np.ndarray], toxic: np.ndarray, scale: np.ndarray, decay: float = 1e-5, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression over binary features that are multiplied by `scale`, by accelerated gradient steps: weights of the plain features, intercept."""
    row = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    at = np.concatenate(lists) if lists else np.zeros(0, int)
    # The mean of a row's squared features bounds the curvature.
    squared = np.bincount(row, scale[at] ** 2, len(lists)) + 1
    rate = 1 / (0.25 * float(np.quantile(squared, 0.99)) + decay)
    w, b = np.zeros(len(scale)), float(np.log(toxic.mean() / (1 - toxic.mean())))
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        margin = np.bincount(row, (ahead * scale)[at], len(lists)) + ahead_b
        error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - toxic) / len(lists)
        step_w = ahead - rate * (scale * np.bincount(at, error[row], len(scale)) + decay * ahead)
        step_b = ahead_b - rate * float(error.sum())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = step_w + (t - 1) / t_next * (step_w - w), step_b + (t - 1) / t_next * (step_b - b)
        w, b, t = step_w, step_b, t_next
    return w * scale, b


def score(text: Column, model: Model) -> Column:
    """The chance, 0 to 1, that a text is toxic."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return of(text)


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score and predicted (1 from `threshold` on)."""
    return docs.withColumn("score", score(F.col(text), model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def passed(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` below the threshold."""
    return docs.where(score(F.col(text), model) < threshold)
