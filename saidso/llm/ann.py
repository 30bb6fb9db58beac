"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them, exact reranking.

Each tree cuts by one random direction a level, the directions of a tree at right angles, at the median of the rows in a
node. Medians are those of a bounded sample (SAMPLE distinct vectors, of which only the projections reach the driver); every
row of the table then goes down every tree, so the index holds them all. A leaf is a table key (tree and leaf number), its
rows are vectors with their ids, and a leaf with many rows is cut into parts.

A query walks all trees through one queue: it holds the subtrees not entered yet, nearest first by the squared distance to
the cuts that keep the query out, and each one taken is walked down to its nearest leaf. How many leaves are taken is not
guessed: for PROBES rows the true neighbours are found by brute force, and the number is the one with which a share RECALL
of them is reached. Leaves are taken further until they hold more than k rows. All rows of the leaves taken are scored
exactly, in blocks of a part's rows and the queries there: first those of the FIRST nearest leaves, then of four times as many,
and so on. A block reports the k best of each query, but nothing below the kth score that the leaves before have reached, so
what it reports does not grow with the leaves.

The largest inner product is sought: rows get one more component, so that all have the norm of the longest and the nearest
by distance is the largest by product. Scores are sums in double precision over the given vectors, always added in the same order.

Defined results: vectors that are null, zero or hold null, NaN or infinite components take no part, nor do null ids; only
vectors of equal length are compared, each length in a forest of its own; equal vectors are one entry with their k + 1 smallest
ids, which no result can exceed; rows that share an id are all its own, and an id asked twice is asked once, with the smaller
vector; a query without candidates has no rows; empty tables give an empty table; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saidso.llm.sampling import smallest_hashes
from saidso.session import materialize

TREES = 4
#: Rows that a leaf should hold, the levels that the sample can tell apart, and the rows of a part of a leaf or of its queries.
LEAF, LEVELS, PART = 512, 12, 2048
#: Distinct vectors that the cuts are taken from; rows whose neighbours are found by brute force; the share of them to reach.
SAMPLE, PROBES, RECALL = 1 << 16, 256, 0.95
NEIGHBOURS = 20
#: Leaves of a query that are scored before a score is known that others must reach.
FIRST = 16

OUT = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


@dataclass
class Forest:
    """Directions (trees, levels, components + 1), cuts by level (trees, nodes), the rows of each leaf, and the longest norm."""

    directions: np.ndarray
    cuts: list[np.ndarray]
    scale: float
    longest: float
    counts: np.ndarray | None = None
    leaves: int = 0

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        """Projections (rows, trees, levels) of rows, made equally long by one more component."""
        near = vectors / self.scale
        rest = np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", near, near), 0))
        return self._projected(np.column_stack([near, rest]))

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        near = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        near *= self.longest / np.sqrt(np.einsum("ij,ij->i", near, near))[:, None]
        return self._projected(np.column_stack([near, np.zeros(len(near))]))

    def _projected(self, points: np.ndarray) -> np.ndarray:
        trees, levels, width = self.directions.shape
        return (points @ self.directions.reshape(trees * levels, width).T).reshape(len(points), trees, levels)

    def placed(self, projected: np.ndarray) -> np.ndarray:
        """The leaf (tree times leaves plus number) of each row in each tree."""
        rows, trees, _ = projected.shape
        number = np.zeros((rows, trees), np.int64)
        tree = np.arange(trees)[None, :]
        for level, cut in enumerate(self.cuts):
            number = number * 2 + (projected[:, :, level] > cut[tree, number])
        return number + tree * (1 << len(self.cuts))

    def walk(self, projected: np.ndarray) -> Iterator[int]:
        """The leaves of all trees for one query (trees, levels), nearest first."""
        levels = len(self.cuts)
        waiting = [(0.0, tree, 0, 0) for tree in range(len(projected))]
        while waiting:
            far, tree, level, node = heapq.heappop(waiting)
            for level in range(level, levels):
                margin = projected[tree, level] - self.cuts[level][tree, node]
                node = 2 * node + (margin > 0)
                heapq.heappush(waiting, (far + margin * margin, tree, level + 1, int(node) ^ 1))
            yield tree * (1 << levels) + int(node)

    def taken(self, projected: np.ndarray, k: int) -> list[int]:
        """The leaves that a query takes: as many as were measured, and until they hold more than k rows of one tree."""
        found, held = [], np.zeros(len(projected), np.int64)
        for leaf in self.walk(projected):
            if len(found) >= self.leaves and held.max() > k:
                break
            found.append(leaf)
            held[leaf >> len(self.cuts)] += self.counts[leaf]
        return found


def directions(dim: int, levels: int, trees: int = TREES, seed: int = 11) -> np.ndarray:
    """Random directions, at right angles within a tree as far as the components allow."""
    draw, width = np.random.default_rng(seed), dim + 1
    bases = -(-levels // width)
    out = [np.concatenate([np.linalg.qr(draw.normal(size=(width, width)))[0].T for _ in range(bases)])[:levels] if levels else np.zeros((0, width)) for _ in range(trees)]
    return np.array(out).reshape(trees, levels, width)


def cuts_of(projected: np.ndarray, levels: int) -> list[np.ndarray]:
    """Per level the medians (trees, nodes) of sampled projections (rows, trees, levels); a node without rows cuts at zero."""
    rows, trees, _ = projected.shape
    node, out = np.zeros((rows, trees), np.int64), []
    for level in range(levels):
        cut = np.zeros((trees, 1 << level))
        for tree in range(trees):
            values = projected[:, tree, level]
            order = np.lexsort((values, node[:, tree]))
            start = np.searchsorted(node[order, tree], np.arange((1 << level) + 1))
            held = np.flatnonzero(np.diff(start))
            cut[tree, held] = values[order[(start[held] + start[held + 1] - 1) // 2]]
            node[:, tree] = node[:, tree] * 2 + (values > cut[tree, node[:, tree]])
        out.append(cut)
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _stacked(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), np.float64)


def entries(table: DataFrame, vec_id: str, vector: str, k: int) -> DataFrame:
    """Distinct usable vectors: v, dim and ids, the k + 1 smallest."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    # Minus zero and zero are one number.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(x_type(table, vector)))).distinct()
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v"))


def x_type(table: DataFrame, vector: str) -> T.DataType:
    return table.schema[vector].dataType.elementType


def _norm(v: str, scale: float) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x.cast("double") / scale) * (x.cast("double") / scale)))


def _scored(queries: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and exact scores of what may be among the k best of each query and reach its floor, ties included."""
    product = queries @ vectors.T
    # What is found quickly is off by the order of adding; that much is allowed for, and the sums are taken again.
    slack = 1e-12 * np.abs(queries) @ np.abs(vectors).max(axis=0)
    if product.shape[1] > k:
        floor = np.maximum(floor, np.partition(product, product.shape[1] - k, axis=1)[:, -k])
    row, column = np.nonzero(~(product < (floor - slack)[:, None]))
    exact = np.concatenate([(queries[row[at : at + 65536]] * vectors[column[at : at + 65536]]).sum(axis=1) for at in range(0, max(len(row), 1), 65536)])
    return row, column, exact


def _best(query_ids: np.ndarray, row: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> pa.Table:
    """The k best of each query (`row` counts them), its own id left out."""
    other = query_ids[row] != vec
    row, vec, score = row[other], vec[other], score[other]
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.table({"query_id": pa.array(query_ids[row[few]], pa.int64()), "vec_id": pa.array(vec[few], pa.int64()), "score": pa.array(score[few], pa.float64())})


def _block(dim: int, k: int):
    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The best of a part's rows for each query that takes it."""
        queries = asked["query_id"].to_numpy()
        if not len(queries) or not held.num_rows:
            return _best(queries, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), k)
        floor = asked["floor"].to_numpy()
        row, column, exact = _scored(_matrix(asked["q"], dim), _matrix(held["v"], dim), floor, k + 1)
        reached = ~(exact < floor[row])
        row, column, exact = row[reached], column[reached], exact[reached]
        ids = held["ids"].combine_chunks()
        start, flat = np.asarray(ids.offsets), np.asarray(ids.values)
        many = np.diff(start)[column]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return _best(queries, np.repeat(row, many), flat[np.repeat(start[column], many) + within], np.repeat(exact, many), k)

    return score


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best; one pair may come from several trees, always with the same score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()


def brute_force(every: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """The true neighbours of a bounded number of queries, sent to every task."""
    rows = asked.select("vec_id", "v").toPandas()
    ids, queries = rows["vec_id"].to_numpy(), _stacked(rows["v"]).reshape(len(rows), dim)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.table({"query_id": ids, "floor": np.full(len(ids), -np.inf), "q": pa.FixedSizeListArray.from_arrays(pa.array(queries.ravel()), dim)})
        for batch in batches:
            yield from _block(dim, k)(table, pa.Table.from_batches([batch])).to_batches()

    return _nearest(every.select("v", "ids").mapInArrow(score, OUT), k)


def fit(every: DataFrame, dim: int, size: int, k: int, sample: int = SAMPLE, leaf: int = LEAF) -> tuple[Forest, DataFrame]:
    """The forest of vectors of one length, and the index: `every` with the leaves of each row."""
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(size, 1) / leaf)))))
    top = every.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).cast("double")).first()[0]
    longest = every.agg(F.max(_norm("v", top))).first()[0]
    trees = TREES if levels else 1
    forest = Forest(directions(dim, levels, trees), [], top, longest)

    @F.pandas_udf("array<float>")
    def projected(values: pd.Series) -> pd.Series:
        return pd.Series(list(forest.rows(_stacked(values)).reshape(len(values), -1).astype(np.float32)))

    if levels:
        rows = smallest_hashes(every.select("v"), sample, "v").select(projected(F.col("v")).alias("p")).toPandas()
        forest.cuts = cuts_of(_stacked(rows["p"]).reshape(len(rows), trees, levels), levels)

    @F.pandas_udf("array<long>")
    def placed(values: pd.Series) -> pd.Series:
        return pd.Series(list(forest.placed(forest.rows(_stacked(values)))))

    index = materialize(every.withColumn("leaves", placed(F.col("v"))))
    forest.counts = np.zeros(trees << levels, np.int64)
    for leaf_id, n in index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # at most TREES << LEVELS
        forest.counts[leaf_id] = n
    forest.leaves = calibrated(forest, index, dim, k)
    return forest, index


def calibrated(forest: Forest, index: DataFrame, dim: int, k: int, share: float = RECALL, probes: int = PROBES) -> int:
    """The leaves to take, so that `share` of the true neighbours of `probes` rows are among their rows."""
    if not forest.cuts:
        return 1
    asked = smallest_hashes(index.select("v", F.col("ids")[0].alias("vec_id")), probes, "v")
    asked = materialize(asked)
    truth = brute_force(index, asked, dim, k).select("query_id", "vec_id")
    held = index.select(F.explode("ids").alias("vec_id"), "leaves")
    pairs = truth.join(held, "vec_id").groupBy("query_id").agg(F.collect_list("leaves").alias("leaves")).join(asked.select(F.col("vec_id").alias("query_id"), "v"), "query_id")

    @F.pandas_udf("array<long>")
    def turns(values: pd.Series, leaves: pd.Series) -> pd.Series:
        """The turn at which each neighbour's first leaf is taken."""
        out = []
        for projected, of_all in zip(forest.queries(_stacked(values)), leaves):
            turn = {leaf: i + 1 for i, leaf in enumerate(forest.walk(projected))}
            out.append([min(turn[x] for x in each) for each in of_all])
        return pd.Series(out)

    needed = [n for row in pairs.select(turns(F.col("v"), F.col("leaves"))).collect() for n in row[0]]  # probes times k numbers
    return int(np.quantile(needed, share, method="higher")) if needed else TREES


def _search(forest: Forest, index: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """The k best of the leaves that each query (query_id, q) takes."""
    parts = forest.counts // PART + 1

    @F.pandas_udf("array<long>")
    def taken(values: pd.Series) -> pd.Series:
        return pd.Series([forest.taken(p, k) for p in forest.queries(_stacked(values))])

    visits = materialize(asked.withColumn("leaf", taken(F.col("q"))))
    numbers = visits.select(F.explode("leaf").alias("leaf")).groupBy("leaf").count().collect()  # at most TREES << LEVELS
    small = F.broadcast(index.sparkSession.createDataFrame([(leaf, int(parts[leaf]), n // PART + 1) for leaf, n in numbers], "leaf long, parts long, turns long"))
    rows = index.select("v", "ids", F.explode("leaves").alias("leaf")).join(small, "leaf")
    rows = rows.select("leaf", F.pmod(F.xxhash64("v"), "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "v", "ids")
    key, best, done = ["leaf", "part", "turn"], None, 0
    most = visits.agg(F.max(F.size("leaf"))).first()[0] or 0
    while best is None or done < most:
        step = FIRST if best is None else 3 * done
        asks = visits.select("query_id", "q", F.explode(F.slice("leaf", done + 1, step)).alias("leaf"))
        none = F.lit(float("-inf"))
        if best is not None:
            full = best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
            asks = asks.join(full, "query_id", "left")
        asks = asks.withColumn("floor", F.coalesce("floor", none) if best is not None else none).join(small, "leaf")
        asks = asks.select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), "turns").alias("turn"), "query_id", "q", "floor")
        found = asks.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_block(dim, k), OUT)
        best = materialize(_nearest(found if best is None else found.unionByName(best.drop("rank")), k))
        done += step
    return best


def nearest(table: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of `table` found for every row of `queries`, ties to the smaller id."""
    every = materialize(entries(table, vec_id, vector, k))
    wanted = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).alias("q")).where(F.col("query_id").isNotNull() & usable(F.col("q")))
    wanted = materialize(wanted.groupBy("query_id").agg(F.min("q").alias("q")))
    found = None
    for dim, size in sorted(every.groupBy("dim").count().collect()):
        of_length, asked = every.where(F.col("dim") == dim).select("v", "ids"), wanted.where(F.size("q") == dim)
        forest, index = fit(of_length, dim, size, k)
        part = _search(forest, index, asked, dim, k)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else _nearest(wanted.sparkSession.createDataFrame([], OUT), k)
