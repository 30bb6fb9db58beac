"""Embedding whitening by spectrum slicing.

A vector becomes whole numbers x = floor(SCALE * entry), and every distinct x is a row of the fit list. Its sums and the sums
of products of what is left after taking off the nearest whole mean are added up exactly in tasks, whole numbers throughout, so
they do not depend on how the table is cut; what reaches the driver is one matrix of the vector's length.

The leading eigenvalues are isolated by counts: V - s I = L D Lt with symmetric pivoting has as many positive entries of D
(blocks of two count one) as V has eigenvalues above s. Halving narrows an interval until it holds one eigenvalue; Rayleigh
quotient iteration, which converges cubically, takes it from there, and is given up for more halving if it leaves the
interval. Counts just below and above each result certify that it is the one of its number. Eigenvalues too close to be
told apart are taken as one group, their vectors kept at right angles. All of this is in extended precision.

Defined results: null vectors and vectors with null, NaN or infinite entries are dropped; rows whose vector is not as long as
most are take no part (ties: the shorter); empty vectors have no components; repeated rows are repeated in the result; a
component whose eigenvalue is zero (of a fit list of one row, or of fewer dimensions) cannot be scaled and has no rows; a
deviation of over 38 digits is null; an empty table gives an empty table; input columns named as
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saidso.session import materialize

SCALE, COMPONENTS = 256, 4
#: Rows of the fit list whose products are added at once; sums beyond it go in two parts.
CHUNK, LIMB = 4096, 1 << 64
#: Results of the fit that describe a row.
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")

_REAL = np.longdouble
_EPS = np.finfo(_REAL).eps


def whole(vector: Column, scale: int = SCALE) -> Column:
    """The entries as whole numbers; null if the vector is dropped."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def ldlt(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Order, unit lower L and the blocks of D of a symmetric matrix, with the largest pivots first, of one row or of two."""
    a = np.array(a, _REAL)
    size = len(a)
    order, low, blocks, at = np.arange(size), np.eye(size, dtype=_REAL), [], 0
    while at < size:
        rest = np.abs(a[at:, at:])
        diagonal = rest.diagonal()
        one = int(np.argmax(diagonal))
        i, j = np.unravel_index(int(np.argmax(rest)), rest.shape)
        # The bound with which elements grow least.
        wide = size - at > 1 and diagonal[one] < (1 + np.sqrt(_REAL(17))) / 8 * rest[i, j]
        chosen = sorted((int(i), int(j))) if wide else [one]
        for put, take in enumerate(chosen):
            x, y = at + put, at + take
            for m in (a, a.T):
                m[[x, y]] = m[[y, x]]
            low[[x, y], :at] = low[[y, x], :at]
            order[[x, y]] = order[[y, x]]
        step = len(chosen)
        block, below = a[at : at + step, at : at + step].copy(), a[at + step :, at : at + step]
        blocks.append(block)
        if rest[i, j] > 0:
            factor = _divided(block, below.T).T
            low[at + step :, at : at + step] = factor
            a[at + step :, at + step :] -= factor @ below.T
        at += step
    return order, low, blocks


def _divided(block: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a block of one or two rows."""
    if len(block) == 1:
        return b / block[0, 0]
    (p, q), (_, r) = block
    return np.stack([r * b[0] - q * b[1], p * b[1] - q * b[0]]) / (p * r - q * q)


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of `v` are larger than `shift`."""
    _, _, blocks = ldlt(v - shift * np.eye(len(v), dtype=_REAL))
    # A block of two is taken only where its determinant is negative: one eigenvalue on each side.
    return sum(1 if len(b) == 2 else int(b[0, 0] > 0) for b in blocks)


def _solved(v: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(v - shift I) y = b; a shift at an eigenvalue is moved by a rounding step."""
    size = np.abs(v).max() * _EPS
    order, low, blocks = ldlt(v - shift * np.eye(len(v), dtype=_REAL))
    y = b[order].copy()
    for i in range(len(y)):
        y[i + 1 :] -= low[i + 1 :, i] * y[i]
    at = 0
    for block in blocks:
        if len(block) == 1 and abs(block[0, 0]) < size:
            block = np.array([[size]], _REAL)
        y[at : at + len(block)] = _divided(block, y[at : at + len(block)])
        at += len(block)
    for i in reversed(range(len(y))):
        y[i] -= low[i + 1 :, i] @ y[i + 1 :]
    out = np.empty_like(y)
    out[order] = y
    return out


def _apart(y: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """`y` of length one, at right angles to the vectors found."""
    for _ in range(2):
        for u in found:
            y = y - (u @ y) * u
    return y / np.sqrt(y @ y)


def leading(v: np.ndarray, number: int) -> tuple[list[float], list[np.ndarray]]:
    """The `number` largest eigenvalues of a symmetric matrix without negative ones, falling, and their unit vectors."""
    v = np.array(v, _REAL)
    trace, draw = np.trace(v), np.random.default_rng(3)
    least, values, vectors = trace * len(v) * np.finfo(float).eps, [], []
    if not len(v) or trace <= 0:
        return [], []
    tolerance = trace * len(v) * _EPS * 8
    while len(values) < min(number, above(v, least)):
        turn = len(values)  # eigenvalues above the one that is looked for
        low, high = least, trace * (1 + 8 * _EPS)
        while above(v, low) != turn + 1 and high - low > tolerance:
            middle = (low + high) / 2
            low, high = (middle, high) if above(v, middle) > turn else (low, middle)
        together = above(v, low) - turn
        while True:
            if together > 1 or high - low <= tolerance:  # a group that cannot be told apart, or one pinned by counts alone
                for _ in range(together):
                    y = _apart(draw.normal(size=len(v)).astype(_REAL), vectors)
                    for _ in range(3):
                        y = _apart(_solved(v, (low + high) / 2, y), vectors)
                    values.append(y @ v @ y)
                    vectors.append(y)
                break
            value, y = (low + high) / 2, _apart(draw.normal(size=len(v)).astype(_REAL), vectors)
            for _ in range(2):
                y = _apart(_solved(v, value, y), vectors)
            for _ in range(12):
                value, before = y @ v @ y, value
                if abs(value - before) <= tolerance / 8:
                    break
                y = _apart(_solved(v, value, y), vectors)
            if low < value <= high and above(v, value - tolerance) == turn + 1 and above(v, value + tolerance) == turn:
                values.append(value)
                vectors.append(y)
                break
            middle = (low + high) / 2
            low, high = (middle, high) if above(v, middle) > turn else (low, middle)
    return values[:number], vectors[:number]


@dataclass
class Whitening:
    """n rows, sums (whole numbers), components (rows), their eigenvalues, explained shares, and the error against the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers, centred, projected and scaled."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        left = (x - base).astype(float) - part if not len(x) or _within(x, base, 1 << 62) else (x.astype(object) - base.astype(object)).astype(float) - part
        return left @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S) squared, exact."""
        if not len(x):
            return []
        bound = self.n * int(max(x.max(), -int(x.min()), 1)) + max(map(abs, self.sums), default=0)
        exact = x if bound * bound * max(x.shape[1], 1) < 1 << 62 else x.astype(object)
        left = self.n * exact - np.array(self.sums, exact.dtype)
        return [int(d) for d in (left * left).sum(axis=1)]


def _within(x: np.ndarray, base: np.ndarray, bound: int) -> bool:
    return int(max(x.max(initial=0), -int(x.min(initial=0)))) + int(max(base.max(initial=0), -int(base.min(initial=0)))) < bound


def _products(base: list[int]):
    """Rows (i, j, high, low): sums of products of x - base over a task, in chunks; the value is high times LIMB plus low."""
    mean = np.array(base, np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.int64).reshape(-1, len(mean))
            for at in range(0, len(x), CHUNK):
                some = x[at : at + CHUNK]
                small = _within(some, mean, 1 << 62)
                left = some - mean if small else some.astype(object) - mean.astype(object)
                most = int(max(left.max(), -left.min())) ** 2 * len(left)
                left = left.astype(float) if most < 1 << 53 else left if most < 1 << 62 else left.astype(object)
                product = (left.T @ left).astype(np.int64 if most < 1 << 62 else object).astype(object)
                total = product if total is None else total + product
        if total is not None:
            i, j = np.triu_indices(len(mean))
            parts = [divmod(int(v), LIMB) for v in total[i, j]]
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "high": [str(h) for h, _ in parts], "low": [str(w) for _, w in parts]})

    return add


def _moments(fitted: Whitening):
    """Rows (i, j, v): sums and sums of products of whitened rows over a task; j is -1 for the sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, k = len(fitted.sums), len(fitted.values)
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = fitted.whitened(np.asarray(batch.column("x").flatten(), np.int64).reshape(-1, dim))
            first += w.sum(axis=0)
            second += w.T @ w
        i, j = (m.ravel() for m in np.indices((k, k)))
        yield pa.RecordBatch.from_pydict({"i": pa.array([*range(k), *i], pa.int32()), "j": pa.array([*[-1] * k, *j], pa.int32()), "v": [*first, *second.ravel()]})

    return add


def fit(x: DataFrame, number: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list `x` (distinct vectors of whole numbers of one length); none of an empty list."""
    n = x.count()
    if not n:
        return None
    each = x.select(F.posexplode("x").alias("i", "v"))
    sums = [int(r.s) for r in each.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()]  # one row a dimension
    dim = len(sums)
    if not dim:
        return Whitening(n, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    base = [s // n for s in sums]
    added = x.mapInArrow(_products(base), "i int, j int, high string, low string").groupBy("i", "j").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    rest = [s % n for s in sums]
    v = np.zeros((dim, dim), _REAL)
    for i, j, high, low in added.collect():  # one row a pair of dimensions
        # Two doubles hold what one would round off.
        exact = Fraction((int(high) * LIMB + int(low)) * n - rest[i] * rest[j], n * n)
        head = float(exact)
        v[i, j] = v[j, i] = _REAL(head) + _REAL(float(exact - Fraction(head)))
    values, vectors = leading(v, number)
    trace = float(np.trace(v))
    fitted = Whitening(n, sums, np.array(vectors, float).reshape(len(vectors), dim), np.array(values, float), np.array(values, float) / trace if trace else np.zeros(0))
    got = x.mapInArrow(_moments(fitted), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = len(values)
    first, second = np.zeros(k), np.zeros((k, k))
    for i, j, total in got:
        (first if j < 0 else second[i])[i if j < 0 else j] = total / n
    fitted.identity_error = float(np.abs(second - np.outer(first, first) - np.eye(k)).max(initial=0.0))
    return fitted


def whiten(table: DataFrame, number: int = COMPONENTS, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows of `table` that remain, without the vector, once for each component, with RESULTS; deviation is a decimal."""
    rows = table.drop(*(c for c in ("__x", "__r", "__d", "__i", "__w", *RESULTS) if c != vector)).withColumn("__x", whole(F.col(vector), scale)).drop(vector).where("__x IS NOT NULL")
    rows = materialize(rows)
    kept = rows.columns
    lengths = rows.groupBy(F.size("__x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    fitted = None
    if lengths is not None:
        rows = rows.where(F.size("__x") == lengths.dim)
        fitted = fit(materialize(rows.select(F.col("__x").alias("x")).distinct()), number)
    if fitted is None:
        fitted = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))

    @F.pandas_udf("w array<double>, d string")
    def results(values: pd.Series) -> pd.DataFrame:
        x = np.array(values.tolist(), np.int64).reshape(len(values), -1)
        return pd.DataFrame({"w": list(fitted.whitened(x)), "d": [str(d) for d in fitted.deviations(x)]})

    shares = F.array(*map(F.lit, fitted.explained.tolist())).cast("array<double>")
    if len(fitted.values):
        each = rows.withColumn("__r", results(F.col("__x"))).select(*kept, F.col("__r.d").alias("__d"), F.posexplode("__r.w").alias("__i", "__w"))
    else:
        each = rows.limit(0).select(*kept, F.lit("0").alias("__d"), F.lit(0).alias("__i"), F.lit(0.0).alias("__w"))
    return each.select(
        *(c for c in kept if c != "__x"), (F.col("__i") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), F.col("__d").try_cast("decimal(38,0)").alias("deviation"),
        F.col("__w").alias("whitened"), F.try_element_at(shares, F.col("__i") + 1).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )
