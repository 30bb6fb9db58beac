"""Exact top-k search by distributed histogram selection.

Queries go in blocks, a bounded wave of blocks at a time, past all candidates. Each pass scores everything and adds up, per
query, a histogram of the scores in the interval that holds its kth value; the next pass looks into the bin found, until a
bin is one score wide. A last pass keeps what reaches the kth value and breaks ties by the smaller id. A task reports
bins from the top only until it has seen enough for the kth value, and among ties its k smallest ids: neither can lose a
result, since the kth value overall is no lower than a task's own.

Vectors are whole numbers, floor(SCALE * component); scores are exact (floating point only where every sum is below 2**53,
beyond that whole numbers, held within +-2**62). Defined results: vectors that are null or hold null, NaN or infinite
components take no part, nor do null ids; only vectors of equal length are compared; rows that share an id are all its
own; a query id given twice is asked once, with the smaller vector; a query without candidates has no rows; empty
tables give an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saidso.session import materialize

SCALE = 1024
BINS = 4096
#: Queries of a block, and blocks that are broadcast at once.
BLOCK, WAVE = 256, 8
#: Candidates of a chunk.
CHUNK = 4096
EDGE = 1 << 62


def whole(vector: Column, scale: int = SCALE) -> Column:
    """The components as whole numbers; null if the vector takes no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def vectors(table: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v and dim of the rows that take part."""
    return table.select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(vector), scale).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v"))


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of one task and dimension packed together: dim, ids and the matrix, as bytes of whole numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()):
                part = batch.filter(pc.equal(batch.column("dim"), int(dim)))
                for at in range(0, part.num_rows, size):
                    some = part.slice(at, size)
                    flat = some.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i8")
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [some.column("vec_id").to_numpy().astype("<i8").tobytes()], "matrix": [flat.tobytes()]})

    return rows.select("vec_id", "v", "dim").mapInArrow(pack, "dim int, ids binary, matrix binary")


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of `left` and `right`."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    most = int(max(left.max(), -int(left.min()))) * int(max(right.max(), -int(right.min()))) * left.shape[1]
    if most < 1 << 53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    if most < EDGE:
        return left @ right.T
    return np.clip(left.astype(object) @ right.astype(object).T, 2048 - EDGE, EDGE - 2048).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each chunk and block: the queries' ids, bounds and needs, the candidates' ids, and scores with the own ones masked."""
    for batch in batches:
        for row in batch.to_pylist():
            dim, ids, queries = row["dim"], _ints(row["ids"]), _ints(row["q_ids"])
            scores = _scores(_ints(row["q_matrix"]).reshape(len(queries), dim), _ints(row["matrix"]).reshape(len(ids), dim))
            bounds = {c: _ints(row[c]) for c in ("low", "span", "width", "need")}
            yield queries, bounds, ids, scores, queries[:, None] != ids[None, :]


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per query and bin of the whole task, from the top until the query's need is met."""
    totals: dict[bytes, list] = {}
    for queries, bounds, _, scores, other in _pairs(batches):
        low = bounds["low"]
        held = totals.setdefault(queries.tobytes(), [queries, bounds["need"], np.zeros((len(queries), BINS), np.int64)])[2]
        inside = other & (scores >= low[:, None]) & (scores < (low + bounds["span"])[:, None])
        bins = np.where(inside, scores, low[:, None]) - low[:, None]
        bins //= bounds["width"][:, None]
        row, column = np.nonzero(inside)
        held += np.bincount(row * BINS + bins[row, column], minlength=held.size).reshape(held.shape)
    for queries, need, held in totals.values():
        above = np.cumsum(held[:, ::-1], axis=1)[:, ::-1] - held
        row, column = np.nonzero((held > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_pydict({"query_id": queries[row], "bin": column.astype(np.int32), "n": held[row, column]})


def _best(k: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What lies above each kth value, and the k smallest ids of a chunk at it."""
        for queries, bounds, ids, scores, other in _pairs(batches):
            row, column = np.nonzero(other & (scores >= bounds["low"][:, None]))
            score, vec = scores[row, column], ids[column]
            order = np.lexsort((vec, -score, row))
            row, score, vec = row[order], score[order], vec[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            few = place < k
            found = {"query_id": queries[row[few]], "vec_id": vec[few], "score": score[few]}
            yield pa.RecordBatch.from_pydict(found)

    return keep


def _blocks(queries: DataFrame, waves: int, k: int) -> DataFrame:
    """Queries with their first interval (every score they can have), dealt to waves and blocks by a hash of their id."""
    most = F.greatest(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0))
    return queries.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(waves * WAVE)).cast("int"), "most": F.coalesce(most, F.lit(0)), "need": F.lit(k).cast("long")})


def _packed(block: DataFrame) -> DataFrame:
    """One row per block and dimension, its queries' numbers as bytes."""
    rows = block.groupBy("block", "dim").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v", "low", "span", "width", "need"))).alias("q"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = row["q"]
                raw = {c: np.array([x[c] for x in q], "<i8").tobytes() for c in ("vec_id", "low", "span", "width", "need")}
                matrix = np.array([x["v"] for x in q], "<i8").tobytes()
                yield pa.RecordBatch.from_pydict({"dim": pa.array([row["dim"]], pa.int32()), "q_ids": [raw["vec_id"]], "q_matrix": [matrix], "low": [raw["low"]], "span": [raw["span"]], "width": [raw["width"]], "need": [raw["need"]]})

    return rows.select("dim", "q").mapInArrow(pack, "dim int, q_ids binary, q_matrix binary, low binary, span binary, width binary, need binary")


def _refined(state: DataFrame, met: DataFrame) -> DataFrame:
    """The interval of each query's kth value after a pass: the bin that holds it, cut into bins."""
    counts = met.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = counts.withColumn("down", F.sum("n").over(down)).join(state.select(F.col("vec_id").alias("query_id"), F.col("need").alias("k")), "query_id")
    hit = joined.where("down >= k AND down - n < k").select(F.col("query_id").alias("vec_id"), "bin", (F.col("k") - F.col("down") + F.col("n")).alias("left"))
    found = state.join(hit, "vec_id", "left")
    # Without a hit the query has fewer than k candidates: all of them reach its lowest score, and it looks no further.
    low = F.when(F.col("bin").isNotNull(), F.col("low") + F.col("bin") * F.col("width")).otherwise(F.col("low"))
    width = F.when(F.col("bin").isNotNull(), F.ceil(F.col("width") / BINS).cast("long")).otherwise(F.lit(1).cast("long"))
    need = F.when(F.col("bin").isNotNull(), F.col("left")).otherwise(F.col("need"))
    done = (F.col("width") == 1) | F.col("bin").isNull()
    return found.select("vec_id", "v", "dim", "block", low.alias("low"), F.when(F.col("bin").isNotNull(), F.col("width")).otherwise(F.lit(0).cast("long")).alias("span"), F.when(done, F.lit(1).cast("long")).otherwise(width).alias("width"), need.alias("need"), done.alias("done"))


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of `table` for every row of `queries`, ties to the smaller id."""
    every = vectors(table, vec_id, vector, scale)
    asked = materialize(vectors(queries, vec_id, vector, scale).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    packed = materialize(chunks(every))
    largest = every.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0
    waves = -(-asked.count() // (BLOCK * WAVE)) or 1
    blocks = _blocks(asked, waves, k)
    # Whole numbers of more than 64 bits are held at the edge, as the scores are.
    reach = F.least(F.col("most").cast("decimal(38,0)").cast("double") * F.greatest("dim", F.lit(1)) * float(largest), F.lit(float(EDGE - 1024))).cast("long")
    blocks = materialize(blocks.withColumn("reach", reach + 1).withColumns({"low": -F.col("reach"), "width": F.floor(F.col("reach") / (BINS // 2)) + 1}).withColumn("span", 2 * F.col("reach") + 1).drop("most", "reach"))
    rows = None
    for wave in range(waves):
        state = blocks.where(F.floor(F.col("block") / WAVE) == wave).withColumn("done", F.lit(False))
        while state.where("NOT done").limit(1).count():
            state = materialize(_refined(state, _met(packed, state).mapInArrow(_histograms, "query_id bigint, bin int, n bigint")))
        reached = materialize(_met(packed, state).mapInArrow(_best(k), "query_id bigint, vec_id bigint, score bigint"))
        rows = reached if rows is None else rows.unionByName(reached)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(packed: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks beside every block of the wave; a wave is at most WAVE blocks of about BLOCK queries."""
    return packed.join(F.broadcast(_packed(state)), "dim")
