r"""The elements of JSON arrays in large files, by many tasks a file.

A file is read in pieces that end at a closing brace, so Spark can split it anywhere, and the pieces of a split are put together to
chunks, which are stored once, compressed. Whether a chunk starts inside a string is the parity of the quotes before it, and how deep
it starts is a sum over the chunks before it; both are taken from a few numbers a chunk. A brace that closes an element leaves the
depth of the array. With that, every chunk is cut by itself: no text is shuffled but the two ends of a chunk, which are joined to
the ends beside them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saidso.operators.layout import in_order
from saidso.session import materialize

#: Characters of a chunk, about, and bytes of a file whose chunks are summed up in one block.
CHUNK, BLOCK_BYTES = 1 << 18, 1 << 30
_ESCAPED = re.compile(rb"\\.", re.S)
_CHUNK = "file string, at long, text string, head string, tail string, quotes long, out long, within long"
_PART = "file string, n long, ended int, text string"


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: how many quotes stand up to it, escaped ones left out, and whether it opens (1) or closes (-1) something."""
    a = np.frombuffer(_ESCAPED.sub(b"  ", text), np.uint8)
    return np.cumsum(a == 34), ((a == 123) | (a == 91)).astype(np.int64) - ((a == 125) | (a == 93))


def _chunk(file: str, at: int, held: list[str]) -> tuple:
    text = "}".join(held) + "}"
    quotes, step = _marks(text.encode())
    inside = quotes % 2 == 1
    return file, at, text, held[0] + "}", held[-1], int(quotes[-1]), int(step[~inside].sum()), int(step[inside].sum())


def _chunked(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces (file, start, value) of splits, in order, to chunks; `out` and `within`: how much deeper a chunk ends than it starts,
    if it starts outside of a string or in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in (x.split() for x in _CHUNK.split(", "))])
        of, at, held, room = None, 0, [], size
        for batch in batches:
            rows, out = zip(*(c.to_pylist() for c in batch.columns)), []
            for key, some in groupby(rows, lambda r: r[:2]):
                if key != of:
                    if held:
                        out.append(_chunk(of[0], at, held))
                    # A piece has at least a byte, its brace, so start plus number grows through a file.
                    of, at, held, room = key, key[1], [], size
                for _, _, value in some:
                    held.append(value)
                    room -= len(value) + 1
                    if room <= 0:
                        out.append(_chunk(of[0], at, held))
                        at, held, room = at + len(held), [], size
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, _chunk(of[0], at, held)))], schema)

    return run


def _cut(edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks (file, at, text, inside, depth, deep) to the elements that lie within one, or with `edges` to what is left of a chunk:
    up to its first end of an element and after its last. `n` orders the parts of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, text, inside, depth, deep in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                quotes, step = _marks(raw)
                outside = (quotes + inside) % 2 == 0
                step *= outside
                brace = np.frombuffer(raw, np.uint8) == 125
                ends = np.nonzero(brace & (step < 0) & (np.cumsum(step) + depth == deep))[0] + 1
                places = at + np.cumsum(brace)
                if edges:
                    parts = [(0, int(ends[0]), 1)] if len(ends) else []
                    left = int(ends[-1]) if len(ends) else 0
                    parts += [(left, len(raw), 0)] if left < len(raw) else []
                else:
                    parts = [(a, b, 1) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * len(parts), pa.string()), pa.array([int(places[b - 1]) for _, b, _ in parts], pa.int64()),
                            pa.array([e for _, _, e in parts], pa.int32()), pa.array([raw[a:b].decode() for a, b, _ in parts], pa.string()),
                        ],
                        ["file", "n", "ended", "text"],
                    )

    return run


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, file, at, text, head, tail, ...): the files of `path` in chunks; `at` orders the chunks of a file."""
    rows = spark.read.option("lineSep", "}").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    cut = rows.mapInArrow(_chunked(CHUNK), _CHUNK).withColumn("chunk", F.monotonically_increasing_id())
    # Small row groups: a reader holds many rows of one at a time.
    return materialize(cut, compression="zstd", **{"parquet.block.size": str(1 << 24)})


def elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, n, json): the objects of each file's array, `n` in their order; and (file, listed, head, tail, some): whether the file
    is a bare list, what stands before and after its array, and whether it has elements. The array is the file itself, or one in
    the object that the file is."""
    cut = chunks(spark, path)
    begin = cut.groupBy("file").agg(F.min_by("head", "at").alias("head"), F.max_by("tail", "at").alias("tail"), F.max("at").alias("last"))
    # A byte-order mark or blanks may stand before the list.
    begin = materialize(begin.withColumn("listed", F.col("head").rlike(r"^[\s\x{FEFF}]*\[")))
    at = in_order(cut.select("chunk", "file", "at", "quotes", "out", "within"), ["file"], "at", running={"before": F.col("quotes")}, block=BLOCK_BYTES)
    inside = F.col("before") % 2 == 1
    at = in_order(at, ["file"], "at", running={"depth": F.when(inside, F.col("within")).otherwise(F.col("out"))}, block=BLOCK_BYTES)
    known = at.join(begin.select("file", "listed", "last"), "file")
    known = materialize(known.select("chunk", inside.cast("int").alias("inside"), "depth", F.when(F.col("listed"), 1).otherwise(2).alias("deep"), (F.col("at") == F.col("last")).alias("_last")), plain=True)
    # What follows the last brace of a file, or that brace, ends no element.
    text = F.when(F.col("_last"), F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    placed = cut.select("chunk", "file", "at", "text").join(known, "chunk").select("file", "at", text.alias("text"), "inside", "depth", "deep").where("text <> ''")
    edges = materialize(placed.mapInArrow(_cut(True), _PART))
    numbered = in_order(edges, ["file"], "n", running={"g": F.col("ended")}, block=BLOCK_BYTES)
    joined = numbered.groupBy("file", "g").agg(F.max("n").alias("n"), F.max("ended").alias("ended"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("text"))
    lead = F.when(F.col("g") == 0, F.regexp_replace("text", r"(?s)^[^\[]*\[\s*", "")).otherwise(F.regexp_replace("text", r"(?s)^[\s,]*", ""))
    joined = joined.where("ended = 1").select("file", "n", lead.alias("json"))
    whole = placed.mapInArrow(_cut(False), _PART).select("file", "n", F.regexp_replace("text", r"(?s)^[\s,]*", "").alias("json"))
    # The first element of a file ends at the edge of a chunk.
    some = edges.where("ended = 1").select("file").distinct().withColumn("some", F.lit(True))
    files = begin.join(some, "file", "left").select("file", "listed", "head", "tail", F.coalesce("some", F.lit(False)).alias("some"))
    return whole.unionByName(joined), files
