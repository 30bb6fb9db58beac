"""SimHash near-duplicates by ball hashing: fingerprints meet halfway, on variants within half the radius.

Two fingerprints within RADIUS differing bits have a half (32 of 64 bits) in which at most RADIUS // 2 bits differ. Every
fingerprint emits, for each half, all variants of it within RADIUS // 2 flips; a variant that is the exact half of another
fingerprint makes a colliding pair, which the whole fingerprints confirm. Equal fingerprints are one from the start.

Buckets that would make more than PAIRS pairs take a second exact way, linear in their members: their fingerprints emit
variants of the whole 64 bits, within RADIUS // 2 flips (near), and for an odd radius, from fingerprints of even parity,
with (RADIUS + 1) // 2 flips in one half (far). Two fingerprints at an odd distance have different parity, and of the
differing bits (RADIUS + 1) // 2 lie in one half, so each linked pair still shares a variant. All fingerprints at a variant
lie within the radius of any near one, so links to the smallest near one join them all: no pairs within a group, and no
group is larger than a ball.

Links become components by alternating large and small stars, written to the shared folder after each round.

A word is a run of anything but ASCII white space, A-Z lower-cased; a shingle is three words, joined by one space, repeats
included. A bit is set if over half the hashes have it. Defined results: a text of one or two words has one shingle,
all of it; a null, empty or blank text has fingerprint zero, linked like any other; a null id takes no part in a component's
smallest id, which is null only if every id is; repeated rows are equal documents; an empty table gives an empty table;
input columns named as results are replaced.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saidso.session import materialize

RADIUS = 3
SEED = 42
#: Pairs that a bucket may make before it takes the linear way.
PAIRS = 16
#: Hashes whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - 2)
    counts = sum(np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), BLOCK))
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return of(text)


def _longs(masks: list[int]) -> Column:
    signed = (m - (1 << 64) if m >> 63 else m for m in masks)
    return F.expr("array(" + ", ".join("-9223372036854775807L - 1L" if m == -(1 << 63) else f"{m}L" for m in signed) + ")")


def _masks(bits: range, flips: range) -> list[int]:
    return [sum(1 << b for b in chosen) for n in flips for chosen in combinations(bits, n)]


def _xor(value: str, masks: list[int]) -> Column:
    return F.transform(_longs(masks), lambda m: F.col(value).bitwiseXOR(m))


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input. The planner takes what an explode makes for as small as what it was made
    from, and would send millions of variants through the driver; sorted and merged, neither side is broadcast."""
    return left.join(right.hint("merge"), on, how)


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, between the distinct `fp` values within `radius`: enough of them to join all that are linked."""
    sides = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32)))
    exact = fingerprints.select("fp", F.explode(sides).alias("key"))
    held = exact.groupBy("key").agg(F.count("*").alias("n_exact"))
    variants = exact.select("fp", F.col("key").alias("own"), F.explode(_xor("key", _masks(range(32), range(radius // 2 + 1)))).alias("key"))
    met = merged(variants, held, "key").where((F.col("key") != F.col("own")) | (F.col("n_exact") > 1)).select("key", "fp", "n_exact")
    met = materialize(met)
    sizes = materialize(met.groupBy("key").agg((F.count("*") * F.max("n_exact")).alias("pairs")))

    small = sizes.where(F.col("pairs") <= PAIRS).select("key")
    pairs = merged(merged(met.select("key", "fp"), small, "key"), exact.withColumnRenamed("fp", "other"), "key")
    close = pairs.where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
    direct = close.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))

    large = sizes.where(F.col("pairs") > PAIRS).select("key")
    crowded = merged(met.select("key", "fp").unionByName(exact.select("key", "fp")), large, "key").select("fp").distinct()
    return materialize(direct.unionByName(stars(materialize(crowded), radius)).distinct())


def stars(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, by variants of all 64 bits: each fingerprint at a variant to the smallest near one there."""
    near = fingerprints.select("fp", F.explode(_xor("fp", _masks(range(64), range(radius // 2 + 1)))).alias("z"), F.lit(True).alias("near"))
    if radius % 2:
        flips = range((radius + 1) // 2, (radius + 1) // 2 + 1)
        even = fingerprints.where(F.bit_count("fp") % 2 == 0)
        far = even.select("fp", F.explode(_xor("fp", _masks(range(32), flips) + _masks(range(32, 64), flips))).alias("z"), F.lit(False).alias("near"))
        near = near.unionByName(far)
    at = near.groupBy("z").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.collect_list("fp").alias("fps"))
    spokes = at.where(F.col("hub").isNotNull() & (F.size("fps") > 1)).select("hub", F.explode("fps").alias("fp")).where("hub != fp")
    return spokes.select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")).distinct()


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """`edges` with the `m` of their `a`; the second key makes the planner deal both sides anew, so that it can split a hub."""
    return merged(edges.withColumn("_k", F.xxhash64("a")), least.withColumn("_k", F.xxhash64("a")), ["_k", "a"]).drop("_k")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the smallest node of its component."""
    checked = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, checked(edges)
    while before != now:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _with_least(both, least).where("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, checked(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without its text, with fp (signed 64-bit fingerprint), text_key, component (the smallest fingerprint reachable) and
    component_id (the smallest id reachable)."""
    read = docs.drop(*(c for c in ("fp", "text_key", "component", "component_id", "_k", "_id") if c not in (doc_id, text)))
    marked = materialize(read.withColumns({"fp": fingerprint(F.col(text)), "text_key": F.xxhash64(text)}).drop(text))
    nodes = materialize(marked.groupBy("fp").agg(F.min(doc_id).alias("_id")))
    return labelled(marked, nodes, materialize(components(links(nodes.select("fp"), radius))))


def labelled(marked: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """`marked` (fp and more) with component, the label of its fp in `labels` (node, label), and component_id, the smallest `_id` of
    `nodes` (fp, _id) there. Two components may have one smallest id, as ids may repeat, or none."""
    named = merged(labels, nodes, labels["node"] == nodes["fp"]).select("node", "label", "_id")
    # Keys repeated as a hash are dealt out anew, so that a component or fingerprint with many rows can be split.
    smallest = named.groupBy("label").agg(F.min("_id").alias("component_id")).withColumn("_k", F.xxhash64("label"))
    joined = merged(named.withColumn("_k", F.xxhash64("label")), smallest, ["_k", "label"]).select(F.col("node").alias("fp"), F.col("label").alias("component"), "component_id")
    alone = merged(nodes, labels, nodes["fp"] == labels["node"], "left_anti").select("fp", F.col("fp").alias("component"), F.col("_id").alias("component_id"))
    every = materialize(joined.unionByName(alone)).withColumn("_k", F.xxhash64("fp"))
    return merged(marked.withColumn("_k", F.xxhash64("fp")), every, ["_k", "fp"]).drop("_k")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stay: of each component the document with the smallest id, one row of it."""
    return first_of(docs, materialize(near_duplicates(docs.select("doc_id", "text"), radius)))


def first_of(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of `docs` that stay by `grouped` (doc_id, text_key, component): one row of each component's smallest id."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = grouped.groupBy("component").agg(F.min(order).alias("k"))
    stay = first.select(F.col("k.doc_id").alias("__near_id"), F.col("k.text_key").alias("__near_key")).distinct()
    times = grouped.groupBy("doc_id", "text_key").agg(F.count("*").alias("__near_n"))
    stay = materialize(stay.join(times, F.col("__near_id").eqNullSafe(F.col("doc_id")) & (F.col("__near_key") == F.col("text_key"))).select("__near_id", "__near_key", "__near_n"))
    same = docs["doc_id"].eqNullSafe(F.col("__near_id")) & (F.xxhash64(docs["text"]) == F.col("__near_key"))
    single = docs.join(stay.where("__near_n = 1"), same, "left_semi")
    again = docs.join(stay.where("__near_n > 1"), same).drop("__near_n").dropDuplicates(["__near_id", "__near_key"]).drop("__near_id", "__near_key")
    return single.unionByName(again)
