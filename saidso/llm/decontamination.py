"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

An item counts as contained in a document if at least THRESHOLD of the item's distinct shingles occur in it. Items are
partitioned by their number of distinct shingles into classes of doubling size. A class of sizes up to U keeps the
U - ceil(t U) + 1 smallest hashes (minima of one hash permutation) of each of its items: a document that contains the item
can miss at most U - ceil(t U) of its shingles, so it must hold one of these minima. Every document within the threshold is
thus a candidate, at any document length; there is no chance of a miss. Candidates are verified on the shingles' text.

Documents stream past the sketch: their shingle hashes are looked up, never stored or shuffled unless the sketch is too
large to broadcast, which the planner decides from its written size. Text moves only for candidates.

Words are runs of letters and digits, lower-cased. A shingle is SHINGLE words; an item of fewer words is one shingle of
all its words. Defined results: null or empty texts and items without words match nothing; an item given twice
under one id is one item, whose texts each match; rows with equal id and text are one document, null ids are ids; empty
tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saidso.session import materialize

SHINGLE = 5
#: Four fifths, kept as a fraction so that no rounding decides.
THRESHOLD = (4, 5)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(tokens: Column, n: Column) -> Column:
    return F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))


def hashes(tokens: Column, n: Column) -> Column:
    """A 64-bit hash of every run of n words."""
    return F.transform(_starts(tokens, n), lambda i: F.xxhash64(F.slice(tokens, i, n)))


def shingles(tokens: Column, n: Column) -> Column:
    return F.transform(_starts(tokens, n), lambda i: F.array_join(F.slice(tokens, i, n), " "))


def needed(size: Column, threshold: tuple[int, int]) -> Column:
    """The least number of `size` shingles that reaches the threshold."""
    over, under = threshold
    return F.floor((size * over + under - 1) / under).cast("int")


def item_table(items: DataFrame, item_id: str = "item_id", shingle: int = SHINGLE) -> DataFrame:
    """item_id, run (words a shingle has), tokens, and size (distinct shingles) of every item that has words."""
    tokens = items.select(F.col(item_id).alias("item_id"), words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0).distinct()
    tokens = tokens.withColumn("run", F.least(F.lit(shingle), F.size("tokens")))
    return tokens.withColumn("size", F.size(F.array_distinct(shingles(F.col("tokens"), F.col("run")))))


def sketches(items: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The smallest hashes of each item, as many as its size class asks for: run, hash."""
    bound = F.pow(F.lit(2), F.ceil(F.log2("size"))).cast("int")
    minima = F.slice(F.array_sort(F.array_distinct(hashes(F.col("tokens"), F.col("run")))), 1, bound - needed(bound, threshold) + 1)
    return items.select("run", F.explode(minima).alias("hash")).distinct()


def contained(docs: DataFrame, items: DataFrame, item_id: str = "item_id", threshold: tuple[int, int] = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row per document and item within the threshold: doc_id, text_key, item_id, n_shingles, n_found, containment."""
    listed = materialize(item_table(items, item_id, shingle))
    sketch = materialize(sketches(listed, threshold))
    runs = sorted(r.run for r in listed.select("run").distinct().collect())  # at most `shingle` values
    texts = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    tokens = texts.select("doc_id", "text_key", words(F.col("text")).alias("tokens"))
    met = None
    for run in runs:
        hashed = tokens.select("doc_id", "text_key", F.explode(hashes(F.col("tokens"), F.lit(run))).alias("hash"))
        some = hashed.join(sketch.where(F.col("run") == run), "hash", "left_semi").select("doc_id", "text_key")
        met = some if met is None else met.unionByName(some)
    if met is None:
        met = texts.where("false").select("doc_id", "text_key")
    candidates = materialize(met.distinct())
    return verified(texts, candidates, listed, runs, threshold)


def verified(texts: DataFrame, candidates: DataFrame, listed: DataFrame, runs: list[int], threshold: tuple[int, int]) -> DataFrame:
    """The exact containment of every item in the candidate documents, where it reaches the threshold."""
    named = candidates.select(F.col("doc_id").alias("__leak_id"), F.col("text_key").alias("__leak_key"))
    chosen = texts.join(named, F.col("doc_id").eqNullSafe(F.col("__leak_id")) & (F.col("text_key") == F.col("__leak_key")), "left_semi")
    tokens = chosen.select("doc_id", "text_key", words(F.col("text")).alias("tokens"))
    lists = [_with_run(F.array_distinct(shingles(F.col("tokens"), F.lit(r))), r) for r in runs]
    if not lists:
        lists = [F.expr("cast(array() as array<struct<run:int,shingle:string>>)")]
    held = tokens.select("doc_id", "text_key", F.inline(F.concat(*lists)))
    parts = listed.withColumn("item_key", F.xxhash64("tokens")).select("item_id", "item_key", "run", "size", F.explode(F.array_distinct(shingles(F.col("tokens"), F.col("run")))).alias("shingle"))
    counts = held.join(parts, ["run", "shingle"]).groupBy("doc_id", "text_key", "item_id", "item_key", "size").agg(F.count_distinct("shingle").alias("n_found"))
    reached = counts.where(F.col("n_found") >= needed(F.col("size"), threshold))
    best = reached.groupBy("doc_id", "text_key", "item_id").agg(F.max_by(F.struct("size", "n_found"), F.struct(F.col("n_found") / F.col("size"), F.col("size"))).alias("b"))
    return best.select("doc_id", "text_key", "item_id", F.col("b.size").alias("n_shingles"), F.col("b.n_found").cast("int").alias("n_found"), (F.col("b.n_found") / F.col("b.size")).alias("containment"))


def _with_run(texts: Column, run: int) -> Column:
    return F.transform(texts, lambda s: F.struct(F.lit(run).alias("run"), s.alias("shingle")))


def without_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """The documents that contain no item."""
    leaks = materialize(contained(docs, items, item_id).select(F.col("doc_id").alias("__leak_id"), F.col("text_key").alias("__leak_key")).distinct())
    return docs.join(leaks, docs["doc_id"].eqNullSafe(F.col("__leak_id")) & (F.xxhash64(docs["text"]) == F.col("__leak_key")), "left_anti")
