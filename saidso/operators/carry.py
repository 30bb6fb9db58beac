"""Reading in order, by many tasks at once.

Some readers need to know where the reader before them stopped: the window that follows the last one, the last two lines that
were kept. A sequence is cut into blocks and every block is read from a guessed state. Then each block is given the state its
predecessor really ended in, and only blocks whose state was guessed wrong are read again, until none is. Readers of texts fall
in step after a few lines whatever they began with, so two or three rounds do; in the worst case a round settles one block more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saidso.session import materialize


def entry_states(blocks: DataFrame, key: str, guess: Column, leaves: Callable[[Column], Column]) -> DataFrame:
    """(key, block, entry): the state each block of `blocks` (key, block, ...) is entered in.

    `leaves(entry)` is the state a block leaves behind, as an expression over its columns; `guess` is the state assumed before
    anything is known, and the state of a first block.
    """
    order = W.partitionBy(key).orderBy("block")
    first = F.row_number().over(order) == 1
    now = materialize(blocks.withColumn("entry", guess).select(key, "block", "entry", leaves(F.col("entry")).alias("exit"), guess.alias("start")))
    while True:
        due = now.select(key, "block", "entry", "exit", "start", F.when(first, F.col("start")).otherwise(F.lag("exit").over(order)).alias("due"))
        due = materialize(due)
        wrong = due.where(~F.col("due").eqNullSafe(F.col("entry"))).select(key, "block", F.col("due").alias("entry"))
        if wrong.isEmpty():
            return now.select(key, "block", "entry")
        again = blocks.join(wrong, [key, "block"]).select(key, "block", "entry", leaves(F.col("entry")).alias("exit"))
        right = due.where(F.col("due").eqNullSafe(F.col("entry"))).select(key, "block", "entry", "exit", "start")
        now = materialize(right.unionByName(again.join(due.select(key, "block", "start"), [key, "block"])))
