"""A bounded sample of rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 1 << 30


def smallest_hashes(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """The `size` rows with the smallest hashes of `keys` (all, if there are fewer), in that order.

    Rows far above where the last of them is expected are left out before sorting, so that what tasks send on stays near
    `size` however many tasks there are.
    """
    number = F.pmod(F.xxhash64(*keys), F.lit(RANGE))
    bound = RANGE * min(1.0, (3 * size + 100) / max(rows.count(), 1))
    return rows.withColumn("_sample", number).where(F.col("_sample") <= int(bound)).orderBy("_sample", *keys).limit(size).drop("_sample")
