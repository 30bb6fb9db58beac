"""Bind an expression once and use it many times.

A one-element transform evaluates `value` a single time, where plain reuse would
copy the whole expression into every place it is mentioned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)
