"""Unicode compatibility folding, the one text step Spark has no function for.

Only values outside ASCII are handed to ICU, which comes with Spark; it is called in the JVM, so no row travels to Python and no
stage keeps Python workers for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ICU = "com.ibm.icu.text.Normalizer"


def _by_icu(s: Column, method: str) -> Column:
    # The last argument asks for compatibility forms.
    folded = F.reflect(F.lit(_ICU), F.lit(method), s, F.lit(True))
    return F.when(s.rlike(r"[^\x{00}-\x{7F}]"), folded).otherwise(s)


def nfkd(s: Column) -> Column:
    return _by_icu(s, "decompose")


def nfkc(s: Column) -> Column:
    return _by_icu(s, "compose")


def fold(s: Column) -> Column:
    """Accents dropped, lower case, straight apostrophes."""
    return F.regexp_replace(F.lower(F.regexp_replace(nfkd(s), r"\p{M}", "")), "[‘’ʼ]", "'")
