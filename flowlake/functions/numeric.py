"""Numeric helpers that must agree bit for bit with NumPy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(col, ndigits: int = 0) -> Column:
    """NumPy's ``round``: scale, round half to even, scale back.

    Spark's ``round``/``bround`` round the decimal text of a double, which
    differs from NumPy on values such as 1706595038.70515."""
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** ndigits)
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale)
