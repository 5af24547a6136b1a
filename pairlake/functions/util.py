from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def round_array(c, digits: int = 6) -> Column:
    return F.transform(col(c), lambda v: F.round(v, digits))


def as_double_array(c) -> Column:
    return col(c).cast("array<double>")
