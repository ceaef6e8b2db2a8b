"""Sides of joins that every task gets, behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that every task gets: words, phrases and pairs of them, far below a megabyte.
FEW = 4096
#: Entries of sparse vectors that every task gets, some ten megabytes.
FEW_ENTRIES = 1 << 17


def is_few(df: DataFrame, most: int | None = None) -> bool:
    """Whether there are at most ``most`` rows, FEW if not given."""
    most = FEW if most is None else most
    return df.limit(most + 1).count() <= most


def held(df: DataFrame, most: int | None = None) -> DataFrame:
    """The rows with a hint to broadcast where they are few; more are left to a join by shuffle."""
    return F.broadcast(df) if is_few(df, most) else df
