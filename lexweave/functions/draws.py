"""Chance decided by a hash of the item, so that a retried task and another engine draw the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = 1_000_000


def order_of(*parts: Column | str, seed: int = 1) -> Column:
    """A text to sort by, the same for the same parts and seed."""
    return F.md5(F.concat_ws("\x01", F.lit(str(seed)), *parts))


def drawn(share: float, *parts: Column | str, seed: int = 1) -> Column:
    """True for a share of all items."""
    number = F.conv(F.substring(order_of(*parts, seed=seed), 1, 8), 16, 10).cast("long")
    return number % PARTS < int(share * PARTS)
