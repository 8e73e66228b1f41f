"""Joins that stay whole when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``big`` (many rows per key) to ``small`` (few rows per key).

    A plain shuffle join with ``big`` on the kept side: adaptive execution sees
    the size of every partition, cuts those of a hot key into as many tasks as
    their size asks for, and broadcasts ``small`` where it turns out small.  No
    side is copied ahead of time.
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup keeps the big side: inner or left")
    return big.join(small, list(on), how)
