"""Joins by keys that may be null: a series without a key is a series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, rows of equal ``keys`` matched, null with null; of ``how`` full the keys of either side.

    Without keys ``right`` must be one row, which is broadcast.
    """
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)))
    found = left.join(named, same, how)
    if how == "full":
        # a side that is missing has nulls in all keys, as a side without keys has; then both are null
        found = found.withColumns({k: F.coalesce(k, f"_key_{i}") for i, k in enumerate(keys)})
    return found.drop(*(f"_key_{i}" for i in range(len(keys))))
