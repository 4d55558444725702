"""Joins by keys of which one may have a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, table: DataFrame, key: str, size: str, salts: int = 32, most: int = 1000) -> DataFrame:
    """``rows`` joined with ``table`` by ``key``, of which ``table`` has one row each, with ``size`` the number of rows.

    A key with more than one in ``most`` of all rows is hot, so there are fewer than ``most`` of them and a list of
    them can be broadcast.  Rows of hot keys are dealt to ``salts`` copies of their row of ``table``, the others to one.
    ``key`` must not be null.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * most > total
    listed = table.where(hot).select(F.col(key), F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    dealt = rows.join(F.broadcast(listed), key, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn("_salt", F.explode(copies)), [key, "_salt"]).drop("_salt")
