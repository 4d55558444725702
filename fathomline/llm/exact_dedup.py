"""Exact duplicates by whole content, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.hot import spread_join
from fathomline.session import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs``.

    Rows are first combined where they are read, then by salted digest, so that each of ``salts``
    tasks gets a share of a text that a third of all rows hold, then the winners of the salts meet by
    digest.  Every stage groups by the whole text beside its digest.  A digest of one text alone, as
    all are unless SHA-256 collides, leads its rows to the winner, those of a hot group over ``salts`` tasks; rows of any
    other are led by digest and text.  The row with the largest id stays; rows that repeat an id and text are marked alike,
    a group without ids keeps none.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    # A digest that can't be null: else joins by it compute it once more to leave nulls out.
    rows = rows.withColumn("digest", F.coalesce(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)), F.lit(b"")))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    local = salted.groupBy("digest", "salt", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    met = local.repartition("digest").groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    single = saved(met.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    clash = single.where("texts > 1").select("digest")
    led = spread_join(rows.select("id", "digest"), single.where("texts = 1").drop("texts"), "digest", "group_size", salts)
    led = led.select("id", "digest", "keep_id", "group_size")
    if not clash.isEmpty():
        both = met.join(clash, "digest", "left_semi")
        led = led.unionByName(rows.join(both, ["digest", "norm"]).select("digest", "id", "keep_id", "group_size"))
    return led.select(
        "id", "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
