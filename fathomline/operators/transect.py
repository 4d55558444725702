"""Transects as rows of (transect, sample, layer, dx, dz, value columns), one water column for each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depth_int(t: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``(keys, total)``: sums of value times layer thickness."""
    return t.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(F.col(value) * F.abs("dz")).alias("total"))


def depth_avg(t: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``(keys, mean)``: over the thickness that has values."""
    ok = t.where(F.col(value).isNotNull())
    return ok.groupBy(*keys).agg((F.sum(F.col(value) * F.abs("dz")) / F.sum(F.abs("dz"))).alias("mean"))


def total_avg(t: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``(keys, mean)``: over the area that has values."""
    ok = t.where(F.col(value).isNotNull())
    area = F.abs("dz") * F.col("dx")
    return ok.groupBy(*keys).agg((F.sum(F.col(value) * area) / F.sum(area)).alias("mean"), F.sum(F.col(value) * area).alias("total"))


def vertical_slope(t: DataFrame, value: str, z: str, keys: list[str]) -> DataFrame:
    """``(keys, slope)``: straight-line slope over z, null with fewer than two values."""
    ok = t.where(F.col(value).isNotNull() & F.col(z).isNotNull())
    return ok.groupBy(*keys).agg(F.when(F.count("*") >= 2, F.regr_slope(value, z)).alias("slope"))


def layer_weights(t: DataFrame, top: str, bottom: str, z_top: float, z_bottom: float, keys: list[str]) -> DataFrame:
    """``t`` with ``weight``: the share of a vertical window that each layer holds, in each column."""
    from pyspark.sql import Window

    over = F.greatest(F.lit(0.0), F.least(F.col(top), F.lit(z_top)) - F.greatest(F.col(bottom), F.lit(z_bottom)))
    return t.withColumn("_o", over).withColumn("weight", F.col("_o") / F.nullif(F.sum("_o").over(Window.partitionBy(*keys)), F.lit(0.0))).drop("_o")


def bed_masked(t: DataFrame, value: str, depth: str, bed: str) -> DataFrame:
    """Values below nine tenths of the depth become null."""
    return t.withColumn(value, F.when(F.abs(depth) <= 0.9 * F.abs(bed), F.col(value)))


def lateral_int(t: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``(keys, total)``: sums of value times width."""
    return t.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(F.col(value) * F.col("dx")).alias("total"))


def discharge_left(t: DataFrame, u: str, v: str, normals: tuple[str, str], keys: list[str]) -> DataFrame:
    """``(keys, q)``: flow to the left of a transect: velocity along the left normal times thickness and width, missing cells as none."""
    along = F.coalesce(F.col(u) * F.col(normals[0]) + F.col(v) * F.col(normals[1]), F.lit(0.0))
    return t.groupBy(*keys).agg(F.sum(along * F.abs("dz") * F.col("dx")).alias("q"))


def mean_direction(t: DataFrame, u: str, v: str, keys: list[str]) -> DataFrame:
    """``(keys, theta)``: direction of the depth-mean velocity of each column."""
    ok = t.where(F.col(u).isNotNull() & F.col(v).isNotNull())
    return ok.groupBy(*keys).agg(F.atan2(F.sum(F.col(v) * F.abs("dz")), F.sum(F.col(u) * F.abs("dz"))).alias("theta"))


def resampled_z(t: DataFrame, value: str, z: str, levels: list[float], keys: list[str]) -> DataFrame:
    """``(keys, level, value)``: each column's value at the given heights, linear between its samples, null beyond them."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(z)
    s = t.where(F.col(value).isNotNull() & F.col(z).isNotNull()).groupBy(*keys, z).agg(F.avg(value).alias(value))
    s = s.withColumns({"_z": F.lead(z).over(w), "_v": F.lead(value).over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
    each = s.select("*", F.explode(F.array(*(F.lit(float(x)) for x in levels))).alias("level"))
    held = each.where((F.col("level") >= F.col(z)) & ((F.col("level") < F.col("_z")) | (F.col("_last") & (F.col("level") == F.col(z)))))
    at = F.when(F.col("_last"), F.col(value)).otherwise(F.col(value) + (F.col("_v") - F.col(value)) * (F.col("level") - F.col(z)) / (F.col("_z") - F.col(z)))
    found = held.select(*keys, "level", at.alias("_at"))
    every = t.select(*keys).distinct().select(*keys, F.explode(F.array(*(F.lit(float(x)) for x in levels))).alias("level"))
    return every.join(found, [*keys, "level"], "left").select(*keys, "level", F.col("_at").alias(value))


def extrapolated(t: DataFrame, value: str, z: str, keys: list[str], bed: str = "constant", surface: str = "constant") -> DataFrame:
    """Missing values below the lowest and above the highest that a column has: its ``constant`` value there, or ``zero``; those between stay missing."""
    from pyspark.sql import Window

    if {bed, surface} - {"constant", "zero"}:
        raise ValueError("bed and surface are constant or zero")
    has = F.when(F.col(value).isNotNull(), F.struct(F.col(z).alias("z"), F.col(value).alias("v")))
    w = Window.partitionBy(*keys)
    s = t.withColumns({"_a": F.min(has).over(w), "_b": F.max(has).over(w)})
    low = F.when(F.col(z) < F.col("_a.z"), F.col("_a.v") if bed == "constant" else F.lit(0.0))
    high = F.when(F.col(z) > F.col("_b.z"), F.col("_b.v") if surface == "constant" else F.lit(0.0))
    return s.withColumn(value, F.coalesce(value, low, high)).drop("_a", "_b")


def casts_to_transect(casts: DataFrame, station: str, distance: str, depth: str) -> DataFrame:
    """``casts`` with ``sample``, the place of a station by its mean distance, and ``layer``, the place of a sample by depth; both from 0."""
    from pyspark.sql import Window

    at = casts.groupBy(station).agg(F.avg(distance).alias("_d"))
    at = at.withColumn("sample", F.row_number().over(Window.orderBy("_d", station)) - 1).drop("_d")  # a row for each station
    return casts.join(at, station).withColumn("layer", F.row_number().over(Window.partitionBy(station).orderBy(depth)) - 1)


def averaged(transects: DataFrame, value: str) -> DataFrame:
    """``(sample, layer, value, n)``: mean over transects of one grid, missing cells left out."""
    return transects.groupBy("sample", "layer").agg(F.avg(value).alias(value), F.count(value).alias("n"))


def secondary_strength(t: DataFrame, value: str, order: str, keys: list[str], sign: float = 1.0) -> DataFrame:
    """``(keys, strength)``: mean sideways velocity of a column's upper bins, of as many bins as have a negative one, counted along ``order``; 0 if none has.

    Null, not-a-number and zero-thickness bins don't count.  Give ``sign=-1`` where ``order`` runs up from the bed.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    s = t.withColumn("_v", F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.col("dz") != 0), F.col(value)))
    s = s.withColumn("_m", F.count_if(F.col("_v") < 0).over(w)).withColumn("_i", F.count("_v").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys).agg(F.coalesce(sign * F.avg(F.when(F.col("_i") <= F.col("_m"), F.col("_v"))), F.lit(0.0)).alias("strength"))
