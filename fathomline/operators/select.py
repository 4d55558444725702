"""Predicates, slices and column selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def within(df: DataFrame, column: str, low: object, high: object, closed: str = "both") -> DataFrame:
    """Rows whose value lies in a range: with both ends, or with ``closed='left'`` without the upper one, as slices of sorted values are."""
    if closed not in ("both", "left"):
        raise ValueError("closed is both or left")
    c = F.col(column)
    return df.where((c >= low) & (c <= high if closed == "both" else c < high))


def within_box(df: DataFrame, box: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Rows whose point lies in ``(xmin, xmax, ymin, ymax)``, edges included."""
    return within(within(df, x, box[0], box[1]), y, box[2], box[3])


def grown_box(df: DataFrame, factor: float, names: tuple[str, str, str, str] = ("xmin", "xmax", "ymin", "ymax")) -> DataFrame:
    """Boxes grown on each side by ``factor`` times half their width or height.  For boxes in the order x, y, x, y give the names in this order."""
    xa, xb, ya, yb = (F.col(c) for c in names)
    dx, dy = factor * (xb - xa) / 2, factor * (yb - ya) / 2
    return df.withColumns(dict(zip(names, (xa - dx, xb + dx, ya - dy, yb + dy), strict=True)))


def missing(value: Column) -> Column:
    """Null or not a number."""
    return value.isNull() | F.isnan(value.cast("double"))


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which the predicate holds, and the others; null does not hold."""
    holds = F.coalesce(predicate, F.lit(False))
    return df.where(holds), df.where(~holds)


def first_finite(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``(keys, value)``: the first value in order that is neither null nor not a number; null if there is none."""
    return df.groupBy(*keys).agg(F.min_by(F.when(~missing(F.col(value)), F.col(value)), F.when(~missing(F.col(value)), F.col(order))).alias(value))


def bundled(df: DataFrame, parts: list[str], into: str) -> DataFrame:
    """``df`` with an array of the columns ``parts``; unchanged if one is absent."""
    return df.withColumn(into, F.array(*parts)) if set(parts) <= set(df.columns) else df


def unpacked(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct column as columns in its place."""
    kind = df.schema[column].dataType
    if not isinstance(kind, StructType):
        raise ValueError(f"{column} is no struct")
    return df.select(*(c for c in df.columns if c != column), f"{column}.*")


def sliced(df: DataFrame, **dims: object) -> DataFrame:
    """Rows at a value of each dimension, or in a half-open range ``(low, high)`` of which either may be None, or in a list."""
    for name, at in dims.items():
        if isinstance(at, tuple):
            low, high = at
            df = df.where(F.col(name) >= low) if low is not None else df
            df = df.where(F.col(name) < high) if high is not None else df
        else:
            df = df.where(F.col(name).isin(at) if isinstance(at, list) else F.col(name) == at)
    return df


def find_columns(df: DataFrame, kind: str) -> list[str]:
    """Names of the columns of a type."""
    return [c for c, k in df.dtypes if k == kind]


def decimated(df: DataFrame, factor: float, key: str, seed: int = 0) -> DataFrame:
    """About one in ``factor`` rows, picked by a hash of the key so that reruns agree."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < 1_000_000 / factor)


def until_step_back(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Of each series the rows before the first whose value doesn't exceed the one before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back = F.when(F.col(value) <= F.lag(value).over(w), 1).otherwise(0)
    return df.withColumn("_b", back).withColumn("_s", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_s = 0").drop("_b", "_s")


def named_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose name matches a regular expression as a whole."""
    return df.where(F.col(column).rlike(f"^(?:{pattern})$"))


def matching(df: DataFrame, **values: object) -> DataFrame:
    """Rows that have all the given values."""
    for name, v in values.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(v)))
    return df


def trimmed(grid: DataFrame) -> DataFrame:
    """A raster without the rows and columns before the first and behind the last that have a value."""
    box = grid.where("value is not null").agg(*(f(c).alias(f"{n}_{c}") for c in ("row", "col") for f, n in ((F.min, "a"), (F.max, "b"))))
    return grid.join(F.broadcast(box), F.col("row").between(F.col("a_row"), F.col("b_row")) & F.col("col").between(F.col("a_col"), F.col("b_col"))).select(*grid.columns)
