"""Reshaping, sets and combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def redimension(df: DataFrame, dims: list[str], within: str, order: list[str]) -> DataFrame:
    """``df`` with ``within``: the place, from 0, of a row in its group of ``dims``."""
    return df.withColumn(within, F.row_number().over(Window.partitionBy(*dims).orderBy(*order)) - 1)


def last_wins(df: DataFrame, dims: list[str], order: list[str]) -> DataFrame:
    """One row for each ``dims``: the last in order."""
    rest = [c for c in df.columns if c not in dims]
    return df.groupBy(*dims).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*dims, "_r.*")


def concat_permissive(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def combinations2(df: DataFrame, key: str) -> DataFrame:
    """``(a, b)``: pairs of distinct values with a < b."""
    v = df.select(F.col(key).alias("a")).distinct()
    return v.join(v.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


def inverted(df: DataFrame, index: str, target: str) -> DataFrame:
    """The inverse of a permutation."""
    return df.select(F.col(target).alias(index), F.col(index).alias(target))


def padded_sort(df: DataFrame, dims: list[str], value: str, into: str) -> DataFrame:
    """Rows renumbered within ``dims`` in order of ``value``, nulls last."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*dims).orderBy(F.col(value).asc_nulls_last())) - 1)


def combinations(df: DataFrame, key: str, k: int) -> DataFrame:
    """``(v1, ..., vk)``: all k distinct values in rising order.  There are n over k of them, so the values must be few."""
    v = df.select(F.col(key).alias("v1")).distinct()
    out = v
    for i in range(2, k + 1):
        out = out.join(v.withColumnRenamed("v1", f"v{i}"), F.col(f"v{i - 1}") < F.col(f"v{i}"))
    return out


def subsets(df: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """``(members)``: arrays of ``least`` to ``most`` distinct values in rising order."""
    each = [combinations(df, key, k).select(F.array(*(f"v{i}" for i in range(1, k + 1))).alias("members")) for k in range(least, most + 1)]
    return reduce(DataFrame.unionByName, each)


def concatenated(parts: list[DataFrame], dim: str, same: list[str]) -> DataFrame:
    """Parts as rows of one table with the part's number in ``dim``; the columns ``same`` must have one value in all parts, else it is an error."""
    every = concat_permissive([p.withColumn(dim, F.lit(k)) for k, p in enumerate(parts)])
    for c in same:
        if every.select(c).distinct().limit(2).count() > 1:
            raise ValueError(f"{c} differs between parts")
    return every


def wide(df: DataFrame, rows: list[str], column: str, value: str, names: list[str]) -> DataFrame:
    """``rows`` and a column for each of ``names``: the value of the row with that name in ``column``, the largest of several."""
    return df.groupBy(*rows).pivot(column, names).agg(F.max(value))


def records(parts: list[DataFrame], float_fill: float = float("nan"), int_fill: int = -99, unsigned_fill: int = 0, unsigned: tuple[str, ...] = ()) -> DataFrame:
    """All rows of all parts with all their columns; what a part lacks is filled by type."""
    out = concat_permissive(parts)
    fill = {c: unsigned_fill if c in unsigned else int_fill if k in ("tinyint", "smallint", "int", "bigint") else float_fill for c, k in out.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    return out.withColumns({c: F.coalesce(c, F.lit(v).cast(dict(out.dtypes)[c])) for c, v in fill.items()}) if fill else out


def on_columns_of_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both on the first's columns; one that the second lacks is null."""
    have = [c for c in a.columns if c in b.columns]
    return a.unionByName(b.select(*have), allowMissingColumns=True)


def distinct_parts(df: DataFrame, name: str, into: str = "short") -> DataFrame:
    """``df`` with names without the words that all begin with and all end with; words end at ``_ . - \\ /`` or a space.

    At least one word stays.  The common words are found by two aggregates over all names.
    """
    words = F.split(F.col(name), r"[_. \\/-]")
    n = df.agg(F.min(F.size(words)).alias("n")).first()["n"] or 0
    checks = [F.count_distinct(F.element_at(words, s * (k + 1))).alias(f"{side}{k}") for side, s in (("a", 1), ("b", -1)) for k in range(n - 1)]
    same = df.agg(*checks).first() if checks else {}
    head = next((k for k in range(n - 1) if same[f"a{k}"] != 1), max(n - 1, 0))
    tail = next((k for k in range(n - 1 - head) if same[f"b{k}"] != 1), max(n - 1 - head, 0))
    return df.withColumn(into, F.array_join(F.slice(words, head + 1, F.size(words) - head - tail), "_"))


def interpolated(df: DataFrame, keys: list[str], x: str, value: str, at: DataFrame, longest: float | None = None) -> DataFrame:
    """``at(keys, x)`` with ``value``: linear between the samples around, null beyond them or where they are more than ``longest`` apart."""
    s = df.where(F.col(value).isNotNull()).groupBy(*keys, x).agg(F.max(value).alias("_v"))
    both = at.select(*keys, x, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_q")).unionByName(s.select(*keys, x, F.col("_v").cast("double").alias("_v"), F.lit(0).alias("_q")))
    own = F.when(F.col("_q") == 0, F.struct(F.col(x).alias("x"), F.col("_v").alias("v")))
    before = Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(F.col(x).desc()).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_s", own).withColumns({"_a": F.last("_s", True).over(before), "_b": F.last("_s", True).over(behind)}).where("_q = 1")
    gap = F.col("_b.x") - F.col("_a.x")
    mid = F.when(gap == 0, F.col("_a.v")).otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(x) - F.col("_a.x")) / F.nullif(gap, F.lit(0)))
    return both.select(*keys, x, (F.when(gap <= longest, mid) if longest is not None else mid).alias(value))
