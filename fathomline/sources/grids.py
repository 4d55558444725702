"""Text formats of meshes: lines to nodes and cell nodes and back.  Lines carry their own numbers, so any split of a file will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fields(lines: DataFrame, line: str) -> DataFrame:
    return lines.select(F.split(F.trim(F.col(line)), r"\s+").alias("f"))


def read_2dm(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, x, y, z)`` and cell nodes of lines ``ND id x y z``, ``E3T id a b c mat`` and ``E4Q id a b c d mat``; numbers from 1 become numbers from 0."""
    f = _fields(lines, line)
    nodes = f.where("f[0] = 'ND'").select((F.col("f")[1].cast("bigint") - 1).alias("node"), *(F.col("f")[k].cast("double").alias(n) for k, n in ((2, "x"), (3, "y"), (4, "z"))))
    sides = F.when(F.col("f")[0] == "E3T", 3).otherwise(4)
    cells = f.where("f[0] in ('E3T', 'E4Q')").select((F.col("f")[1].cast("bigint") - 1).alias("cell"), F.posexplode(F.slice("f", F.lit(3), sides)).alias("pos", "n"))
    return nodes, cells.select("cell", "pos", (F.col("n").cast("bigint") - 1).alias("node"))


def write_2dm(nodes: DataFrame, cell_nodes: DataFrame) -> DataFrame:
    """``(value)``: the lines that ``read_2dm`` reads, without an order; z is 0 where nodes have none."""
    z = F.col("z") if "z" in nodes.columns else F.lit(0.0)
    nd = nodes.select(F.concat_ws(" ", F.lit("ND"), F.col("node") + 1, "x", "y", z).alias("value"))
    ring = cell_nodes.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("node") + 1).alias("n")))).alias("r"))
    kind = F.when(F.size("r") == 3, "E3T").when(F.size("r") == 4, "E4Q").otherwise(F.raise_error(F.lit("cells have three or four sides")))
    return nd.union(ring.select(F.concat_ws(" ", kind, F.col("cell") + 1, F.array_join(F.transform("r", lambda x: x["n"].cast("string")), " "), F.lit(1))))


def read_gr3(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, x, y, z)`` and cell nodes of lines ``id x y z`` and ``id sides a b c ...``; other lines are left out; numbers are from 0."""
    f = _fields(lines, line).where(F.forall("f", lambda x: x.rlike(r"^[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?$")))
    nodes = f.where("size(f) = 4").select((F.col("f")[0].cast("bigint") - 1).alias("node"), *(F.col("f")[k].cast("double").alias(n) for k, n in ((1, "x"), (2, "y"), (3, "z"))))
    cells = f.where("size(f) >= 5 and size(f) = cast(f[1] as int) + 2").select((F.col("f")[0].cast("bigint") - 1).alias("cell"), F.posexplode(F.slice("f", F.lit(3), F.size("f") - 2)).alias("pos", "n"))
    return nodes, cells.select("cell", "pos", (F.col("n").cast("bigint") - 1).alias("node"))


def write_gr3(nodes: DataFrame, cell_nodes: DataFrame) -> DataFrame:
    """``(value)``: the lines that ``read_gr3`` reads, without an order and a heading."""
    z = F.col("z") if "z" in nodes.columns else F.lit(0.0)
    nd = nodes.select(F.concat_ws(" ", F.col("node") + 1, "x", "y", z).alias("value"))
    ring = cell_nodes.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("node") + 1).alias("n")))).alias("r"))
    return nd.union(ring.select(F.concat_ws(" ", F.col("cell") + 1, F.size("r"), F.array_join(F.transform("r", lambda x: x["n"].cast("string")), " "))))
