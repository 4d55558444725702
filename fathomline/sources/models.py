"""Texts of flow models: forcing blocks, polylines and meshes in three files.  Lines carry their file's name and their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forcing_values(lines: DataFrame, file: str = "file", n: str = "n", line: str = "value") -> DataFrame:
    """``(file, block, named, row, quantity, unit, value)`` of files of ``[forcing]`` blocks; ``named`` maps a block's other keys to what they say.

    A block has lines ``key = value``, of which each ``quantity`` begins a column and a ``unit`` belongs to the quantity before it,
    then rows of one number a quantity; a number that cannot be read is null.  Blank and null lines, and lines before the first
    block, are left out.  A row of more or fewer numbers is an error.  Of a key said twice the last counts.  Blocks and rows count
    from 1.  Lines are numbered in windows of one file and block.
    """
    text = F.trim(F.col(line), F.lit(" \t\r"))
    pair = F.col("_x").rlike(r"^[^=]+=[^=]*$")
    each = lines.select(F.col(file).alias("file"), F.col(n).alias("_n"), text.alias("_x")).where("_x <> ''")
    opens = F.lower("_x") == "[forcing]"
    each = each.withColumn("block", F.count_if(opens).over(Window.partitionBy("file").orderBy("_n"))).where((F.col("block") > 0) & ~opens)
    inside = Window.partitionBy("file", "block").orderBy("_n")
    said = each.where(pair).select("file", "block", "_n", F.lower(F.trim(F.split_part("_x", F.lit("="), F.lit(1)))).alias("_k"), F.trim(F.split_part("_x", F.lit("="), F.lit(2))).alias("_v"))
    said = said.withColumn("_q", F.count_if(F.col("_k") == "quantity").over(inside))
    of = lambda k: F.max_by(F.when(F.col("_k") == k, F.col("_v")), F.when(F.col("_k") == k, F.col("_n")))
    columns = said.where("_q > 0 and _k in ('quantity', 'unit')").groupBy("file", "block", "_q").agg(of("quantity").alias("quantity"), of("unit").alias("unit"))
    blocks = said.groupBy("file", "block", "_k").agg(F.max_by("_v", "_n").alias("_v"), F.max("_q").alias("_m")).groupBy("file", "block").agg(
        F.max("_m").alias("_m"), F.map_from_entries(F.collect_list(F.when(~F.col("_k").isin("quantity", "unit"), F.struct("_k", "_v")))).alias("named"))
    rows = each.where(~pair).select("file", "block", F.row_number().over(inside).alias("row"), F.split("_x", r"\s+").alias("_f"))
    rows = rows.join(blocks, ["file", "block"], "left")
    whole = F.when(F.size("_f") == F.coalesce("_m", F.lit(0)), F.col("_f")).otherwise(F.raise_error(F.lit("a row has one number for each quantity")))
    rows = rows.select("file", "block", "named", "row", F.posexplode(whole).alias("_p", "_v")).withColumn("_q", (F.col("_p") + 1).cast("long"))
    return rows.join(columns, ["file", "block", "_q"]).select("file", "block", "named", "row", "quantity", "unit", F.expr("try_cast(_v as double)").alias("value"))


def polyline_lines(points: DataFrame, label: str, order: str, columns: list[str], named: str | None = None) -> DataFrame:
    """``(label, n, value)``: the lines of each polyline: its label, its numbers of rows and columns, then its points by ``order``.

    ``named`` is a column of labels of points; null ones are empty.  Points of equal ``order`` follow one another in any order.
    """
    size = points.groupBy(label).agg(F.count("*").alias("_m"))
    head = size.select(label, F.posexplode(F.array(F.col(label).cast("string"), F.format_string("  %d     %d", F.col("_m"), F.lit(len(columns))))).alias("n", "value"))
    head = head.withColumn("n", F.col("n").cast("long"))
    fields = F.concat_ws("  ", *(F.format_string("%15s", F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in columns))
    after = F.coalesce(F.col(named).cast("string"), F.lit("")) if named else F.lit("")
    number = F.row_number().over(Window.partitionBy(label).orderBy(order)) + 1
    return head.unionByName(points.select(label, number.cast("long").alias("n"), F.concat(F.trim(fields), F.lit("   "), after).alias("value")))


def _numbers(lines: DataFrame, n: str, line: str, name: str) -> DataFrame:
    return lines.withColumn(line, F.trim(F.col(line), F.lit(" \t\r"))).where(F.col(line) != "").select(F.col(n).cast("long").alias(name), F.split(line, r"\s+").alias("f"))


def three_file_mesh(points: DataFrame, edges: DataFrame, cells: DataFrame, n: str = "n", line: str = "value") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes ``(node, x, y)``, edges ``(edge, n1, n2, mark, left, right)``, cells ``(cell, cx, cy)`` and cell nodes of a mesh in three files.

    Points are ``x y ...``, edges ``n1 n2 mark left right ...`` with cells below 0 as null, cells ``cx cy`` with three nodes and three
    neighbours, or a number of sides, ``cx cy`` and as many nodes and neighbours.  Line numbers from 0 name nodes, edges and cells.
    """
    at = lambda k, kind="double": F.col("f")[k].cast(kind)
    beside = lambda k: F.when(at(k, "long") >= 0, at(k, "long"))
    nodes = _numbers(points, n, line, "node").select("node", at(0).alias("x"), at(1).alias("y"))
    links = _numbers(edges, n, line, "edge").select("edge", at(0, "long").alias("n1"), at(1, "long").alias("n2"), at(2, "int").alias("mark"), beside(3).alias("left"), beside(4).alias("right"))
    # Eight fields cannot hold a number of sides: that makes 3 + 2 x sides.
    plain = F.size("f") == 8
    each = _numbers(cells, n, line, "cell").withColumn("_s", F.when(plain, 0).otherwise(1)).withColumn("_m", F.when(plain, 3).otherwise(F.get("f", F.lit(0)).cast("int")))
    centre = each.select("cell", F.get("f", F.col("_s")).cast("double").alias("cx"), F.get("f", F.col("_s") + 1).cast("double").alias("cy"))
    ring = each.select("cell", F.posexplode(F.slice("f", F.col("_s") + 3, F.col("_m"))).alias("pos", "node"))
    return nodes, links, centre, ring.withColumn("node", F.col("node").cast("long"))
