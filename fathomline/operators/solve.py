"""Sparse symmetric systems by conjugate gradients, and what meshes use them for: extrapolation, smoothing, harmonic fields."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.graph import components
from fathomline.operators.mesh import cell_geometry, edge_geometry
from fathomline.session import written


def multiplied(matrix: DataFrame, vector: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, *columns)``: the product of ``matrix(i, j, v)`` with vectors in ``columns`` by ``i``; a row for each i that the matrix has."""
    v = vector.select(F.col("i").alias("j"), *columns)
    return matrix.join(v, "j").groupBy("i").agg(*(F.sum(F.col("v") * F.col(c)).alias(c) for c in columns))


def conjugate_gradients(matrix: DataFrame, rhs: DataFrame, columns: list[str], tolerance: float = 1e-10, most: int = 2000) -> DataFrame:
    """``(i, *columns)`` with ``matrix x = rhs`` for each of ``columns``, until every residual is at most ``tolerance`` of its right side.

    ``matrix(i, j, v)`` is symmetric and positive definite, repeated places add up, and each i of it has a row of ``rhs``; a null there
    counts as 0.  A step is one product, a join and a sum by row, of which the result is written to the shared folder, and one
    aggregation for the sums that it needs, so all columns are solved in the same passes and nothing but a few sums comes to the
    driver.  The diagonal is divided out first.  Rows that repeat in ``rhs`` are an error of the caller.

    Raises an error after ``most`` steps, or where a column finds the matrix not positive.
    """
    matrix = written(matrix.where("i is not null and j is not null").groupBy("i", "j").agg(F.sum("v").alias("v")))
    diagonal = matrix.where("i = j").select("i", F.col("v").alias("_d"))
    state = rhs.select("i", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"r_{c}") for c in columns)).join(diagonal, "i")
    state = state.select("i", "_d", *(F.lit(0.0).alias(f"x_{c}") for c in columns), *(f"r_{c}" for c in columns), *((F.col(f"r_{c}") / F.col("_d")).alias(f"p_{c}") for c in columns))
    size, steps = None, 0
    names = [f"{k}_{c}" for c in columns for k in "xrpq"]
    while True:
        q = multiplied(matrix, state, [f"p_{c}" for c in columns]).select("i", *(F.col(f"p_{c}").alias(f"q_{c}") for c in columns))
        state = written(state.join(q, "i", "left").select("i", "_d", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names)))
        r, p, q = ({c: F.col(f"{k}_{c}") for c in columns} for k in "rpq")
        z = {c: F.col(f"r_{c}") / F.col("_d") for c in columns}
        sums = {"pq": lambda c: p[c] * q[c], "rr": lambda c: r[c] * r[c], "rz": lambda c: r[c] * z[c], "qz": lambda c: q[c] * z[c], "qq": lambda c: q[c] * q[c] / F.col("_d")}  # noqa: B023
        got = state.agg(*(F.sum(f(c)).alias(f"{n}_{c}") for n, f in sums.items() for c in columns)).first()
        of = {n: {c: got[f"{n}_{c}"] or 0.0 for c in columns} for n in sums}
        size = size or of["rr"]
        left = [c for c in columns if of["rr"][c] > tolerance**2 * size[c]]
        if not left:
            return state.select("i", *(F.col(f"x_{c}").alias(c) for c in columns))
        if steps == most:
            raise RuntimeError(f"residuals of {', '.join(left)} are too large after {most} steps")
        steps += 1
        parts = {}
        for c in columns:
            if c not in left:
                continue
            if not of["pq"][c] > 0 or not math.isfinite(of["pq"][c]):
                raise ValueError("the matrix is not positive definite")
            a = of["rz"][c] / of["pq"][c]
            # the next r z, from sums of this step
            b = max(of["rz"][c] - 2 * a * of["qz"][c] + a * a * of["qq"][c], 0.0) / of["rz"][c]
            new = r[c] - a * q[c]
            parts |= {f"x_{c}": F.col(f"x_{c}") + a * p[c], f"r_{c}": new, f"p_{c}": new / F.col("_d") + b * p[c]}
        state = state.withColumns(parts).drop(*(f"q_{c}" for c in columns))


def diffusion_matrix(edges: DataFrame, cell_nodes: DataFrame, nodes: DataFrame, decay: float, spread: float = 100.0, depth: DataFrame | None = None) -> DataFrame:
    """``(i, j, v)`` of the balance of each cell: what diffuses to its neighbours, by edge length over the distance of centroids, and what decays on its area.

    ``depth(n1, n2, depth)`` widens edges; a missing one counts as 1.  Centroids at one place count as 0.001 apart.
    """
    c = cell_geometry(cell_nodes, nodes).select("cell", F.abs("area").alias("area"), "cx", "cy")
    a, b = (c.select(F.col("cell").alias(s), F.col("cx").alias(f"_{s}_x"), F.col("cy").alias(f"_{s}_y")) for s in ("left", "right"))
    e = edge_geometry(edges, nodes).where("left is not null and right is not null").join(a, "left").join(b, "right")
    far = F.sqrt((F.col("_left_x") - F.col("_right_x")) * (F.col("_left_x") - F.col("_right_x")) + (F.col("_left_y") - F.col("_right_y")) * (F.col("_left_y") - F.col("_right_y")))
    e = e.withColumn("_far", F.when(far == 0, 0.001).otherwise(far))
    wide = F.lit(1.0)
    if depth is not None:
        e = e.join(depth.select("n1", "n2", F.col("depth").alias("_depth")), ["n1", "n2"], "left")
        wide = F.coalesce("_depth", F.lit(1.0))
    e = e.select("left", "right", (F.lit(float(spread)) * F.col("length") * wide / F.col("_far")).alias("k"))
    item = lambda i, j, v: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), v.alias("v"))
    k = F.col("k")
    flux = e.select(F.inline(F.array(item("left", "left", k), item("right", "right", k), item("left", "right", -k), item("right", "left", -k))))
    own = c.select(F.col("cell").alias("i"), F.col("cell").alias("j"), (F.lit(float(decay)) * F.col("area")).alias("v"))
    return flux.unionByName(own).groupBy("i", "j").agg(F.sum("v").alias("v"))


def extrapolated(edges: DataFrame, cell_nodes: DataFrame, nodes: DataFrame, samples: DataFrame, decay: float = 1e-5, spread: float = 100.0, depth: DataFrame | None = None, tolerance: float = 1e-10) -> DataFrame:
    """``(cell, value, weight)`` of every cell, from ``samples(cell, value, weight)`` that diffuse over the mesh.

    Each sample feeds its weight, and its value times its weight, into its cell; both spread and decay, and their ratio is the value: near
    samples it follows them, far off it takes a mean by weight and distance, the smoother the smaller ``decay``.  Both
    fields are solved in one.  Cells that no sample reaches, in parts of the mesh without any, get null and weight 0.  Samples without
    cell, value or a positive weight are left out; each cell's balance is weighed by its own area.
    """
    fed = samples.where("cell is not null and value is not null and weight > 0").groupBy("cell").agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.sum("weight").alias("weight"))
    cells = cell_nodes.select(F.col("cell").alias("i")).distinct()
    rhs = cells.join(fed.withColumnRenamed("cell", "i"), "i", "left")
    found = conjugate_gradients(diffusion_matrix(edges, cell_nodes, nodes, decay, spread, depth), rhs, ["value", "weight"], tolerance)
    return found.select(F.col("i").alias("cell"), F.try_divide("value", "weight").alias("value"), "weight")


def harmonic(links: DataFrame, fixed: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """``(node, value)``: values of ``fixed(node, value)``, and for all other nodes of ``links(a, b, w)`` the mean of their neighbours by weight.

    So values between fixed nodes run evenly, as on concentric lines.  Weights are positive, links count both ways, and nodes that
    no way joins to a fixed one have null.
    """
    e = links.where("a <> b and w > 0").select("a", "b", "w")
    both = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    known = written(fixed.where("node is not null and value is not null").groupBy("node").agg(F.avg("value").alias("value")))
    end = lambda c: known.select(F.col("node").alias(c), F.col("value").alias(f"_{c}"))
    at = both.join(end("b"), "b", "left").join(known.select(F.col("node").alias("a")), "a", "left_anti")
    reach = written(at.select("a", "b", "w", "_b"))
    # what is not joined to a fixed node has no equation
    live = _reached(reach.where("_b is null").select("a", "b"), reach.where("_b is not null").select("a").distinct())
    reach = reach.join(live, "a", "left_semi")
    own = reach.groupBy("a").agg(F.sum("w").alias("v")).select(F.col("a").alias("i"), F.col("a").alias("j"), "v")
    inner = reach.where("_b is null").select(F.col("a").alias("i"), F.col("b").alias("j"), (-F.col("w")).alias("v"))
    rhs = reach.groupBy("a").agg(F.sum(F.col("w") * F.coalesce("_b", F.lit(0.0))).alias("value")).withColumnRenamed("a", "i")
    found = conjugate_gradients(own.unionByName(inner), rhs, ["value"], tolerance).select(F.col("i").alias("node"), "value")
    nodes = both.select(F.col("a").alias("node")).distinct().join(known, "node", "left_anti").join(found, "node", "left")
    return nodes.unionByName(known)


def _reached(links: DataFrame, start: DataFrame) -> DataFrame:
    """``(a)``: nodes joined to ``start(a)``, by components."""
    found = components(links, "a", "b").select(F.col("id").alias("a"), "component")
    met = found.join(start, "a", "left_semi").select("component").distinct()
    return found.join(met, "component", "left_semi").select("a").union(start).distinct()
