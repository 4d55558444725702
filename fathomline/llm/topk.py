"""Exact top-k search by inner product: a ball tree for each shard, built once and searched by branch and bound."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import saved

LEAF = 128
#: Queries and rows that meet in one task, and rows whose scores give every query its first lower bound.
QUERY_BLOCK, SHARD_ROWS, SEEDS = 4096, 50_000, 2048
#: Rows are dealt to shards by the nearest of so many of the seeds, so that shards are small balls.
CELLS = 64
#: Cells that a query is sent to in each round but the last, best bound first.
ROUNDS = (1, 7)
EXACT = float(2**53)


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a long; null for a vector that is null or has a null or non-finite component."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & ~odd, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of longs as rows; shorter ones are filled with zeros, which add nothing to a product."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    off = np.asarray(vectors.offsets).astype(np.int64)
    size = np.diff(off)
    out = np.zeros((len(size), max(int(size.max(initial=0)), width or 0)), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(off[0], off[-1]) - np.repeat(off[:-1], size)] = vectors.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products, in floating point where that is exact."""
    if not len(q) or not len(v) or float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < EXACT:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    big = q.astype(object) @ v.T.astype(object)
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


class BallTree:
    """Rows of ``v`` in nested balls; rows of a node are consecutive in ``order``."""

    def __init__(self, v: np.ndarray) -> None:
        self.order = np.arange(len(v))
        self.nodes: list[tuple[int, int, int, int]] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        x = v.astype(np.float64)
        todo = [(0, len(v), -1)] if len(v) else []
        while todo:
            a, b, up = todo.pop()
            here, k = x[self.order[a:b]], len(self.nodes)
            c = here.mean(axis=0)
            far = np.sqrt(((here - c) ** 2).sum(axis=1))
            self.centre.append(c)
            self.radius.append(float(far.max()))
            self.nodes.append((a, b, -1, -1))
            if up >= 0:
                p = self.nodes[up]
                self.nodes[up] = (p[0], p[1], k, p[3]) if p[2] < 0 else (p[0], p[1], p[2], k)
            if b - a > LEAF and far.max() > 0:
                one = here[np.argmax(far)]
                two = here[np.argmax(((here - one) ** 2).sum(axis=1))]
                side = np.argsort(here @ (two - one), kind="stable")
                self.order[a:b] = self.order[a:b][side]
                mid = (a + b) // 2
                todo += [(mid, b, k), (a, mid, k)]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """At least each query's product with any row of each node: rounding is allowed for."""
        length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        c, r = np.stack(self.centre), np.array(self.radius)
        wide = length[:, None] * (r + np.sqrt((c**2).sum(axis=1)))
        return q @ c.T + length[:, None] * r + wide * 1e-9 + 1


def searched(tree: BallTree, v: np.ndarray, ids: np.ndarray, q: np.ndarray, qid: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best rows for each query, best first; a slot without a row has the largest long as id.

    ``floor`` is a score that k rows of the whole table reach, so what lies under it is left out.  Each query goes
    first into the child of the larger bound for that query.
    """
    least, none = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    score, name = np.full((len(q), k), least), np.full((len(q), k), none)
    if not len(v):
        return score, name
    bound = tree.bounds(q)
    todo = [(0, np.arange(len(q)))]
    while todo:
        node, live = todo.pop()
        kth = np.maximum(score[live, -1], floor[live])
        live = live[bound[live, node] >= kth.astype(np.float64)]
        if not len(live):
            continue
        a, b, left, right = tree.nodes[node]
        if left < 0:
            rows = tree.order[a:b]
            got = products(q[live], v[rows])
            # Scores under the floor, and the query's own row, can't be among the best.
            out = (got < floor[live, None]) | (ids[rows][None, :] == qid[live, None])
            names = np.where(out, none, np.broadcast_to(ids[rows], got.shape))
            got = np.where(out, least, got)
            s, n = np.concatenate([score[live], got], axis=1), np.concatenate([name[live], names], axis=1)
            best = np.lexsort((n, ~s), axis=1)[:, :k]
            score[live], name[live] = np.take_along_axis(s, best, 1), np.take_along_axis(n, best, 1)
        else:
            first = bound[live, left] >= bound[live, right]
            todo += [(right, live[first]), (left, live[first]), (left, live[~first]), (right, live[~first])]
    return score, name


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "vec", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the k rows of highest inner product, ties to the smaller id.

    Both tables have a long ``id_col`` and an array of longs ``vec_col``; other columns are not read.  A row with the
    query's id is not its result.  Rows with a null id or vector take no part, repeated rows count as often as they
    occur, shorter vectors count as filled with zeros, queries alike in id and vector are asked once, and fewer than k
    rows give fewer results.  A score beyond 64 bits counts as the largest or smallest long.

    Rows are dealt to cells by the nearest of CELLS seeds, and a cell to shards of about ``shard_rows``, however many of
    its vectors are equal.  A shard's tree is built once and saved.  Queries visit shards in rounds, those of the cell
    with the largest bound first; after each round every query's kth score so far is shared with all shards to
    come, so later rounds skip cells, and trees balls, that can't reach it.  First bounds come from SEEDS rows.  A
    shard meets queries in blocks, and goes to those blocks alone that have a query for it.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null").distinct()
    seeds = rows.orderBy(F.xxhash64("id"), "id").limit(SEEDS).toArrow()  # at most SEEDS rows
    seed_v, seed_id = matrix(seeds["v"]), seeds["id"].to_numpy()
    pivots = np.unique(seed_v, axis=0)
    pivots = pivots[:: max(1, -(-len(pivots) // CELLS))].astype(np.float64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a in range(0, x.num_rows, 4096):
                y = x.slice(a, 4096)
                v = matrix(y.column(1), pivots.shape[1]).astype(np.float64)
                p = _padded(pivots, v.shape[1])
                far = (v**2).sum(axis=1)[:, None] - 2 * v @ p.T + (p**2).sum(axis=1)
                cell = far.argmin(axis=1)
                away = np.sqrt(((v - p[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([y.column(0), y.column(1), pa.array(cell.astype(np.int32)), pa.array(away)], ["id", "v", "cell", "away"])

    placed = saved(rows.mapInArrow(dealt, "id bigint, v array<bigint>, cell int, away double"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("cell").collect()  # at most CELLS rows and one
    parts = {c["cell"]: -(-c["n"] // shard_rows) for c in cells}
    radius = np.array([c["radius"] for c in cells])
    centre = pivots[[c["cell"] for c in cells]]
    number = np.array([c["cell"] for c in cells], np.int32)
    of = F.create_map(*(F.lit(x) for c, n in parts.items() for x in (c, n))) if parts else F.create_map().cast("map<int,int>")
    shard = F.struct("cell", F.pmod(F.monotonically_increasing_id(), of[F.col("cell")]).cast("int").alias("part"))

    def build(key: tuple, held: pa.Table) -> pa.Table:
        v, ids = matrix(held["v"]), held["id"].to_numpy()
        tree = pickle.dumps((BallTree(v), v, ids), protocol=5)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([tree], pa.binary())})

    trees = saved(placed.withColumn("_s", shard).select("_s.cell", "_s.part", "id", "v").groupBy("cell", "part").applyInArrow(build, "cell int, part int, tree binary"))

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a in range(0, x.num_rows, 1024):
                y = x.slice(a, 1024)
                q = matrix(y.column(1), max(seed_v.shape[1], centre.shape[1]))
                got = products(q, _padded(seed_v, q.shape[1]))
                got[seed_id[None, :] == y.column(0).to_numpy()[:, None]] = np.iinfo(np.int64).min
                floor = np.partition(got, -k, axis=1)[:, -k] if len(seed_id) >= k else np.full(len(q), np.iinfo(np.int64).min)
                c, length = _padded(centre, q.shape[1]), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                most = q @ c.T + length[:, None] * radius
                most += (length[:, None] * (radius + np.sqrt((c**2).sum(axis=1)))) * 1e-9 + 1  # for rounding
                order = np.argsort(-most, axis=1, kind="stable")
                cut = pa.array((np.arange(len(q) + 1) * len(number)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(z.ravel())) for z in (number[order], np.take_along_axis(most, order, 1))]
                yield pa.RecordBatch.from_arrays([y.column(0), y.column(1), pa.array(floor), *lists], ["id", "v", "floor", "cells", "most"])

    asked = asked.mapInArrow(floored, "id bigint, v array<bigint>, floor bigint, cells array<int>, most array<double>")
    asked = saved(asked.withColumn("ask", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
        out = {"ask": [], "vec_id": [], "score": []}
        if held.num_rows and wanted.num_rows:
            tree, v, ids = pickle.loads(held["tree"][0].as_py())
            q, ask = matrix(wanted["v"]), wanted["ask"].to_numpy()
            width = max(v.shape[1], q.shape[1])
            tree.centre = list(_padded(np.stack(tree.centre), width))
            score, name = searched(tree, _padded(v, width), ids, _padded(q, width), wanted["id"].to_numpy(), wanted["floor"].to_numpy(), k)
            real = name != np.iinfo(np.int64).max
            out = {"ask": np.broadcast_to(ask[:, None], real.shape)[real], "vec_id": name[real], "score": score[real]}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    best, floors, begin = None, asked.select("ask", "floor"), 0
    for n in (*ROUNDS, CELLS + 1):
        zipped = F.slice(F.arrays_zip("cells", "most"), begin + 1, n)
        visit = asked.drop("floor").join(floors, "ask").select("ask", "id", "v", "floor", F.explode(zipped).alias("c")).where("c.most >= floor")
        visit = visit.select("ask", "id", "v", "floor", "c.cells", F.explode(F.sequence(F.lit(0), of[F.col("c.cells")] - 1)).alias("part"))
        visit = visit.withColumnRenamed("cells", "cell").withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks)))
        sent = trees.join(visit.select("cell", "part", "block").distinct(), ["cell", "part"]).select("cell", "part", "block", "tree").toDF("c", "p", "b", "tree")
        found = sent.groupBy("c", "p", "b").cogroup(visit.groupBy("cell", "part", "block")).applyInArrow(search, "ask bigint, vec_id bigint, score bigint")
        found = found if best is None else best.select("ask", "vec_id", "score").union(found)
        order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
        best = saved(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        kth = best.where(F.col("rank") == k).select("ask", F.col("score").alias("kth"))
        floors = asked.select("ask", "floor").join(kth, "ask", "left").select("ask", F.greatest("floor", F.coalesce("kth", "floor")).alias("floor"))
        begin += n
    return best.join(asked.select("ask", F.col("id").alias("query_id")), "ask").select("query_id", "rank", "vec_id", "score")
