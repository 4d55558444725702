"""Near copies of vectors against all pairs, with clumps, exact copies, odd vectors and shards of a few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import near_graph, queries
from tests.llm.test_hot_and_names import roots

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.9):
    """(id, n_links, component_id, kept) of [(id, vector)] by all pairs, sorted."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[i][1]) for i in good), default=0)
    u = np.array([[*rows[i][1], *[0.0] * (width - len(rows[i][1]))] for i in good], float).reshape(len(good), width)
    u /= np.abs(u).max(axis=1, initial=0)[:, None]
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    near = u @ u.T >= threshold
    a, b = np.nonzero(near)
    root = roots(range(len(rows)), [(good[x], good[y]) for x, y in zip(a, b, strict=True) if x < y])
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    links = dict(zip(good, near.sum(axis=1) - 1, strict=True))
    return sorted(((rows[i][0], int(links.get(i, 0)), least.get(root[i]), rows[i][0] is not None and rows[i][0] == least.get(root[i])) for i in range(len(rows))), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clumps(seed=0, d=16):
    rng = np.random.default_rng(seed)
    rows = [v for v in rng.standard_normal((150, d))]
    for size in (2, 3, 5, 60):
        base = rng.standard_normal(d)
        rows += [base * rng.uniform(0.5, 2) + 0.12 * rng.standard_normal(d) for _ in range(size)]
    rows += [rows[3]] * 100  # a third of all rows
    chain = rng.standard_normal((2, d))
    rows += [np.cos(t) * chain[0] + np.sin(t) * chain[1] for t in np.linspace(0, 1.2, 12)]
    return [(int(i), np.round(v, 6).tolist()) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_query_finds_all_links(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(queries.op13_near_vectors(spark, SF)) == brute(rows)


@pytest.mark.parametrize(("shard", "block"), [(4096, 1 << 18), (40, 16)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, shard, block):
    """Also with many shards, clusters of several shards, queries in several blocks, and columns of clashing names."""
    monkeypatch.setattr(near_graph, "SHARD_ROWS", shard)
    monkeypatch.setattr(near_graph, "QUERY_BLOCK", block)
    monkeypatch.setattr(near_graph, "RECALL", 1.0)
    rows = clumps()
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] * 16), (1005, [float("inf")] + [1.0] * 15)]
    rows += [(None, rows[0][1]), (None, None), (7, rows[1][1]), (1006, [1e200] + [0.0] * 15), (1007, [3.0]), (1008, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "n", "class", "cell", "links", "component", "least", "size")})
    assert found(near_graph.near_vectors(df)) == brute(rows)


def test_recall_is_audited_and_the_search_widened(spark, monkeypatch):
    """A search that keeps one node and joins one cluster misses links; the audit sees it and doubles both until all are found."""
    monkeypatch.setattr(near_graph, "SHARD_ROWS", 64)
    monkeypatch.setattr(near_graph, "OVERLAP", 1)
    monkeypatch.setattr(near_graph, "BEAM", 2)
    monkeypatch.setattr(near_graph, "DEGREE", 4)
    monkeypatch.setattr(near_graph, "RECALL", 1.0)
    asked = []
    real = near_graph.linked_classes
    monkeypatch.setattr(near_graph, "linked_classes", lambda *a: asked.append(a[-2:]) or real(*a))
    rng = np.random.default_rng(5)
    base = rng.standard_normal((120, 6))
    rows = [(i, (base[i % 120] + 0.25 * rng.standard_normal(6)).tolist()) for i in range(480)]
    got = near_graph.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.min("recall")).first()[0] == 1.0 and len(asked) > 1 and asked[-1][0] == 2 ** (len(asked) - 1)
    assert found(got) == brute(rows)


def test_no_rows_and_no_directions(spark):
    schema = "vec_id long, embedding array<float>"
    assert found(near_graph.near_vectors(spark.createDataFrame([], schema))) == []
    assert found(near_graph.near_vectors(spark.createDataFrame([(2, [0.0]), (None, None)], schema))) == [(2, 0, 2, True), (None, 0, None, False)]
    assert found(near_graph.near_vectors(spark.createDataFrame([(5, [2.0, 0.0]), (4, [1.0, 0.0]), (9, [0.0, 1.0])], schema))) == [(4, 1, 4, True), (5, 1, 4, False), (9, 0, 9, True)]


def test_graphs_find_what_is_in_range():
    """A clump of 300 within 1,200 scattered rows; every node can be reached, and links are pruned."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((1500, 32))
    v[:300] = v[0] + 0.1 * rng.standard_normal((300, 32))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    graph = near_graph.FlatGraph(v)
    graph.build(32)
    assert (graph.links >= 0).sum() < 1500 * near_graph.DEGREE * 1.1
    row, node = graph.within(v, 0.9, 32, np.arange(1500))
    want = np.argwhere(v.astype(float) @ v.T.astype(float) >= 0.9)
    assert {(a, b) for a, b in want.tolist()} <= set(zip(row.tolist(), node.tolist(), strict=True))
    assert len(set(zip(row.tolist(), node.tolist(), strict=True))) == len(row)


def test_pruning_leaves_detours_out():
    v = np.array([[1, 0], [0.9, 0.1], [0.88, 0.12], [0, 1]], np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = v @ v[0]
    kept = near_graph.pruned(v, np.array([[1, 2, 3, -1]]), np.array([[s[1], s[2], s[3], -np.inf]], np.float32), 4)
    assert kept.tolist() == [[1, -1, -1, -1]] or kept.tolist() == [[1, 3, -1, -1]]
