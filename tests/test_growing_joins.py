"""Joins whose sides grow with the input never send a side through the driver, however small the planner takes it to be."""

import re

import numpy as np

from fathomline import session
from fathomline.operators import extracts, graph, mesh, mesh_joins, overlay, quadtree, rings, spatial

LATTICE = 6


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lattice(spark):
    return mesh.rectilinear(spark, LATTICE, LATTICE)


def test_match_nodes_broadcasts_no_buckets(spark):
    nodes = lattice(spark)[0]
    got = mesh_joins.match_nodes(nodes, nodes, 0.1)
    assert "Broadcast" not in plan(got)
    assert got.where("node = into").count() == (LATTICE + 1) ** 2


def test_points_to_cells_broadcasts_no_mesh(spark):
    nodes, ring = lattice(spark)
    points = nodes.selectExpr("node as pid", "x + 0.5 as x", "y + 0.5 as y")
    got = mesh_joins.points_to_cells(points, ring, nodes, 1.0)
    assert "Broadcast" not in plan(got)
    assert got.where("cell is not null").count() == LATTICE**2


def test_points_in_polygons_and_overlaps_broadcast_no_edges(spark):
    nodes, ring = lattice(spark)
    cells = overlay.cell_edges(ring, nodes)
    points = nodes.selectExpr("node as pid", "x + 0.5 as x", "y + 0.5 as y")
    held = quadtree.in_polygons(points, cells)
    assert "Broadcast" not in plan(cells)
    # whole tables of leaves are bounded by the sample and may go round
    assert plan(held).count("BroadcastHashJoin") == 0
    assert held.count() == LATTICE**2


def test_components_broadcast_no_labels(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "written", lambda df: plans.append(plan(df)) or session.written(df))
    got = graph.components(spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long"))
    assert plans and not any("Broadcast" in p for p in plans)
    assert got.where("component = 0").count() == 21


def test_knn_of_crowded_points_meets_no_squares(spark, monkeypatch):
    met = []
    monkeypatch.setattr(quadtree, "written", lambda df: met.append(session.written(df)) or met[-1])
    places = spark.range(3000).selectExpr("id as pid", "id % 60 / 6000.0 as x", "floor(id / 60) / 6000.0 as y")
    got = spatial.knn(places, places.withColumnRenamed("pid", "qid"), 2, 0.05)
    assert met and got.where("rank = 1 and pid = qid").count() == 3000
    assert got.count() == 6000


def test_overlaps_of_boxes_are_made_once_and_not_compared(spark):
    boxes = [(k, x, x + w, y, y + h) for k, (x, y, w, h) in enumerate([(-1.2, 0.0, 2.5, 0.5), (0.0, 0.4, 3.0, 3.0), (3.0, 3.4, 0.0, 0.0), (-5.0, -5.0, 9.0, 9.0), (7.0, 7.0, 1.0, 1.0)])]
    of = lambda k: spark.createDataFrame(boxes, f"{k} long, xa double, xb double, ya double, yb double")
    got = spatial.rect_overlaps(of("lid"), of("rid"), 1.0)
    assert "HashAggregate" not in plan(got)
    want = [(a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]]
    assert sorted((r.lid, r.rid) for r in got.collect()) == sorted(want)


def test_paired_points_compare_places_not_copies(spark, monkeypatch):
    met = []
    within = quadtree.within
    monkeypatch.setattr(quadtree, "within", lambda *a, **k: met.append(within(*a, **k)) or met[-1])
    left = [(k, float(k % 5), 0.0, k * 1.0) for k in range(50)] + [(90, None, 0.0, 1.0), (91, 40.0, 0.0, 2.0)]
    right = [(k, k % 5 + 0.25 * (k % 2 * 2 - 1), 0.0, k * 10.0) for k in range(100, 160)]
    got = extracts.paired_points(spark.createDataFrame(left, "pid long, x double, y double, value double"), spark.createDataFrame(right, "qid long, x double, y double, value double"), 0.25)
    want = {}
    for p, x, y, v in left:
        near = sorted((abs(x - a), q, w) for q, a, b, w in right if x is not None and abs(x - a) <= 0.25)
        if near:
            want[p] = (near[0][1], v, near[0][2])
    assert {r.pid: (r.qid, r.value, r.other) for r in got.collect()} == want and len(want) == 50
    assert met and met[0].count() <= 60


def test_circumcentres_join_nodes_once(spark):
    places = {k: (float(k % 4) + 0.1 * (k % 3), k // 4 + 0.2 * (k % 5)) for k in range(12)}
    rings = {0: [0, 1, 5, 4], 1: [1, 2, 6], 2: [4, 5, 99, 9, 8], 3: [5, 77, 98], 4: [6, 7, 11, 10, 9]}
    nodes = spark.createDataFrame([(k, *v) for k, v in places.items()], "node long, x double, y double")
    ring = spark.createDataFrame([(c, p, n) for c, ns in rings.items() for p, n in enumerate(ns)], "cell long, pos int, node long")

    def centre(a, b, c):
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        d, e, f = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
        return np.array([a[0] + (cy * e - by * f) / d, a[1] + (bx * f - cx * e) / d])

    want, errors = {}, {}
    for c, ns in rings.items():
        three = [[places.get(ns[(k + i) % len(ns)]) for i in range(3)] for k in range(len(ns))]
        three = [centre(*t) for t in three if None not in t]
        if three:
            want[c] = tuple(np.mean(three, axis=0))
            far = [np.hypot(*(np.array(places[n]) - want[c])) for n in ns if n in places]
            errors[c] = np.std(far) if len(far) > 3 else 0.0
    found = mesh_joins.polygon_circumcentre(ring, nodes)
    assert plan(found).count("SortMergeJoin") == 1
    got = {r.cell: (r.x, r.y) for r in found.collect()}
    assert got.keys() == want.keys() == {0, 1, 2, 4} and all(np.allclose(got[c], want[c]) for c in want)
    found = mesh_joins.circumcentre_errors(ring, nodes)
    assert plan(found).count("SortMergeJoin") == 1
    got = {r.cell: r.error for r in found.collect()}
    assert got.keys() == errors.keys() and all(np.isclose(got[c], errors[c]) for c in errors)


def over_scans(df, column):
    """What the plan has straight above scans of a checkpoint with a column, filters and projections left out."""
    lines = plan(df).splitlines()
    for k, line in enumerate(lines):
        if re.search(rf"ExistingRDD.*\b{column}#", line):
            yield next(x for x in reversed(lines[:k]) if "Filter" not in x and "Project" not in x)


def test_graphs_lay_pairs_by_node_once(spark, monkeypatch):
    rounds, laid = [], []
    monkeypatch.setattr(session, "PART_ROWS", 16, raising=False)
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(df) or session.written(df))
    monkeypatch.setattr(graph, "saved_as_laid", lambda df: laid.append(session.saved_as_laid(df)) or laid[-1], raising=False)
    edges = spark.range(100).selectExpr("id as a", "id + 1 as b", "1.0D as w").union(spark.range(30).selectExpr("id + 1", "id", "2.0D"))
    assert graph.components(edges).where("component = 0").count() == 101
    found = graph.distances(edges, spark.createDataFrame([(90,)], "node long"), 3.0)
    assert sorted((r.node, r.distance) for r in found.collect()) == [(n, abs(n - 90.0)) for n in range(87, 94)]
    assert [d.count() for d in laid] == [200, 200]
    assert min(d.rdd.getNumPartitions() for d in laid) >= 200 // 16
    above = [x for df in rounds for c in "sa" for x in over_scans(df, c)]
    assert above and not any("Exchange" in x or "Sort " in x for x in above)


def test_links_that_know_their_cycle_leave_the_rounds(spark, monkeypatch):
    sizes, links, want = [], [], {}
    monkeypatch.setattr(rings, "written", lambda df: sizes.append(session.written(df)) or sizes[-1])
    for k, (n, closed) in enumerate([(1, True), (2, True), (3, True), (5, True), (7, True), (23, True), (1, False), (6, False)] + [(4, True)] * 20):
        order = [100 * k + i * 37 % n for i in range(n)]
        links += list(zip(order, order[1:] + [order[0] if closed else None]))
        start = order.index(min(order)) if closed else 0
        want |= {h: (order[start], (i - start) % n, closed) for i, h in enumerate(order)}
    got = rings.ranked(spark.createDataFrame(links, "h long, nxt long"))
    assert {r.h: (r.ring, r.pos, r.closed) for r in got.collect()} == want and got.count() == len(want)
    counts = [d.count() for d in sizes if "done" in d.columns]
    assert counts[0] == len(want) and counts[5] == 23
