"""Areas of overlap against clipping by half-planes in plain Python, with concave regions, holes, shared edges, and cuts by lines."""

import math
import random

import pytest

from fathomline.operators import mesh, overlay

SCHEMA = "poly long, x0 double, y0 double, x1 double, y1 double"


def edges_of(rings):
    return [(p, *a, *b) for p, r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]


def area(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) / 2 if r else 0.0


def clipped(ring, convex):
    """The part of a ring inside a convex one, up to seams of no area."""
    for a, b in zip(convex, convex[1:] + convex[:1], strict=True):
        side = lambda p, a=a, b=b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if (s >= 0) != (t >= 0):
                k = s / (s - t)
                out.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
        ring = out
        if not ring:
            break
    return ring


def star(cx, cy, n, seed):
    rng = random.Random(seed)
    return [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i, r in ((i, rng.uniform(0.5, 3)) for i in range(n))]


@pytest.fixture(scope="module")
def cells(spark):
    nodes, ring = mesh.rectilinear(spark, 8, 6)
    at = {r["node"]: (r["x"], r["y"]) for r in nodes.collect()}
    held = {}
    for r in ring.orderBy("cell", "pos").collect():
        held.setdefault(r["cell"], []).append(at[r["node"]])
    return nodes, ring, held


def test_areas_are_those_of_clipping(spark, cells):
    nodes, ring, held = cells
    regions = [(1, star(3.3, 2.9, 17, 1)), (2, star(5.1, 3.2, 40, 2)), (3, [(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)]), (3, [(2.0, 2.0), (2.0, 3.0), (3.0, 3.0), (3.0, 2.0)]), (4, [(0.2, 0.2), (0.4, 0.2), (0.3, 0.5)]), (5, [(-9.0, -9.0), (99.0, -9.0), (99.0, 99.0), (-9.0, 99.0)]), (6, [(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)])]
    got = {(r["cell"], r["region"]): (r["area"], r["share"]) for r in overlay.areas_in_regions(ring, nodes, spark.createDataFrame(edges_of(regions), SCHEMA)).collect()}
    want = {}
    for c, cell in held.items():
        for p, r in regions:
            k = area(clipped(r, cell))
            want[c, p] = want.get((c, p), 0.0) + k
    want = {k: v for k, v in want.items() if v > 1e-7}
    assert set(got) == set(want) and all(abs(got[k][0] - v) < 1e-7 and abs(got[k][1] - v) < 1e-7 for k, v in want.items())


def test_parts_of_a_tiling_sum_to_the_whole(spark):
    """Concave quadrangles that tile a square, over a concave star: the parts sum to the star's area."""
    tiles = []
    for i in range(5):
        for j in range(5):
            p = lambda a, b: (a + (0.3 if (a + b) % 2 and 0 < a < 5 else 0.0), b + (0.45 if a % 2 and 0 < b < 5 else 0.0))
            tiles.append((i * 5 + j, [p(i, j), p(i + 1, j), p(i + 1, j + 1), p(i, j + 1)]))
    ring = star(2.5, 2.5, 33, 5)
    ring = [(min(max(x, 0.1), 4.9), min(max(y, 0.1), 4.9)) for x, y in ring]
    got = overlay.overlaps(spark.createDataFrame(edges_of(tiles), SCHEMA), spark.createDataFrame(edges_of([(9, ring)]), SCHEMA)).collect()
    assert sum(r["area"] for r in got) == pytest.approx(area(ring), abs=1e-7) and len(got) > 15
    back = overlay.overlaps(spark.createDataFrame(edges_of([(9, ring)]), SCHEMA), spark.createDataFrame(edges_of(tiles), SCHEMA)).collect()
    assert {r["second"]: round(r["area"], 6) for r in back} == {r["first"]: round(r["area"], 6) for r in got}


def test_equal_layers_and_no_rows(spark):
    tiles = [(i, [(i, 0.0), (i + 1.0, 0.0), (i + 1.0, 1.0), (i + 0.0, 1.0)]) for i in range(4)]
    df = spark.createDataFrame(edges_of([(p, [(float(x), y) for x, y in r]) for p, r in tiles]), SCHEMA)
    got = {(r["first"], r["second"]): r["area"] for r in overlay.overlaps(df, df).collect()}
    assert set(got) == {(i, i) for i in range(4)} and all(abs(v - 1) < 1e-8 for v in got.values())
    none = df.where("false")
    assert overlay.overlaps(none, df).count() == overlay.overlaps(df, none).count() == 0


def test_halves_of_polygons(spark):
    rings = [(1, star(0.0, 0.0, 21, 8)), (2, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]), (3, [(-6.0, 5.0), (-5.0, 5.0), (-5.0, 6.0)])]
    got = {r["poly"]: (r["left"], r["right"]) for r in overlay.halves(spark.createDataFrame(edges_of(rings), SCHEMA), 0.2, -0.1, 0.3, 2.0).collect()}
    far = 1e3
    u = math.hypot(0.3, 2.0)
    d, n = (0.3 / u, 2.0 / u), (-2.0 / u, 0.3 / u)
    half = [(0.2 + s * far * d[0] + t * far * n[0], -0.1 + s * far * d[1] + t * far * n[1]) for s, t in ((-1, 0), (1, 0), (1, 1), (-1, 1))]
    for p, r in rings:
        assert got[p][0] == pytest.approx(area(clipped(r, half)), abs=1e-9) and sum(got[p]) == pytest.approx(area(r), abs=1e-9)


def test_areas_do_not_depend_on_how_far_a_layer_reaches(spark):
    """A cell 30,000 units away neither hides thin overlaps nor moves areas, and a far corner of the regions doesn't either."""
    square = lambda y: [(0.0, y), (1.0, y), (1.0, y + 1), (0.0, y + 1)]
    tiles = edges_of([(1, square(0.0)), (2, square(3e4))])
    thin = edges_of([(7, [(0.25, 0.998), (1.5, 0.998), (1.5, 2.0), (0.25, 2.0)]), (8, [(0.5, -5.0), (0.75, -5.0), (0.75, 9.0), (0.5, 9.0)])])
    far = edges_of([(9, [(-3e4, 0.1), (-2.9999e4, 0.1), (-2.9999e4, 0.2)])])
    for regions in (thin, thin + far):
        got = {(r["first"], r["second"]): r["area"] for r in overlay.overlaps(spark.createDataFrame(tiles, SCHEMA), spark.createDataFrame(regions, SCHEMA)).collect()}
        assert set(got) == {(1, 7), (1, 8)} and abs(got[1, 7] - 0.0015) < 1e-9 and abs(got[1, 8] - 0.25) < 1e-9


def test_a_shared_border_of_many_short_edges_is_no_overlap(spark):
    """A disc and the square around it with the disc as its hole share all corners of the disc."""
    n = 600
    disc = [(5 + 3 * math.cos(2 * math.pi * i / n), 5 + 3 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    a = spark.createDataFrame(edges_of([(1, disc)]), SCHEMA)
    frame = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    b = spark.createDataFrame(edges_of([(2, frame), (2, disc[::-1]), (3, disc)]), SCHEMA)
    got = {(r["first"], r["second"]): r["area"] for r in overlay.overlaps(a, b).collect()}
    assert set(got) == {(1, 3)} and got[1, 3] == pytest.approx(area(disc), abs=1e-8)
    back = {(r["first"], r["second"]): r["area"] for r in overlay.overlaps(b, a).collect()}
    assert set(back) == {(3, 1)} and back[3, 1] == pytest.approx(area(disc), abs=1e-8)
