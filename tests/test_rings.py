"""Faces, boundaries, nested rings and contours against plain tracers."""

import math
import random

import numpy as np
import pytest

from fathomline.operators import mesh, rings


def traced(links):
    """{h: (first, pos, closed)} of {h: next}."""
    heads = set(links) - {v for v in links.values() if v is not None}
    out, seen = {}, set()
    for start in [*sorted(heads), *sorted(links)]:
        if start in seen:
            continue
        chain, h = [], start
        while h is not None and h not in seen:
            seen.add(h)
            chain.append(h)
            h = links.get(h)
        closed = h is not None
        k = chain.index(min(chain)) if closed else 0
        chain = chain[k:] + chain[:k]
        out |= {h: (chain[0], i, closed) for i, h in enumerate(chain)}
    return out


def test_chains_and_cycles_get_positions(spark):
    rng = random.Random(1)
    names = rng.sample(range(1000), 400)
    links, at = {}, 0
    for size, closed in [(1, True), (1, False), (2, True), (97, True), (128, False), (64, True), (50, False), (57, True)]:
        part = names[at : at + size]
        at += size
        links |= {a: b for a, b in zip(part, part[1:], strict=False)} | {part[-1]: part[0] if closed else None}
    got = {r["h"]: (r["ring"], r["pos"], r["closed"]) for r in rings.ranked(spark.createDataFrame(list(links.items()), "h long, nxt long")).collect()}
    assert got == traced(links)
    assert rings.ranked(spark.createDataFrame([], "h long, nxt long")).count() == 0


def ring_of(rows, key="cell"):
    out = {}
    for r in sorted(rows, key=lambda r: (tuple(r[key]), r["pos"])):
        out.setdefault(tuple(r[key]), []).append(r["node"])
    return out


def test_cells_come_back_from_their_edges(spark):
    """A lattice of quadrangles and triangles with a hole, a lone triangle inside the hole, a dead end and a loop."""
    wide = 7
    nodes = [(i, i % wide + 0.1 * math.sin(i), i // wide + 0.1 * math.cos(i)) for i in range(49)] + [(100, 3.1, 2.9), (101, 3.4, 2.9), (102, 3.2, 3.2), (103, -1.0, -1.0)]
    cells = {}
    for r in range(6):
        for c in range(6):
            a = r * wide + c
            if (r, c) in ((2, 2), (2, 3), (3, 2), (3, 3)):
                continue
            if (r + c) % 3:
                cells[len(cells)] = [a, a + 1, a + wide + 1, a + wide]
            else:
                cells[len(cells)] = [a, a + 1, a + wide + 1]
                cells[len(cells)] = [a, a + wide + 1, a + wide]
    cells[len(cells)] = [100, 101, 102]
    ring = spark.createDataFrame([(k, p, n) for k, v in cells.items() for p, n in enumerate(v)], "cell long, pos int, node long")
    at = spark.createDataFrame(nodes, "node long, x double, y double")
    extra = spark.createDataFrame([(0, 103), (5, 5), (None, 3), (1, 0)], "n1 long, n2 long")
    edges = mesh.edges_of(ring)
    got = ring_of(rings.cells_from_edges(edges.select("n1", "n2").union(extra), at, 4).collect())
    norm = lambda v: tuple(v[v.index(min(v)) :] + v[: v.index(min(v))])
    assert sorted(norm(v) for v in got.values()) == sorted(norm(v) for v in cells.values())
    assert all(k == (v[0], v[1]) and v[0] == min(v) for k, v in got.items())
    every = ring_of(rings.cells_from_edges(edges.select("n1", "n2"), at).collect())
    assert len(every) == len(cells) + 1 and max(len(v) for v in every.values()) == 8  # the hole is a face of its own
    # boundaries: the outer one, the hole clockwise, the lone triangle
    found = rings.ordered_boundaries(edges, at)
    area = {tuple(r["ring"]): r["area"] for r in found.collect()}
    order = ring_of(found.collect(), "ring")
    sizes = sorted((len(v), area[k] > 0) for k, v in order.items())
    assert sizes == [(3, True), (8, False), (24, True)]
    outer = next(v for v in order.values() if len(v) == 24)
    assert norm(outer) == norm([*range(6), *range(6, 48, 7), *range(48, 42, -1), *range(42, 0, -7)])
    best = [r["node"] for r in rings.outer_boundary(edges.select("n1", "n2"), at).orderBy("pos").collect()]
    assert norm(best) == norm(outer)
    depth = {len(order[tuple(r["ring"])]): (r["depth"], None if r["outer"] is None else len(order[tuple(r["outer"])])) for r in rings.nested(found.select("ring", "pos", "node"), at).collect()}
    assert depth == {24: (0, None), 8: (1, 24), 3: (2, None)}


def test_meshes_that_touch_in_a_node_have_two_rings(spark):
    ring = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 2), (1, 1, 3), (1, 2, 4)], "cell long, pos int, node long")
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 1.0, 1.0), (3, 2.0, 2.0), (4, 0.0, 2.0)], "node long, x double, y double")
    got = ring_of(rings.ordered_boundaries(mesh.edges_of(ring), at).collect(), "ring")
    assert sorted(got.values()) == [[0, 1, 2], [2, 3, 4]]


def test_polygons_of_lines(spark):
    square = lambda a, b: [(a, a, b, a), (b, a, b, b), (b, b, a, b), (a, b, a, a)]
    rng = random.Random(2)
    segments = square(0.0, 10.0) + square(2.0, 8.0) + square(4.0, 6.0) + [(20.0, 0.0, 21.0, 0.0)]
    segments = [s if rng.random() < 0.5 else (s[2], s[3], s[0], s[1]) for s in segments]
    rng.shuffle(segments)
    lines, tree = rings.lines_to_polygons(spark.createDataFrame([*segments, (None, 1.0, 2.0, 3.0)], "x1 double, y1 double, x2 double, y2 double"))
    corner = {r["ring"]: (r["x"], r["y"]) for r in lines.where("pos = 0").collect()}
    assert sorted((corner[r["ring"]], r["depth"], r["outer"] and corner[r["outer"]]) for r in tree.collect()) == [((0.0, 0.0), 0, None), ((2.0, 2.0), 1, (0.0, 0.0)), ((4.0, 4.0), 2, None)]
    assert lines.count() == 12


@pytest.mark.parametrize("hole", [False, True])
def test_contours_pass_each_crossing_once(spark, hole):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(14, 17)).round(3)
    if hole:
        v[5:7, 8] = np.nan
    rows = [(r, c, None if np.isnan(v[r, c]) else float(v[r, c])) for r in range(14) for c in range(17)]
    got = rings.contours(spark.createDataFrame(rows, "row int, col int, value double"), 0.25).collect()
    ok = ~np.isnan(v)
    square = lambda r, c: 0 <= r < 13 and 0 <= c < 16 and ok[r : r + 2, c : c + 2].all()
    want = {}
    for r in range(14):
        for c in range(17):
            for kind, (i, j) in enumerate(((0, 1), (1, 0))):
                if r + i < 14 and c + j < 17 and ok[r, c] and ok[r + i, c + j] and (v[r, c] >= 0.25) != (v[r + i, c + j] >= 0.25):
                    if square(r, c) or square(r - j, c - i):
                        t = (0.25 - v[r, c]) / (v[r + i, c + j] - v[r, c])
                        want[kind, r, c] = (c + t * j, r + t * i)
    assert len(got) == len(want) and {tuple(r["h"]): (round(r["x"], 9), round(r["y"], 9)) for r in got} == {k: (round(x, 9), round(y, 9)) for k, (x, y) in want.items()}
    lines = {}
    for r in sorted(got, key=lambda r: r["pos"]):
        lines.setdefault(tuple(r["line"]), []).append(r)
    for line in lines.values():
        assert [r["pos"] for r in line] == list(range(len(line))) and len({r["closed"] for r in line}) == 1
        pts = [(r["x"], r["y"]) for r in line]
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + (pts[:1] if line[0]["closed"] else []), strict=False):
            assert math.hypot(bx - ax, by - ay) <= math.sqrt(2) + 1e-9
            r, c = int(min((ay + by) / 2, 12.999)), int(min((ax + bx) / 2, 15.999))
            high = [(x, y) for y in (r, r + 1) for x in (c, c + 1) if v[y, x] >= 0.25]
            side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in high]
            assert max(side) > -1e-9  # a high corner lies at the left
        if not line[0]["closed"]:  # open ends lie at the border or a hole
            for r in (line[0], line[-1]):
                kind, row, col = r["h"]
                assert not (square(row, col) and square(row - (kind == 0), col - (kind == 1)))


def test_a_saddle_is_decided_by_its_mean(spark):
    high = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0)], "row int, col int, value double")
    def ends(level):
        lines = {}
        for r in rings.contours(high, level).collect():
            lines.setdefault(tuple(r["line"]), set()).add((round(r["x"], 9), round(r["y"], 9)))
        return {frozenset(v) for v in lines.values()}

    assert ends(0.6) == {frozenset({(0.4, 0.0), (0.0, 0.4)}), frozenset({(0.6, 1.0), (1.0, 0.6)})}
    assert ends(0.4) == {frozenset({(0.6, 0.0), (1.0, 0.4)}), frozenset({(0.0, 0.6), (0.4, 1.0)})}
