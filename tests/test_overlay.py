"""Searches over a partition of the graph, and over raster tiles, against brute force."""

import heapq
import math
import random

import numpy as np
import pytest
from test_operators import graph, paths, places, segs

from tracewright.operators import overlay as O
from tracewright.operators import routing as Q


def plain_distances(edges, a):
    near = {}
    for x, y, w in edges:
        near.setdefault(x, []).append((y, w))
    d, todo = {}, [(0.0, a)]
    while todo:
        dist, n = heapq.heappop(todo)
        if n not in d:
            d[n] = dist
            for y, w in near.get(n, []):
                heapq.heappush(todo, (dist + w, y))
    return d


def check_ways(got, wanted, edges):
    """Every way goes along edges, from start to goal, and is as short as can be; requests without a way have none."""
    best_edge, ways = {}, {}
    for x, y, w in edges:
        best_edge[x, y] = min(w, best_edge.get((x, y), math.inf))
    for r in sorted(got, key=lambda r: (repr(r.req), r.seq)):
        ways.setdefault(r.req, []).append((r.seq, r.node, r.dist))
    for req, a, b in wanted:
        want = plain_distances(edges, a).get(b)
        if want is None:
            assert req not in ways
            continue
        way = ways.pop(req)
        assert [s for s, _, _ in way] == list(range(len(way))) and way[0][1:] == (a, 0.0) and way[-1][1] == b
        assert way[-1][2] == pytest.approx(want, abs=1e-9)
        for (_, u, du), (_, v, dv) in zip(way, way[1:], strict=False):
            assert dv - du == pytest.approx(best_edge[u, v], abs=1e-9)
    assert not ways


def town(r):
    """A graph with long and parallel edges, loops, edges without length, and a part of its own."""
    at = {i: (r.uniform(0, 9), r.uniform(0, 9)) for i in range(60)}
    at[50] = at[51] = at[52] = at[10]
    rows = [(i, 0, (*at[a], *at[b]), a, b) for i, (a, b) in enumerate([(50, 51), (51, 52), (52, 50), (10, 50), (10, 52), *((r.randint(0, 52), r.randint(0, 52)) for _ in range(90)), (57, 58), (58, 59)])]
    return at, rows


@pytest.mark.parametrize("most", [9])
def test_ways_over_the_overlay(spark, most):
    r = random.Random(most)
    at, rows = town(r)
    edges = graph(spark, rows)
    wanted = [(i, r.randint(0, 59), r.randint(0, 59)) for i in range(30)] + [(99, 0, 777), (98, 5, 5), (97, 57, 59), (96, 0, 59), (95, 51, 10)]
    known = {n: p for n, p in at.items() if n != 7}  # a node without a place stands alone
    cells = O.position_cells(spark.createDataFrame([(n, *p) for n, p in known.items()], "node long, x double, y double"), 1.0, most)
    found = Q.shortest_paths(edges, spark.createDataFrame(wanted, "req long, src long, dst long"), cells=cells)
    check_ways(found.collect(), wanted, [tuple(e) for e in edges.collect()])


def test_steps_without_length(spark):
    at, rows = town(random.Random(5))
    edges = graph(spark, rows)
    wanted = [(i, a, b) for i, (a, b) in enumerate([(10, 51), (52, 10), (0, 51), (51, 0), (50, 30)])]
    check_ways(Q.shortest_paths(edges, spark.createDataFrame(wanted, "req long, src long, dst long")).collect(), wanted, [tuple(e) for e in edges.collect()])


def test_cells_hold_so_many_nodes_at_most(spark):
    r = random.Random(1)
    rows = [(i, r.random() ** 4 * 1000, r.random() * 10) for i in range(3000)] + [(3000 + i, 5.0, 5.0) for i in range(900)] + [(9999, None, 1.0)]
    cells = O.position_cells(spark.createDataFrame(rows, "node long, x double, y double"), 5.0, 100)
    counts = sorted(x["count"] for x in cells.groupBy("cell").count().collect())
    assert cells.count() == len(rows) and counts[-1] <= 150 and sum(c > 50 for c in counts) > 10


def test_distances_inside_a_cell():
    r = np.random.default_rng(2)
    for _ in range(20):
        n, m = 12, 30
        src, dst, w = r.integers(0, n, m), r.integers(0, n, m), r.integers(0, 4, m).astype(float)
        dist, step = O.all_distances(n, src, dst, w)
        edges = list(zip(src.tolist(), dst.tolist(), w.tolist(), strict=True))
        for a in range(n):
            want = plain_distances(edges, a)
            assert [x if math.isfinite(x) else None for x in dist[a]] == [want.get(b) for b in range(n)]
            for b in want:
                way = [a]
                while way[-1] != b:
                    way.append(int(step[way[-1], b]))
                    assert len(way) <= n
        keep = O.direct(dist)
        i, j = np.nonzero(keep)
        assert np.array_equal(O.all_distances(n, i, j, dist[i, j])[0], dist)  # what is left out is on the way between others


def test_an_overlay_serves_many_batches(spark):
    r = random.Random(8)
    at, rows = town(r)
    edges = graph(spark, rows)
    over = O.Overlay(edges, O.position_cells(spark.createDataFrame([(n, *p) for n, p in at.items()], "node long, x double, y double"), 1.0, 12))
    flat = [tuple(e) for e in edges.collect()]
    for k in (1, 0):
        wanted = [(i, r.randint(0, 52), r.randint(0, 52)) for i in range(5 * k)]
        check_ways(over.paths(spark.createDataFrame(wanted, "req long, src long, dst long")).collect(), wanted, flat)


@pytest.mark.parametrize("tile", [4])
def test_raster_ways_over_tiles(spark, tile):
    r = random.Random(tile)
    cost = {(x, y): r.random() for x in range(-9, 12) for y in range(-9, 12)}
    blocked = {c for c in cost if r.random() < 0.3}
    cells = spark.createDataFrame([(x, y, c, (x, y) in blocked) for (x, y), c in cost.items()], "ix int, iy int, cost double, blocked boolean")
    ends = [(r.choice(list(cost)), r.choice(list(cost))) for _ in range(14)]
    asked = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(ends)], "req long, x0 int, y0 int, x1 int, y1 int")
    edges = [((x, y), (x + i, y + j), math.hypot(i, j) * (1 + 5 * cost[x + i, y + j])) for x, y in cost for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (x + i, y + j) in cost and not {(x, y), (x + i, y + j)} & blocked]
    found = Q.least_cost_raster_paths(cells, asked, tile=tile)
    rows = [type("R", (), {"req": x.req, "seq": x.seq, "node": (x.ix, x.iy), "dist": x.dist}) for x in found.collect()]
    check_ways(rows, [(i, a, b) for i, (a, b) in enumerate(ends) if not {a, b} & blocked], edges)


def test_simplified_raster_ways(spark):
    cells = spark.createDataFrame([(x, y, 0.0, x == 8 and y < 12) for x in range(17) for y in range(14)], "ix int, iy int, cost double, blocked boolean")
    asked = spark.createDataFrame([(1, 0, 0, 16, 0), (2, 0, 0, 5, 0), (3, 2, 2, 2, 2)], "req long, x0 int, y0 int, x1 int, y1 int")
    whole, thin = ({(r.req, r.ix, r.iy): r.dist for r in Q.least_cost_raster_paths(cells, asked, simplify=s).collect()} for s in (False, True))
    assert set(thin.items()) < set(whole.items()) and {k for k in thin if k[0] == 2} == {(2, 0, 0), (2, 5, 0)} and (1, 8, 12) in thin and [k for k in thin if k[0] == 3] == [(3, 2, 2)]


def test_waypoints_at_one_place(spark):
    """Points that snap to the same node, and points that repeat, are routed by steps without length."""
    ways = segs(spark, [(1, 0, (0, 0, 10, 0), 1, 2), (1, 1, (10, 0, 10, 20), 2, 3), (2, 0, (10, 0, 20, 0), 2, 4)])
    nodes = places(spark, {1: (0, 0), 2: (10, 0), 3: (10, 20), 4: (20, 0)})
    got = {}
    for x in Q.route_waypoints(paths(spark, {1: [(10, 0), (10, 0), (10, 1), (10, 0), (0, 0), (20, 0)]}), ways, nodes).orderBy("seq").collect():
        got.setdefault(x.path_id, []).append((x.x, x.y))
    assert got == {1: [(10, 0), (10, 1), (10, 0), (0, 0), (10, 0), (20, 0)]}
