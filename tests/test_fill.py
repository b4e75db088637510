"""Row-by-row fill of areas, nearest steps along segments, and sight lines by rounds, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_operators import BOX, plain_line, rings, segs

from tracewright.operators import joins as J
from tracewright.operators import raster as R
from tracewright.operators import sequences as S


def inside(px, py, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def held(px, py, shape):
    return inside(px, py, shape[0]) and not any(inside(px, py, hole) for hole in shape[1:])


def shapes(r):
    """Star-shaped, self-crossing and boxed areas with holes that may overlap or reach beyond, on and off the lattice."""
    out = {1: [BOX(0, 0, 30), BOX(10, 10, 10), BOX(15, 15, 10)], 2: [BOX(25.5, 25.5, 10)], 3: [BOX(-100, -100, 300), BOX(-50, -50, 120)]}
    for a in range(4, 12):
        x, y, n = r.uniform(-40, 60), r.uniform(-40, 60), r.randint(3, 9)
        ring = [(x + r.uniform(-15, 15), y + r.uniform(-15, 15)) for _ in range(n)]
        hole = [(x + r.uniform(-6, 6), y + r.uniform(-6, 6)) for _ in range(4)]
        out[a] = [[*ring, ring[0]], [*hole, hole[0]]] if a % 2 else [[*ring, ring[0]]]
    return out


@pytest.mark.parametrize("tile", [3.0, 64.0])
def test_positions_inside_areas(spark, tile):
    r = random.Random(3)
    areas = shapes(r)
    at = [(x * 0.5, y * 0.5) for x in range(-60, 120) for y in range(-60, 120, 3)] + [(r.uniform(-150, 250), r.uniform(-150, 250)) for _ in range(300)]
    rows = spark.createDataFrame([*at, (float("nan"), 1.0), (None, 2.0)], "x double, y double")
    got = {(x.x, x.y) for x in J.positions_inside(rows, rings(spark, areas), tile).collect()}
    assert got == {p for p in at if any(held(*p, shape) for shape in areas.values())}
    assert J.positions_inside(rows, rings(spark, areas).limit(0), tile).count() == 0


def test_fill_area_points(spark):
    areas = shapes(random.Random(4))
    del areas[3]
    got = {}
    for x in R.fill_area_points(rings(spark, areas), 2.0).collect():
        got.setdefault(x.area_id, set()).add((x.x, x.y))
    at = [(x * 0.5, y * 0.5) for x in range(-140, 180) for y in range(-140, 180)]
    assert got == {a: p for a, shape in areas.items() if (p := {q for q in at if held(*q, shape)})}


def test_an_area_of_a_million_cells_and_many_edges(spark):
    """A disc of 100,000 edges with a round hole: as many lattice points as its area has, and none in the hole."""
    n = 100_000
    turn = lambda ring, radius: spark.range(n + 1).select(F.lit(1).cast("long").alias("area_id"), F.lit(ring).alias("ring"), F.col("id").cast("int").alias("pos"), (radius * F.cos(2 * math.pi * (F.col("id") % n) / n)).alias("x"), (radius * F.sin(2 * math.pi * (F.col("id") % n) / n)).alias("y"))
    disc = turn(0, 300.0).unionByName(turn(1, 60.0))
    got = R.fill_area_points(disc, 2.0).withColumn("far", F.hypot("x", "y")).agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).first()
    assert got.n == pytest.approx(4 * math.pi * (300**2 - 60**2), rel=1e-3) and got.n > 10**6 and got.low > 59.99 and got.high < 300.01
    box = spark.createDataFrame([(1, -310.0, -310.0, 310.0, 310.0)], "map_id long, min_x double, min_y double, max_x double, max_y double")
    cells = R.make_cells(box, 0.5).select(F.struct("ix", "iy").alias("point_id"), "x", "y")
    burnt = R.burn_obstacles(cells, disc)
    assert burnt.count() == 1240**2 and burnt.filter("blocked").count() == got.n


def test_nearest_steps_are_the_nearest_points_along_ways(spark):
    r = random.Random(6)
    rows = [(i, k, (x := r.uniform(0, 40), y := r.uniform(0, 40), x + r.uniform(-9, 9), y + r.uniform(-9, 9)), 0, 0) for i in range(12) for k in range(2)]
    rows += [(20, 0, (5, 5, 5, 5), 0, 0), (20, 1, (5, 5, 9, 5), 0, 0), (21, 0, (9, 5, 5, 5), 0, 0), (22, 1, (3, 3, 3, 3), 0, 0)]
    ways = segs(spark, rows).withColumn("way_cost", F.col("way_id") / 50)
    points = spark.createDataFrame([(i, r.uniform(-2, 42), r.uniform(-2, 42)) for i in range(300)] + [(900, 7.0, 5.5), (901, 5.0, 5.0), (902, 3.0, 3.5), (903, None, 1.0)], "point_id long, x double, y double")
    dense = R.densify_ways(ways, 0.25, ("way_cost",)).select(F.struct("way_id", "seg", "k").alias("ref_id"), "x", "y", "way_cost")
    for reach in (1.0, 2.0):
        want = {x.point_id: (tuple(x.ref_id), x.dist, x.way_cost) for x in J.nearest_within(points, dense, reach, ("way_cost",)).collect()}
        got = {x.point_id: (tuple(x.ref_id), x.dist, x.way_cost) for x in J.nearest_steps(points, ways, reach, 0.25, ("way_cost",)).collect()}
        assert got.keys() == want.keys() and {901, 902} <= got.keys() and got[901][0] == (20, 0, 0)
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) and got[k][2] == want[k][2] for k in want)


def test_a_point_as_near_to_several_segments(spark):
    """The smaller way and segment win, whatever the rounding errors of their distances are."""
    turns = [0.1 * k for k in range(1, 9)]
    rows = [(9 - i, 0, (50 + 30 * math.cos(t), 50 + 30 * math.sin(t), 50 - 30 * math.cos(t), 50 - 30 * math.sin(t)), 0, 0) for i, t in enumerate(turns)]
    ends = spark.createDataFrame([(-1, 0, 50.0, 50.0)], "way_id long, pos int, x double, y double")
    assert [(x.to_way, x.seg) for x in J.endpoint_edge_join(ends, segs(spark, rows)).collect()] == [(2, 0)]
    points = spark.createDataFrame([(1, 50.0, 50.0)], "point_id long, x double, y double")
    assert [(x.way_id, x.seg) for x in J.snap_to_edge(points, segs(spark, rows)).collect()] == [(2, 0)]
    refs = spark.createDataFrame([(9 - i, 50 + 3 * math.cos(t), 50 + 3 * math.sin(t)) for i, t in enumerate(turns)], "ref_id long, x double, y double")
    assert [x.ref_id for x in J.nearest_within(points, refs, 5.0).collect()] == [2]


@pytest.mark.parametrize("look", [1, 4, 32])
def test_sight_lines_against_the_plain_rule(spark, look):
    r = random.Random(look)
    cost = {(x, y): 1.0 if r.random() < 0.12 else 0.2 for x in range(30) for y in range(30)}
    ways = {p: [(r.randint(-2, 31), r.randint(-2, 31)) for _ in range(n)] for p, n in enumerate([1, 2, 3, 9, 25, 40])}
    cells = spark.createDataFrame([(x, y, c) for (x, y), c in cost.items()], "ix long, iy long, cost double")
    rows = spark.createDataFrame([(p, 10 * i, x, y) for p, way in ways.items() for i, (x, y) in enumerate(way)], "path_id long, seq int, ix long, iy long")
    got = {}
    for x in J.line_of_sight_prune(rows, cells, look=look).orderBy("path_id", "seq").collect():
        got.setdefault(x.path_id, []).append(x.seq // 10)
    for p, way in ways.items():
        kept = [0]
        while kept[-1] < len(way) - 1:
            i = kept[-1]
            kept.append(next(j for j in range(len(way) - 1, i, -1) if j == i + 1 or all(cost.get(c, 0) < 1 for c in plain_line(*way[i], *way[j]))))
        assert got[p] == kept


def test_simplifying_against_the_recursive_rule(spark):
    r = random.Random(9)
    ways = {p: [(r.uniform(0, 50), r.uniform(0, 50)) for _ in range(n)] for p, n in enumerate([1, 2, 3, 8, 60, 200])}
    ways[7] = [(0, 0), (5, 5), (0, 0), (5, 5), (0, 0)]

    def gap(p, a, b):
        square = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / square)) if square else 0
        return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))

    def kept(way, a, b):
        if b - a < 2:
            return []
        d = [gap(way[i], way[a], way[b]) for i in range(a + 1, b)]
        m = a + 1 + d.index(max(d))
        return [*kept(way, a, m), m, *kept(way, m, b)] if max(d) > 7.5 else []

    rows = spark.createDataFrame([(p, i, float(x), float(y)) for p, way in ways.items() for i, (x, y) in enumerate(way)], "path_id long, seq int, x double, y double")
    got = {}
    for x in S.simplify_paths(rows, 7.5, renumber=False).orderBy("path_id", "seq").collect():
        got.setdefault(x.path_id, []).append(x.seq)
    assert got == {p: sorted({0, len(way) - 1, *kept(way, 0, len(way) - 1)}) for p, way in ways.items()}


def test_grids_of_two_maps_stay_apart(spark):
    """Two maps in one place, each with an area and a way of its own under the same ids: both maps' grids are those of each map by itself."""
    cells = spark.range(400).selectExpr("id as point_id", "id % 20 as ix", "floor(id / 20) as iy", "cast(id % 20 as double) as x", "cast(floor(id / 20) as double) as y")
    own = []
    for m, (low, y) in enumerate(((2.0, 4.0), (7.0, 15.0)), 1):
        ring = [(1, 0, i, low + dx, low + dy) for i, (dx, dy) in enumerate([(0.0, 0.0), (6.5, 0.0), (6.5, 6.5), (0.0, 6.5), (0.0, 0.0)])]
        way = [(1, 0, 0.0, y, 20.0, y, 0.1 * m)]
        own.append((spark.createDataFrame(ring, "area_id long, ring int, pos int, x double, y double"), spark.createDataFrame(way, "way_id long, seg int, x1 double, y1 double, x2 double, y2 double, way_cost double")))
    both = [one.withColumn("map_id", F.lit(1)).unionByName(two.withColumn("map_id", F.lit(2))) for one, two in ((cells, cells), *zip(*own, strict=True))]
    by, rows = ("map_id",), lambda df, m: {tuple(r) for r in df.filter(F.col("map_id") == m).drop("map_id").collect()}
    grid = R.cost_grid(both[0], both[2], both[2], both[1], by=by).cache()
    burnt, costs = R.burn_obstacles(both[0], both[1], by=by), R.nearest_way_cost(both[0], both[2], by=by)
    for m, (rings, ways) in enumerate(own, 1):
        alone = R.cost_grid(cells, ways, ways, rings)
        assert alone.filter("blocked").count() and rows(grid, m) == {tuple(r) for r in alone.collect()}
        assert rows(burnt, m) == {tuple(r) for r in R.burn_obstacles(cells, rings).collect()}
        assert rows(costs, m) == {tuple(r) for r in R.nearest_way_cost(cells, ways).collect()} and rows(costs, m)
    assert rows(grid, 1) != rows(grid, 2) and grid.count() == 800
