import math
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import aggregates as A
from tracewright.operators import classify as C
from tracewright.operators import edits as E
from tracewright.operators import joins as J
from tracewright.operators import raster as R
from tracewright.operators import routing as Q
from tracewright.operators import sequences as S

TAGS = "map<string,string>"


def chain(spark, ways, more=""):
    return spark.createDataFrame([(w, i, n) for w, ns in ways.items() for i, n in enumerate(ns)], "way_id long, pos int, node_id long")


def places(spark, at):
    return spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in at.items()], "node_id long, x double, y double")


def tagged(spark, rows):
    return spark.createDataFrame(rows, f"base_id long, tags {TAGS}")


def rules(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value string")


def test_classification(spark):
    f = tagged(spark, [(1, {"highway": "footway"}), (2, {"highway": "primary", "building": "yes"}), (3, {"building": "yes"}), (4, {"building": "no_wall"}), (5, {"building": "yes", "location": "underground"}), (6, {"name": "x"}), (7, None), (8, {"highway": ""})])
    got = C.classify_ways(f, rules(spark, ("building", "*")), rules(spark, ("building", "no_wall")), rules(spark, ("location", "underground")))
    assert {r.base_id: (r.category, r.radius) for r in got.collect()} == {1: ("footway", 3.0), 2: ("road", 7.0), 3: ("barrier", 2.0)}


def test_obstacle_nodes(spark):
    nodes = spark.createDataFrame([(1, {"barrier": "block"}), (2, {"barrier": "entrance"}), (3, {"name": "bench"}), (4, {"barrier": "block"})], f"node_id long, tags {TAGS}")
    used = spark.createDataFrame([(9, 0, 4)], "way_id long, pos int, node_id long")
    assert [r.node_id for r in C.obstacle_nodes(nodes, used, rules(spark, ("barrier", "*")), rules(spark, ("barrier", "entrance"))).collect()] == [1]


@pytest.mark.parametrize("ways,want", [({1: [101, 102, 103], 2: [102, 104]}, {102}), ({1: [1, 2], 2: [3, 4]}, set()), ({1: [1, 200], 2: [2, 200], 3: [3, 200]}, {200}), ({1: [1, 2], 2: [2, 3]}, set()), ({1: [5, 6, 7, 5]}, set()), ({1: [5, 6, 7, 5], 2: [5, 9]}, {5})])
def test_crossroads(spark, ways, want):
    at = {n: (n, 0) for ns in ways.values() for n in ns}
    assert {r.node_id for r in A.footway_crossroads(chain(spark, ways), places(spark, at)).collect()} == want


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr("tracewright.components.LOCAL_LINKS", local)
    two = chain(spark, {9: [1, 2], 4: [2, 3], 3: [7, 8]}).withColumn("map_id", F.lit(1)).unionByName(chain(spark, {9: [1, 2], 4: [5, 6], 3: [6, 1]}).withColumn("map_id", F.lit(2)))
    assert {(r.map_id, r.way_id): r.component for r in A.connected_components(two, ("map_id",)).collect()} == {(1, 9): 4, (1, 4): 4, (1, 3): 3, (2, 9): 3, (2, 4): 3, (2, 3): 3}
    got = A.connected_components(chain(spark, {9: [1, 2], 4: [2, 3], 7: [8, 9], 5: [3, 9], 2: [40, 41]})).collect()
    assert {r.way_id: r.component for r in got} == {9: 4, 4: 4, 7: 4, 5: 4, 2: 2}


def test_validation_rules(spark):
    maps = spark.createDataFrame([(1, 33), (2, None), (3, 33)], "map_id long, zone_number int")
    features = spark.createDataFrame([(1, "footway", 1, True), (1, "footway", 2, False), (1, "barrier", 1, True), (2, "footway", 5, True)], "map_id long, category string, base_id long, has_geometry boolean")
    ways = spark.createDataFrame([(1, "footway", 1, 10), (1, "footway", 1, 11), (1, "footway", 2, 77), (2, "footway", 5, 1)], "map_id long, category string, way_id long, node_id long")
    nodes = spark.createDataFrame([(1, 10), (1, 11)], "map_id long, node_id long")
    got = {(r.map_id, r.rule, r.detail) for r in A.validate_map(maps, features, ways, nodes).collect()}
    assert got == {(2, "missing_metadata", "zone_number"), (3, "no_content", None), (1, "missing_geometry", None), (1, "ambiguous_id", "barrier,footway"), (1, "missing_nodes", "1"), (1, "disconnected", "2")}


def test_ring_assembly(spark):
    members = spark.createDataFrame([(1, 0, 10, [1, 2, 3]), (1, 1, 11, [5, 4, 3]), (1, 2, 12, [5, 1]), (1, 3, 13, [7, 8, 7]), (2, 0, 20, [1, 2]), (2, 1, 21, [8, 9])], "rel_id long, ord int, way_id long, nodes array<long>")
    got = {(r.rel_id, tuple(r.nodes), r.closed) for r in A.merge_way_chains(members).collect()}
    assert got == {(1, (1, 2, 3, 4, 5, 1), True), (1, (7, 8, 7), True), (2, (1, 2), False), (2, (8, 9), False)}


def test_geometry_of_ways(spark):
    got = J.resolve_way_geometry(chain(spark, {1: [5, 6, 7, 5], 2: [5, 6], 3: [99]}), places(spark, {5: (0, 0), 6: (1, 0), 7: (1, 1)})).collect()
    assert {r.way_id: (len(r.points), r.is_area) for r in got} == {1: (4, True), 2: (2, False)}


def test_relations(spark):
    ways = spark.createDataFrame([(1, {"a": "1"}), (2, {}), (3, {"a": "1"})], f"way_id long, tags {TAGS}")
    members = spark.createDataFrame([(10, 1, "outer", {"a": "2"}), (11, 1, "outer", {"b": "3", "a": "4"}), (10, 2, "", {"z": "1"})], f"rel_id long, way_id long, role string, tags {TAGS}")
    got = {r.way_id: (r.in_out, r.tags) for r in J.stamp_relations(ways, members).collect()}
    assert got == {1: ("outer", {"a": "4", "b": "3"}), 2: ("inner", {}), 3: ("", {"a": "1"})}


def test_nearest_within(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0), (3, 0.5, 0.5), (4, 1.0, 0.0), (5, 2.0, 0.0)], "point_id long, x double, y double")
    ref = spark.createDataFrame([(7, 0.0, 0.0)], "ref_id long, x double, y double")
    assert {r.point_id: r.cost for r in J.nearest_within(points, ref, 2.0).collect()} == pytest.approx({1: 0, 3: math.sqrt(0.5) / 2, 4: 0.5})


def segs(spark, rows):
    return spark.createDataFrame([(w, s, *map(float, c), a, b, math.dist(c[:2], c[2:])) for w, s, c, a, b in rows], "way_id long, seg int, x1 double, y1 double, x2 double, y2 double, src long, dst long, length double")


def test_snapping_against_brute_force(spark):
    r = random.Random(1)
    lines = [(i, 0, (x := r.uniform(0, 400), y := r.uniform(0, 400), x + r.uniform(-30, 30), y + r.uniform(-30, 30)), 0, 0) for i in range(40)]
    points = [(i, r.uniform(-100, 900), r.uniform(-100, 500)) for i in range(40)]

    def d(p, c):
        (px, py), (ax, ay, bx, by) = p, c
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    got = J.snap_to_edge(spark.createDataFrame(points, "point_id long, x double, y double"), segs(spark, lines)).collect()
    assert {x.point_id: x.dist for x in got} == pytest.approx({i: min(d((x, y), c) for _, _, c, _, _ in lines) for i, x, y in points})


def rings(spark, areas):
    return spark.createDataFrame([(a, k, i, float(x), float(y)) for a, rs in areas.items() for k, ring in enumerate(rs) for i, (x, y) in enumerate(ring)], "area_id long, ring int, pos int, x double, y double")


BOX = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def test_points_in_polygons_with_holes(spark):
    areas = rings(spark, {1: [BOX(0, 0, 30), BOX(10, 10, 10)], 2: [BOX(25, 25, 10)]})
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 15.0), (3, 27.0, 27.0), (4, 50.0, 50.0)], "point_id long, x double, y double")
    assert sorted(map(tuple, J.points_in_polygons(points, areas).collect())) == [(1, 1), (3, 1), (3, 2)]


def test_leg_collisions(spark):
    legs = spark.createDataFrame([(1, 0, -5.0, 5.0, 50.0, 5.0), (1, 1, -5.0, 10.2, 50.0, 10.2), (1, 2, -5.0, 10.3, 50.0, 10.3), (2, 0, 4.0, 4.0, 5.0, 5.0), (3, 0, 100.0, 0.0, 100.0, 90.0)], "path_id long, leg int, x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, J.leg_collisions(legs, rings(spark, {1: [BOX(0, 0, 10)]})).collect())) == [(1, 0), (1, 1), (2, 0)]


def plain_line(x0, y0, x1, y1):
    dx, dy, out, err, x, y = abs(x1 - x0), abs(y1 - y0), [], 0, x0, y0
    sx, sy = (1 if x1 > x0 else -1), (1 if y1 > y0 else -1)
    major, minor = max(dx, dy), min(dx, dy)
    err = major / 2
    for _ in range(major + 1):
        out.append((x, y))
        err -= minor
        step = err < 0
        if step:
            err += major
        x, y = (x + sx, y + sy * step) if dx > dy else (x + sx * step, y + sy)
    return out


def test_line_cells_against_the_loop(spark):
    r = random.Random(2)
    lines = [(i, *(r.randint(-9, 9) for _ in range(4))) for i in range(200)]
    got = {}
    for x in J.line_cells(spark.createDataFrame(lines, "i long, x0 long, y0 long, x1 long, y1 long"), ("i",)).collect():
        got.setdefault(x.i, []).append((x.k, x.ix, x.iy))
    assert all([c[1:] for c in sorted(got[i])] == plain_line(*c4) for i, *c4 in lines)


def test_line_of_sight(spark):
    cells = spark.createDataFrame([(x, y, 1.0 if x == 5 and y < 8 else 0.1) for x in range(11) for y in range(11)], "ix long, iy long, cost double")
    path = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(0, 0), (0, 5), (2, 9), (5, 9), (8, 9), (10, 0)])], "path_id long, seq int, ix long, iy long")
    kept = [r.seq for r in J.line_of_sight_prune(path, cells).orderBy("seq").collect()]
    assert kept[0] == 0 and kept[-1] == 5 and len(kept) < 6


def test_splits(spark):
    ways = chain(spark, {1: [1, 2, 3, 4, 5], 2: [7, 8], 3: [1, 2, 3, 1]})
    got = S.split_ways(ways, spark.createDataFrame([(1, 2), (1, 4), (1, 1), (2, 7), (3, 2)], "way_id long, node_id long")).collect()
    parts = {}
    for r in sorted(got, key=lambda r: r.pos):
        parts.setdefault((r.base_id, r.seg), []).append(r.node_id)
    assert parts == {(1, 0): [1, 2], (1, 1): [2, 3, 4], (1, 2): [4, 5], (2, None): [7, 8], (3, None): [1, 2, 3, 1]}


def paths(spark, ps):
    return spark.createDataFrame([(i, k, float(x), float(y)) for i, p in ps.items() for k, (x, y) in enumerate(p)], "path_id long, seq int, x double, y double")


def as_lists(df):
    out = {}
    for r in df.orderBy("path_id", "seq").collect():
        out.setdefault(r.path_id, []).append((r.x, r.y))
    return out


def test_smoothing(spark):
    zigzag = [(i, i % 2) for i in range(8)]
    p = paths(spark, {1: zigzag, 2: [(i, 0) for i in range(6)], 3: [(0, 0), (9, 9)]})
    got = as_lists(S.smooth_paths(p))
    assert got[1][0] == zigzag[0] and got[1][-1] == zigzag[-1] and max(y for _, y in got[1][1:-1]) < 0.9
    assert got[2] == [(i, 0) for i in range(6)] and got[3] == [(0, 0), (9, 9)]
    blocked = as_lists(S.smooth_paths(paths(spark, {1: zigzag}), rings(spark, {1: [BOX(-5, -5, 40)]})))
    assert blocked[1] == [(float(x), float(y)) for x, y in zigzag]


def test_thinning(spark):
    p = paths(spark, {1: [(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], 2: [(0, 0), (0, 0.01)]})
    assert as_lists(S.simplify_paths(p, 0.1)) == {1: [(0, 0), (2, 0), (3, 5), (4, 0)], 2: [(0, 0), (0, 0.01)]}
    assert as_lists(S.drop_close_points(paths(spark, {1: [(0, 0), (0, 0.01), (1, 0)], 2: [(0, 0), (0, 0.01)]}))) == {1: [(0, 0), (1, 0)], 2: [(0, 0), (0, 0.01)]}


def test_cells_and_densify(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.1, 0.5)], "map_id long, min_x double, min_y double, max_x double, max_y double")
    assert [(r.ix, r.iy) for r in R.make_cells(boxes, 0.5).orderBy("iy", "ix").collect()] == [(0, 0), (1, 0), (2, 0)]
    got = R.densify_ways(segs(spark, [(1, 0, (0, 0, 1, 0), 1, 2), (1, 1, (1, 0, 1, 0), 2, 3)]), 0.4).orderBy("seg", "k").collect()
    assert [r.x for r in got] == pytest.approx([0, 1 / 3, 2 / 3, 1, 1])


def test_cost_grid(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0)], "map_id long, min_x double, min_y double, max_x double, max_y double")
    cells = R.make_cells(boxes, 0.5).select(F.struct("ix", "iy").alias("point_id"), "ix", "iy", "x", "y")
    way = segs(spark, [(1, 0, (2, 10, 18, 10), 1, 2)])
    points = R.densify_ways(way, 0.25).select(F.struct("way_id", "seg", "k").alias("ref_id"), "x", "y", F.lit(0.0).alias("way_cost"))
    got = {(r.x, r.y): (r.cost, r.blocked) for r in R.cost_grid(cells, points, way, rings(spark, {1: [BOX(4.2, 15.2, 2)], 2: [BOX(9.9, 9.2, 1)]})).collect()}
    assert len(got) == 1600 and got[(10.0, 10.0)] == (0.0, False) and got[(1.0, 1.0)] == (0.9, False) and got[(5.0, 16.0)] == (math.inf, True)
    assert all(c <= 0.9 or b for c, b in got.values()) and got[(10.0, 11.0)][0] == pytest.approx(0.9 / 4)


def graph(spark, rows):
    return Q.build_graph(segs(spark, rows)).select("src", "dst", "weight")


def plain_shortest(edges, a, b):
    d, todo = {a: 0.0}, {a}
    while todo:
        n = min(todo, key=d.get)
        todo.discard(n)
        for x, y, w in edges:
            if x == n and d[n] + w < d.get(y, math.inf):
                d[y] = d[n] + w
                todo.add(y)
    return d.get(b)


def test_shortest_paths_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, 0, (r.uniform(0, 9), r.uniform(0, 9), r.uniform(0, 9), r.uniform(0, 9)), r.randint(0, 25), r.randint(0, 25)) for i in range(45)]
    edges = graph(spark, rows)
    wanted = [(i, r.randint(0, 25), r.randint(0, 25)) for i in range(12)] + [(99, 0, 777)]
    got = {}
    for x in Q.shortest_paths(edges, spark.createDataFrame(wanted, "req long, src long, dst long")).orderBy("seq").collect():
        got.setdefault(x.req, []).append((x.node, x.dist))
    flat = [tuple(e) for e in edges.collect()]
    for req, a, b in wanted:
        best = 0.0 if a == b and any(a == e[0] for e in flat) else plain_shortest(flat, a, b)
        if best is None:
            assert req not in got
        else:
            assert got[req][0][0] == a and got[req][-1][0] == b and got[req][-1][1] == pytest.approx(best)


def test_routes_along_ways(spark):
    ways = segs(spark, [(1, 0, (0, 0, 10, 0), 1, 2), (1, 1, (10, 0, 10, 20), 2, 3), (2, 0, (200, 200, 210, 200), 8, 9)])
    nodes = places(spark, {1: (0, 0), 2: (10, 0), 3: (10, 20), 8: (200, 200), 9: (210, 200)})
    got = as_lists(Q.route_waypoints(paths(spark, {1: [(2, 1), (11, 18)], 2: [(1, 1), (5, 1)], 3: [(0, 1), (205, 201)]}), ways, nodes))
    assert got == {1: [(2, 1), (2, 0), (10, 0), (10, 18), (11, 18)], 2: [(1, 1), (1, 0), (5, 0), (5, 1)]}


def test_raster_paths(spark):
    cells = spark.createDataFrame([(x, y, 0.0, x == 2 and y < 4) for x in range(5) for y in range(5)], "ix int, iy int, cost double, blocked boolean")
    wanted = spark.createDataFrame([(1, 0, 0, 4, 0), (2, 0, 0, 9, 9), (3, 1, 1, 1, 1), (4, 0, 0, 2, 0)], "req long, x0 int, y0 int, x1 int, y1 int")
    got = {}
    for r in Q.least_cost_raster_paths(cells, wanted).orderBy("seq").collect():
        got.setdefault(r.req, []).append((r.ix, r.iy, r.dist))
    assert set(got) == {1, 3} and (2, 4) in {c[:2] for c in got[1]} and got[1][-1][2] == pytest.approx(4 * math.sqrt(2) + 4)


def test_replanning(spark):
    cells = spark.createDataFrame([(x, y, 0.0, 4 <= x <= 6 and y <= 6) for x in range(12) for y in range(12)], "ix int, iy int, cost double, blocked boolean")
    got = as_lists(Q.replan_paths(paths(spark, {1: [(0, 0), (10, 0)], 2: [(0, 9), (10, 9)]}), cells, rings(spark, {1: [BOX(4, -1, 2.5)]}), (0.0, 0.0), 1.0))
    assert got[2] == [(0, 9), (10, 9)] and got[1][0] == (0, 0) and got[1][-1] == (10, 0) and max(y for _, y in got[1]) >= 6
    changed = Q.path_changed(paths(spark, {1: [(0, 0), (10, 0)], 2: [(0, 9)], 3: [(1, 1)]}), paths(spark, {1: [(0, 0.05), (10, 0)], 2: [(0, 9.5)]}))
    assert {r.path_id: r.state for r in changed.collect()} == {1: -1, 2: 0, 3: 1}


def test_junctions_are_spliced(spark):
    ways = segs(spark, [(1, 0, (0, 0, 10, 0), 1, 2)])
    ends = spark.createDataFrame([(-1, 0, 4.0, 1.0), (-2, 0, 6.0, 40.0)], "way_id long, pos int, x double, y double")
    joined = J.endpoint_edge_join(ends, ways).withColumn("node_id", F.lit(-11).cast("long"))
    got = {(r.src, r.dst): r.weight for r in Q.splice_annotations(ways, joined).collect()}
    assert len(got) == 6 and got[("n1", "j-1:0")] == pytest.approx(4) and got[("j-1:0", "n2")] == pytest.approx(6) and got[("n-11", "j-1:0")] == pytest.approx(1)


def test_node_deletes(spark):
    rows = [(1, i, n, "footway") for i, n in enumerate([1, 2, 3])] + [(2, i, n, "footway") for i, n in enumerate([1, 2, 3, 4, 1])] + [(3, i, n, "barrier") for i, n in enumerate([1, 2, 3, 1])] + [(4, i, n, "road") for i, n in enumerate([5, 6])]
    ways = spark.createDataFrame(rows, "way_id long, pos int, node_id long, category string")
    gone = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 5)], "way_id long, node_id long")
    out = {}
    for r in E.apply_node_deletes(ways, gone).orderBy("way_id", "pos").collect():
        out.setdefault(r.way_id, []).append(r.node_id)
    assert out == {1: [1, 3], 2: [2, 3, 4, 2]}


def test_tag_overrides(spark):
    f = spark.createDataFrame([(1, "road", {"highway": "primary"}), (2, "barrier", {"barrier": "wall"}), (3, "road", {"highway": "primary"})], f"base_id long, category string, tags {TAGS}")
    new = tagged(spark, [(1, {"highway": "steps"}), (2, {"highway": "steps"}), (3, {"highway": ""})])
    assert {r.base_id: r.category for r in E.apply_tag_overrides(f, new).collect()} == {1: "footway", 2: "barrier", 3: "road"}


def test_shapes_move_by_their_middle(spark):
    shape = "array<struct<x:double,y:double>>"
    f = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0)])], f"base_id long, points {shape}")
    moves = spark.createDataFrame([(1, 1, 50.0, 50.0), (1, 2, 11.0, 5.0)], "base_id long, ts int, x double, y double")
    assert [tuple(p) for p in E.move_shapes(f, moves).first().points] == [(10.0, 5.0), (12.0, 5.0)]


def test_change_log(spark):
    edits = spark.createDataFrame([(1, "way", "a"), (1, "way", "b"), (1, "node", "n"), (1, "tag", "t"), (1, "split", "s")], "map_id long, kind string, target string")
    log = spark.createDataFrame([(1, "way", "b", "2024-01-01 00:00:00"), (1, "old", "x", None)], "map_id long, kind string, target string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    one = E.change_log_backfill(edits, log)
    rows = [(r.kind, r.target) for r in one.orderBy("section", "place").collect()]
    assert rows == [("way", "a"), ("node", "n"), ("tag", "t"), ("split", "s"), ("way", "b")]
    stamped = one.select("map_id", "kind", "target", F.coalesce("ts", F.lit("2024-02-02").cast("timestamp")).alias("ts"))
    two = E.change_log_backfill(edits, stamped)
    assert sorted((r.kind, r.target) for r in two.collect()) == sorted(rows)


def test_drawn_features(spark):
    a = spark.createDataFrame([(1, 5, "path", [(0.0, 0.0), (1.0, 0.0)], {"width": "4"}), (1, 9, "area", [(0.0, 0.0)], None), (1, 2, "path", [(0.0, 0.0), (1.0, 1.0)], {"highway": "primary"})], f"map_id long, ann_id long, type string, points array<struct<x:double,y:double>>, props {TAGS}")
    got = {r.base_id: (r.category, r.radius, r.nodes, r.tags.get("barrier"), r.tags.get("highway")) for r in E.annotations_to_features(a).collect()}
    assert got == {-1: ("road", 0.75, [-1, -2], None, "primary"), -2: ("footway", 2.0, [-3, -4], None, "path"), -3: ("barrier", 0.0, [], "wall", None)}
    area = E.annotations_to_features(a.withColumn("geom", F.lit("Polygon"))).filter("base_id = -2").first()
    assert (area.category, area.radius, area.nodes, area.tags["highway"]) == ("footway", 0.0, [], "path")


def test_far_points_snap_and_round_limits_are_errors(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0)], "way_id long, seg int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 5.0, 3.0), (2, 200_000.0, 0.0), (3, None, 1.0), (4, float("nan"), 1.0)], "point_id long, x double, y double")
    assert {(r.point_id, r.dist) for r in J.snap_to_edge(points, lines).collect()} == {(1, 3.0), (2, 199_990.0)}
    assert J.snap_to_edge(points, lines.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        J.snap_to_edge(points, lines, rounds=2)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "src long, dst long, weight double")
    with pytest.raises(RuntimeError):
        Q.shortest_distances(edges, spark.createDataFrame([(1, 0, 6)], "req long, src long, dst long"), most=1)


def test_tables_of_a_scope_are_removed(spark):
    from pathlib import Path

    from tracewright import tables

    with tables.scratch(spark):
        inner = tables.cut(spark.range(3), "inner")
        place = Path(inner.inputFiles()[0].removeprefix("file://")).parent
        assert inner.count() == 3 and place.exists()
    assert not place.exists() and tables.cut(spark.range(2), "outer").count() == 2


def test_latest_state_of_every_topic(spark):
    from tracewright.streaming import telemetry as M

    rows = [(1, 1, "2024-01-01 00:00:00", "gps", None, 50.0, 14.0, None), (1, 2, "2024-01-01 00:00:01", "ekf", None, 51.0, 15.0, None), (1, 3, "2024-01-01 00:00:02", "current", 1.236, None, None, None), (1, 4, "2024-01-01 00:00:03", "current", 2.0, None, None, None)]
    rows += [(1, 5, "2024-01-01 00:00:04", "navigation", None, None, None, "RUNNING"), (1, 6, None, "speech", None, None, None, "lost"), (1, 7, "2024-01-01 00:00:05", "speech", None, None, None, "hello"), (2, 8, "2024-01-01 00:00:06", "temperature", 20.06, None, None, None), (2, 9, "2024-01-01 00:00:06", "speed_limit", 0.5, None, None, None)]
    msgs = spark.createDataFrame(rows, "robot_id long, msg_id long, ts string, topic string, num double, lat double, lon double, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    one, two = (r.asDict() for r in M.telemetry_latest(msgs).orderBy("robot_id").collect())
    assert (one["gps_lat"], one["ekf_lon"], one["current"], one["nav_state"], one["speech"], one["motors"]) == (50.0, 15.0, 2.0, "RUNNING", "hello", None)
    assert (two["temperature"], two["speed_limit"], two["gps_lat"], two["speech"]) == (20.1, 0.5, None, None)
    log = spark.createDataFrame([(1, 1, "a", "RUNNING"), (1, 2, "b", "RUNNING"), (1, 3, "c", "DONE"), (2, 1, "a", "DONE")], "robot_id long, msg_id long, name string, status string")
    assert {r.robot_id: r.nav for r in M.last_running(log).collect()} == {1: "b", 2: None}


def test_an_area_of_many_edges_and_far_cells(spark):
    """A ring of 100,000 edges, a large plain one and a small one, against the radius that points lie at."""
    n = 100_000
    ring = spark.range(n + 1).select(F.lit(1).cast("long").alias("area_id"), F.lit(0).alias("ring"), F.col("id").cast("int").alias("pos"), (1000 * F.cos(2 * math.pi * (F.col("id") % n) / n)).alias("x"), (1000 * F.sin(2 * math.pi * (F.col("id") % n) / n)).alias("y"))
    ring = ring.unionByName(rings(spark, {2: [BOX(-50_000, -50_000, 100_000)], 3: [BOX(0.5, 0.5, 2)]}))
    r = random.Random(4)
    points = [(i, r.uniform(-1200, 1200), r.uniform(-1200, 1200)) for i in range(400)] + [(400, 1.0, 1.0), (401, 49_999.0, 0.0), (402, 50_001.0, 0.0), (403, float("nan"), 0.0), (404, None, 1.0)]
    points = [p for p in points if p[1] is None or p[1] != p[1] or abs(math.hypot(p[1], p[2]) - 1000) > 0.1]
    got = {(x.point_id, x.area_id) for x in J.points_in_polygons(spark.createDataFrame(points, "point_id long, x double, y double"), ring).collect()}
    ok = [p for p in points if p[1] is not None and p[1] == p[1]]
    want = {(i, 1) for i, x, y in ok if math.hypot(x, y) < 1000} | {(i, 2) for i, x, y in ok if abs(x) < 50_000} | {(i, 3) for i, x, y in ok if 0.5 <= x < 2.5 and 0.5 <= y < 2.5}
    assert got == want and {(400, 1), (400, 2), (400, 3)} <= got


def test_cells_along_a_long_line_cover_it(spark):
    r = random.Random(6)
    lines = [(i, *(r.uniform(-300, 300) for _ in range(4))) for i in range(60)] + [(60, 5.0, -90.0, 5.0, 90.0), (61, -90.0, 10.0, 90.0, 10.0), (62, 3.0, 3.0, 3.0, 3.0), (63, 1.0, None, 2.0, 2.0)]
    for margin in (0.0, 4.0):
        cells = {}
        for x in J.segment_cells(spark.createDataFrame(lines, "i int, x1 double, y1 double, x2 double, y2 double"), 10.0, margin).collect():
            cells.setdefault(x.i, set()).add((x.cx, x.cy))
        assert 63 not in cells
        for i, x1, y1, x2, y2 in lines[:63]:
            for k in range(400):
                x, y = x1 + (x2 - x1) * k / 399 + r.uniform(-margin, margin), y1 + (y2 - y1) * k / 399 + r.uniform(-margin, margin)
                assert (x // 10, y // 10) in cells[i]
            assert len(cells[i]) <= (2 + margin / 2) * (abs(x2 - x1) + abs(y2 - y1)) / 10 + 8 + 4 * margin


def test_added_nodes_and_drawn_features_of_two_maps(spark):
    by = ("map_id",)
    features = spark.createDataFrame([(m, 5, "footway", {"highway": "footway"}) for m in (1, 2)], f"map_id long, base_id long, category string, tags {TAGS}")
    ways = spark.createDataFrame([(m, 5, i, n) for m in (1, 2) for i, n in enumerate((1, 2))], "map_id long, way_id long, pos int, node_id long")
    nodes = spark.createDataFrame([(m, n, 100.0 * m + n, 0.0) for m in (1, 2) for n in (1, 2)], "map_id long, node_id long, x double, y double")
    none = lambda schema: spark.createDataFrame([], "map_id long, " + schema)
    edits = {"way_deletes": none("base_id long, seg int"), "node_deletes": none("way_id long, node_id long"), "splits": none("way_id long, node_id long"), "moves": none("way_id long, node_id long, ts int, x double, y double"), "tags": none(f"base_id long, tags {TAGS}")}
    edits["added"] = spark.createDataFrame([(1, 5, 1, -1, 1, 0.5, 9.0), (2, 5, 77, -1, 1, 0.0, 0.0)], "map_id long, way_id long, after_node_id long, node_id long, ts int, x double, y double")
    edits["annotations"] = spark.createDataFrame([(2, 3, "path", [(7.0, 8.0), (9.0, 8.0)], None)], f"map_id long, ann_id long, type string, points array<struct<x:double,y:double>>, props {TAGS}")
    out = E.edited_map(features, ways, nodes, edits, with_added_nodes=True, by=by)
    got = sorted((r.map_id, r.base_id, r.pos, r.node_id, r.x, r.y) for r in out["way_nodes"].collect())
    assert got == [(1, 5, 0, 1, 101.0, 0.0), (1, 5, 1, -1, 0.5, 9.0), (1, 5, 2, 2, 102.0, 0.0), (2, -1, 0, -1, 7.0, 8.0), (2, -1, 1, -2, 9.0, 8.0), (2, 5, 0, 1, 201.0, 0.0), (2, 5, 1, 2, 202.0, 0.0)]
    assert sorted((r.map_id, r.base_id, r.category, r.tags["highway"]) for r in out["features"].collect()) == [(1, 5, "footway", "footway"), (2, -1, "footway", "path"), (2, 5, "footway", "footway")]
    assert out["crossroads"].count() == 0


def test_two_maps_of_the_same_ids_and_places_stay_apart(spark):
    by = ("map_id",)

    def maps(one, two):
        return one.withColumn("map_id", F.lit(1)).unionByName(two.withColumn("map_id", F.lit(2)))

    f = maps(tagged(spark, [(1, {"barrier": "wall"}), (2, {"name": "x"})]), tagged(spark, [(1, {"name": "x"}), (2, {"barrier": "wall"})]))
    walls = rules(spark, ("barrier", "*"))
    assert {(r.map_id, r.base_id) for r in C.classify_ways(f, walls, by=by).collect()} == {(1, 1), (2, 2)}
    nodes = f.withColumnRenamed("base_id", "node_id").withColumn("tags", F.create_map(F.lit("barrier"), F.lit("block")))
    used = maps(chain(spark, {9: [1]}), chain(spark, {9: [2]}))
    assert {(r.map_id, r.node_id) for r in C.obstacle_nodes(nodes, used, walls, by=by).collect()} == {(1, 2), (2, 1)}
    ways = maps(segs(spark, [(1, 0, (0, 0, 10, 0), 1, 2)]), segs(spark, [(1, 0, (0, 3, 10, 3), 1, 2)]))
    assert {(r.map_id, r.way_id) for r in C.bbox_filter(ways, (0.0, -1.0, 5.0, 1.0), by=by).collect()} == {(1, 1)}
    assert {(r.map_id, r.src, r.dst) for r in Q.build_graph(ways, by).collect()} == {(m, *e) for m in (1, 2) for e in ((1, 2), (2, 1))}
    ends = spark.createDataFrame([(-1, 0, 4.0, 1.0)], "way_id long, pos int, x double, y double")
    joined = J.endpoint_edge_join(maps(ends, ends), ways, by=by)
    assert {(r.map_id, r.to_way, r.dist) for r in joined.collect()} == {(1, 1, 1.0), (2, 1, 2.0)}
    on = joined.select("map_id", F.col("to_way").alias("way_id"), "seg", "t", "dist", F.col("way_id").alias("drawn"))
    assert [r.place for r in S.splits_along_segment(on, by).collect()] == [1, 1]
    points = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, x double, y double")
    ref = maps(*(spark.createDataFrame([(7, x, 0.0)], "ref_id long, x double, y double") for x in (0.5, 1.5)))
    assert {(r.map_id, r.point_id, r.dist) for r in J.nearest_within(maps(points, points), ref, 2.0, by=by).collect()} == {(1, 1, 0.5), (2, 1, 1.5)}
    lines = maps(*[spark.createDataFrame([(1, 0, 0, 2, 0)], "i long, x0 long, y0 long, x1 long, y1 long")] * 2)
    cells = maps(*(spark.createDataFrame([(x, 0, c) for x in range(3)], "ix long, iy long, cost double") for c in (0.1, 1.0)))
    assert {(r.map_id, r.blocked) for r in J.segment_cost(lines, cells, ("map_id", "i"), by=by).collect()} == {(1, False), (2, True)}


def test_snapping_areas_and_collisions_of_two_maps_stay_apart(spark):
    """Both maps have way 1, area 1, path 1 and point 1 in the same place; what each meets is its own map's."""
    by = ("map_id",)

    def maps(*each):
        out = each[0].withColumn("map_id", F.lit(1))
        for k, df in enumerate(each[1:], 2):
            out = out.unionByName(df.withColumn("map_id", F.lit(k)))
        return out

    areas = maps(rings(spark, {1: [BOX(0, 0, 10), BOX(4, 4, 2)]}), rings(spark, {1: [BOX(100, 0, 10)], 2: [BOX(4, 4, 2)]}))
    at = {1: (1.0, 1.0), 2: (5.0, 5.0), 3: (101.0, 5.0)}
    points = spark.createDataFrame([(k, *p) for k, p in at.items()], "point_id long, x double, y double")
    inside = {1: {(1, 1)}, 2: {(2, 2), (3, 1)}}
    got = J.points_in_polygons(maps(points, points), areas, by=by)
    assert got.columns == ["map_id", "point_id", "area_id"]
    assert {(r.map_id, r.point_id, r.area_id) for r in got.collect()} == {(m, *x) for m in inside for x in inside[m]}
    near, far = segs(spark, [(1, 0, (0, 0, 10, 0), 1, 2)]), segs(spark, [(1, 0, (0, 300, 10, 300), 1, 2), (2, 0, (0, 300, 10, 300), 1, 2)])
    asked = maps(points, points, points)  # the third map has no segment
    got = J.snap_to_edge(asked, maps(near, far), by=by)
    assert {(r.map_id, r.point_id): (r.way_id, r.py, round(r.dist, 6)) for r in got.collect()} == {
        (m, k): (1, y0, round(math.hypot(max(x - 10, 0), y - y0), 6)) for m, y0 in ((1, 0.0), (2, 300.0)) for k, (x, y) in at.items()
    }
    for m, own in ((1, near), (2, far)):  # each map's rows are those of the map by itself
        alone = {(r.point_id, r.way_id, r.seg, r.dist) for r in J.snap_to_edge(points, own).collect()}
        assert alone == {(r.point_id, r.way_id, r.seg, r.dist) for r in got.filter(F.col("map_id") == m).collect()}
    assert {(r.map_id, r.point_id) for r in J.points_near_segments(asked, maps(near, far), 2.0, by=by).collect()} == {(1, 1)}
    assert [(r.map_id, r.point_id, r.way_id, r.dist) for r in J.near_segments(asked, maps(near, far), 2.0, by=by).collect()] == [(1, 1, 1, 1.0)]
    left = J.obstacles_minus_paths(maps(points, points), areas, maps(near, far), 2.0, by=by)
    assert {(r.map_id, r.point_id) for r in left.collect()} == {(2, 2), (2, 3)}
    legs = spark.createDataFrame([(1, 0, -5.0, 2.0, 5.0, 2.0), (1, 1, 101.0, 5.0, 102.0, 5.0)], "path_id long, leg int, x1 double, y1 double, x2 double, y2 double")
    got = J.leg_collisions(maps(legs, legs), areas, by=by)
    assert {(r.map_id, r.path_id, r.leg) for r in got.collect()} == {(1, 1, 0), (2, 1, 1)}
    none = areas.filter("false")
    assert J.points_in_polygons(maps(points), none, by=by).count() == 0 and J.leg_collisions(maps(legs), none, by=by).count() == 0


def test_statistics_count_drawn_features(spark):
    shape = "array<struct<x:double,y:double>>"
    f = spark.createDataFrame([(m, "footway", [(0.0, 0.0), (3.0, 4.0)], 3.0) for m in (1, 2)], f"map_id long, category string, points {shape}, radius double")
    drawn = spark.createDataFrame([(1, 5), (1, 6), (3, 5)], "map_id long, ann_id long")
    assert {(r.map_id, r.n_footway, r.footway_length, r.n_annotations) for r in A.map_stats(f, drawn).collect()} == {(1, 1, 5.0, 2), (2, 1, 5.0, 0)}
    assert "n_annotations" not in A.map_stats(f).columns
