"""Classification, filters, joins and aggregates over features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import joins as J
from ..operators import sequences as S
from .fixtures import Town, query
from .point_queries import ROT


def classified(t: Town):
    return C.classify_ways(t.features, t.rules(("barrier", "*")))


@query("SELECT way_id AS base_id, coalesce(highway IN ('footway', 'path'), false) AS foot FROM fx_ways")
def is_footway(t: Town):
    return t.ways.select(F.col("way_id").alias("base_id"), C.is_footway(F.col("highway")).alias("foot"))


@query("SELECT way_id AS base_id, coalesce(highway NOT IN ('footway', 'path'), false) AS road FROM fx_ways")
def is_road(t: Town):
    return t.ways.select(F.col("way_id").alias("base_id"), C.is_road(F.col("highway")).alias("road"))


@query("SELECT way_id AS base_id FROM fx_ways WHERE barrier IS NOT NULL AND coalesce(surface, '') <> 'gravel'")
def is_barrier(t: Town):
    return C.matches_rules(t.features, t.rules(("barrier", "*"), ("natural", "cliff")), t.rules(("barrier", "kerb")), t.rules(("surface", "gravel")))


@query("SELECT way_id AS base_id, category, CASE category WHEN 'road' THEN 7.0 WHEN 'footway' THEN 3.0 ELSE 2.0 END::DOUBLE AS radius FROM fx_class")
def classify_ways(t: Town):
    return classified(t).select("base_id", "category", "radius")


@query("SELECT category, max(CASE category WHEN 'road' THEN 7.0 WHEN 'footway' THEN 3.0 ELSE 0.0 END)::DOUBLE AS radius, count(*) AS n FROM fx_class GROUP BY category")
def buffer_radius_by_category(t: Town):
    rows = classified(t).withColumn("radius", C.buffer_radius(F.col("category"), F.lit(True)))
    return rows.groupBy("category").agg(F.max("radius").alias("radius"), F.count("*").alias("n"))


@query("SELECT node_id, x, y, CAST(2 AS DOUBLE) AS radius FROM fx_nodes WHERE barrier IS NOT NULL AND barrier <> 'entrance' AND node_id NOT IN (SELECT node_id FROM fx_way_nodes)")
def obstacle_nodes(t: Town):
    return C.obstacle_nodes(t.tagged_nodes, t.way_nodes, t.rules(("barrier", "*")), t.rules(("barrier", "entrance"))).select("node_id", "x", "y", "radius")


@query("SELECT way_id AS base_id, coalesce(highway, barrier, 'other') AS subtype FROM fx_class")
def subtype(t: Town):
    return classified(t).select("base_id", C.subtype(F.col("category"), F.col("tags")).alias("subtype"))


@query("SELECT way_id AS base_id FROM fx_ways WHERE CAST(way_id AS VARCHAR) LIKE '%12%' OR contains(coalesce(highway, ''), '12') UNION SELECT way_id FROM fx_ways WHERE contains(coalesce(surface, ''), 'grav')")
def search_features(t: Town):
    return C.search_features(t.features, "12").select("base_id").unionByName(C.search_features(t.features, "GRAV").select("base_id")).distinct()


@query("SELECT way_id AS base_id, category FROM fx_class WHERE way_id NOT IN (SELECT way_id FROM fx_edit_log WHERE op IN ('hide', 'delete')) AND coalesce(highway, barrier) <> 'path'")
def visible_features(t: Town):
    log = t.edit_log.select(F.col("way_id").alias("base_id"), "op")
    return C.visible_features(classified(t), log.filter("op = 'hide'"), log.filter("op = 'delete'"), ("path",)).select("base_id", "category")


CORNERS = ", ".join(f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)" for x in (458098, 458202) for y in (5550548, 5550602))


@query(f"SELECT DISTINCT way_id FROM fx_segments WHERE least(x1, x2) <= 458202 AND greatest(x1, x2) >= 458098 AND least(y1, y2) <= 5550602 AND greatest(y1, y2) >= 5550548 AND least({CORNERS}) <= 0 AND greatest({CORNERS}) >= 0")
def bbox_filter(t: Town):
    """In SQL: the bounds overlap and the box's corners aren't all on one side of the segment's line."""
    return C.bbox_filter(t.segments, (458100.0, 5550550.0, 458200.0, 5550600.0), 2.0)


@query("SELECT way_id AS base_id FROM fx_class WHERE category IN ('footway', 'road')")
def way_kind_filter(t: Town):
    return C.way_kind_filter(classified(t), ("footway", "road")).select("base_id")


@query("SELECT way_id, count(*) AS n FROM fx_placed GROUP BY way_id")
def has_geometry(t: Town):
    rows = t.ways.select("way_id").join(J.resolve_way_geometry(t.way_nodes, t.nodes), "way_id", "left")
    return C.has_geometry(rows).select("way_id", F.size("points").cast("long").alias("n"))


@query("SELECT node_id FROM fx_nodes WHERE x BETWEEN 458050 AND 458150 AND y BETWEEN 5550500 AND 5550600")
def in_grid_bounds(t: Town):
    return C.in_grid_bounds(t.nodes, (458050.0, 5550500.0, 458150.0, 5550600.0)).select("node_id")


@query("""WITH o AS (SELECT way_id, count(*) AS n, arg_min(x, pos) AS fx, arg_min(y, pos) AS fy, arg_max(x, pos) AS lx, arg_max(y, pos) AS ly, sum(x * (pos + 1)) AS checksum FROM fx_placed GROUP BY way_id)
SELECT way_id, n, round(checksum, 3) AS checksum, n > 3 AND fx = lx AND fy = ly AS is_area FROM o""")
def resolve_way_geometry(t: Town):
    rows = J.resolve_way_geometry(t.way_nodes, t.nodes)
    weighted = F.aggregate(F.transform("points", lambda p, i: p["x"] * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return rows.select("way_id", F.size("points").cast("long").alias("n"), F.round(weighted, 3).alias("checksum"), "is_area")


@query("SELECT way_id, pos, node_id, CASE WHEN node_id % 11 = 0 THEN x + 0.5 ELSE x END AS x, y FROM fx_placed")
def way_node_positions(t: Town):
    placed = t.placed
    overrides = placed.filter("node_id % 11 = 0").select("way_id", "node_id", (F.col("x") + 0.5).alias("x"), "y").distinct()
    nodes = t.nodes.filter("node_id % 7 <> 0")
    return J.way_node_positions(t.way_nodes, nodes, overrides, placed.select("way_id", "pos", "x", "y"))


@query("""WITH m AS (SELECT way_id AS rel, (way_id * 7) % (SELECT max(way_id) FROM fx_ways) AS w, way_id % 3 AS role FROM fx_ways),
h AS (SELECT f.way_id, f.highway, arg_max(CASE WHEN role = 0 THEN 'outer' ELSE 'inner' END, rel) AS in_out, max(rel) FILTER (role = 0) AS r FROM fx_ways AS f JOIN m ON m.w = f.way_id GROUP BY f.way_id, f.highway)
SELECT f.way_id, coalesce(h.in_out, '') AS in_out, f.highway, CAST(h.r AS VARCHAR) AS rel FROM fx_ways AS f LEFT JOIN h ON h.way_id = f.way_id""")
def stamp_relations(t: Town):
    members = t.sql("SELECT way_id AS rel_id, (way_id * 7) % (SELECT max(way_id) FROM fx_ways) AS way_id, CASE WHEN way_id % 3 = 0 THEN 'outer' ELSE 'part' END AS role, map('rel', CAST(way_id AS STRING)) AS tags FROM fx_ways")
    rows = J.stamp_relations(t.features.withColumnRenamed("base_id", "way_id"), members)
    return rows.select("way_id", "in_out", F.try_element_at("tags", F.lit("highway")).alias("highway"), F.try_element_at("tags", F.lit("rel")).alias("rel"))


NEAR = """WITH d AS (SELECT path_id * 100000 + seq AS point_id, node_id, sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2)) AS dist FROM fx_paths AS p JOIN fx_nodes AS n ON abs(p.x - n.x) < 6 AND abs(p.y - n.y) < 6)
SELECT point_id, min(dist) AS dist FROM d WHERE dist < 6 GROUP BY point_id"""


@query(f"SELECT point_id, round(dist, 6) AS dist, round(dist / 6, 6) AS cost FROM ({NEAR}) AS n")
def nearest_within(t: Town):
    points = t.paths.select((F.col("path_id") * 100000 + F.col("seq")).alias("point_id"), "x", "y")
    near = J.nearest_within(points, t.nodes.withColumnRenamed("node_id", "ref_id"), 6.0)
    return near.select("point_id", F.round("dist", 6).alias("dist"), F.round("cost", 6).alias("cost"))


def gap(px, py, ax, ay, bx, by):
    """The distance of a point from a segment, as SQL."""
    t = f"least(greatest((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}), 0), 0), 1)"
    t = f"coalesce({t}, 0)"
    return f"sqrt(pow({px} - {ax} - {t} * ({bx} - {ax}), 2) + pow({py} - {ay} - {t} * ({by} - {ay}), 2))"


#: Courses with their smallest way and segment; each point's nearest in whole micrometres.
PROJ = f"""WITH p AS (SELECT path_id * 100000 + seq AS point_id, x AS px, y AS py FROM fx_paths WHERE path_id % 100 = 0),
s AS (SELECT x1, y1, x2, y2, min(struct_pack(w := way_id, s := seg)) AS m FROM fx_segments GROUP BY x1, y1, x2, y2)
SELECT point_id, min(struct_pack(d := round({gap("px", "py", "x1", "y1", "x2", "y2")}, 6), m := m)) AS n FROM p CROSS JOIN s GROUP BY point_id"""


@query(f"SELECT point_id, n.m.w AS way_id, n.m.s AS seg, round(n.d, 5) AS dist FROM ({PROJ}) AS n")
def snap_to_edge(t: Town):
    points = t.paths.filter("path_id % 100 = 0").select((F.col("path_id") * 100000 + F.col("seq")).alias("point_id"), "x", "y")
    return J.snap_to_edge(points, t.segments).select("point_id", "way_id", "seg", F.round(F.round("dist", 6), 5).alias("dist"))


def drawn_ends(t: Town):
    """Both ends of paths, as drawn ways of negative id."""
    rows = t.sql("SELECT path_id, seq, x, y, max(seq) OVER (PARTITION BY path_id) AS hi FROM fx_paths").filter("seq = 0 or seq = hi")
    return rows.select((-F.col("path_id")).alias("way_id"), F.col("seq").alias("pos"), "x", "y")


ENDS = "p AS (SELECT -path_id AS drawn, seq AS pos, x AS px, y AS py FROM (SELECT *, max(seq) OVER (PARTITION BY path_id) AS hi FROM fx_paths) AS q WHERE seq = 0 OR seq = hi)"
SNAPS = f"""WITH {ENDS},
c AS (SELECT drawn, p.pos, way_id, seg, length, round(coalesce(least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif(length * length, 0), 0), 1), 0), 6) AS t, round({gap("px", "py", "x1", "y1", "x2", "y2")}, 6) AS d FROM p JOIN fx_segments AS s ON px BETWEEN least(x1, x2) - 5 AND greatest(x1, x2) + 5 AND py BETWEEN least(y1, y2) - 5 AND greatest(y1, y2) + 5),
j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drawn, pos ORDER BY d, way_id, seg) AS rn FROM c WHERE d <= 5) AS q WHERE rn = 1)"""


@query(f"{SNAPS} SELECT drawn AS way_id, pos, way_id AS to_way, seg, t, round(d, 5) AS dist FROM j")
def endpoint_edge_join(t: Town):
    out = J.endpoint_edge_join(drawn_ends(t), t.segments)
    return out.select("way_id", "pos", "to_way", "seg", F.round("t", 6).alias("t"), F.round(F.round("dist", 6), 5).alias("dist"))


@query("""SELECT path_id * 100000 + seq AS point_id, area_id FROM fx_piled_paths AS p JOIN fx_piled_boxes AS b ON p.x >= min_x AND p.x < max_x AND p.y >= min_y AND p.y < max_y""")
def points_in_polygons(t: Town):
    """The areas are squares along the axes; the ray rule takes the low sides in and leaves the high ones out. All lie in one box, so pairs grow with the square of the tables."""
    points = t.piled_paths.select((F.col("path_id") * 100000 + F.col("seq")).alias("point_id"), "x", "y")
    return J.points_in_polygons(points, t.piled_ring)


CELLS2 = "SELECT b.area_id, i AS ix, j AS iy, min_x + i * 0.5 AS x, min_y + j * 0.5 AS y FROM fx_boxes AS b, LATERAL (SELECT unnest(range(CAST(ceil((max_x - min_x) / 0.5) AS BIGINT))) AS i) AS a, LATERAL (SELECT unnest(range(CAST(ceil((max_y - min_y) / 0.5) AS BIGINT))) AS j) AS c"


@query(f"""WITH c AS ({CELLS2}), o AS (SELECT DISTINCT x, y FROM c)
SELECT x, y FROM o WHERE NOT EXISTS (SELECT 1 FROM fx_segments AS s WHERE o.x BETWEEN least(x1, x2) - 3 AND greatest(x1, x2) + 3 AND o.y BETWEEN least(y1, y2) - 3 AND greatest(y1, y2) + 3
  AND sqrt(pow(o.x - x1 - least(greatest(((o.x - x1) * (x2 - x1) + (o.y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1) * (x2 - x1), 2) + pow(o.y - y1 - least(greatest(((o.x - x1) * (x2 - x1) + (o.y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1) * (y2 - y1), 2)) <= 3)""")
def obstacles_minus_paths(t: Town):
    from ..operators.raster import make_cells

    cells = make_cells(t.boxes, 0.5).select(F.struct("x", "y").alias("point_id"), "x", "y").distinct()
    return J.obstacles_minus_paths(cells, t.area_ring, t.segments, 3.0).select("x", "y")


def turn(ax, ay, bx, by, px, py):
    return f"sign(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


LEG, EDGE = ("l.x1", "l.y1", "l.x2", "l.y2"), ("e.x1", "e.y1", "e.x2", "e.y2")
CROSS = f"({turn(*LEG, 'e.x1', 'e.y1')} <> {turn(*LEG, 'e.x2', 'e.y2')} AND {turn(*EDGE, 'l.x1', 'l.y1')} <> {turn(*EDGE, 'l.x2', 'l.y2')})"
GAPS = f"least({gap('l.x1', 'l.y1', *EDGE)}, {gap('l.x2', 'l.y2', *EDGE)}, {gap('e.x1', 'e.y1', *LEG)}, {gap('e.x2', 'e.y2', *LEG)})"


@query(f"""SELECT DISTINCT path_id, leg FROM fx_legs AS l JOIN fx_ring_edges AS e ON least(l.x1, l.x2) <= greatest(e.x1, e.x2) + 1 AND greatest(l.x1, l.x2) >= least(e.x1, e.x2) - 1 AND least(l.y1, l.y2) <= greatest(e.y1, e.y2) + 1 AND greatest(l.y1, l.y2) >= least(e.y1, e.y2) - 1
WHERE {CROSS} OR {GAPS} <= 0.25 UNION SELECT path_id, leg FROM fx_legs AS l JOIN fx_boxes AS b ON l.x1 >= min_x AND l.x1 < max_x AND l.y1 >= min_y AND l.y1 < max_y""")
def leg_collisions(t: Town):
    return J.leg_collisions(t.legs, t.area_ring)


def raster(t: Town):
    """One cell of cost a lattice node; nodes with a bollard are blocked."""
    return t.nodes.select(((F.col("x") - 458000) / 10).cast("int").alias("ix"), ((F.col("y") - 5550500) / 10).cast("int").alias("iy"), F.when(F.col("barrier") == "bollard", 1.0).otherwise(F.col("node_id") % 10 / 20).alias("cost"))


def cell_lines(t: Town):
    cell = lambda c, low: F.floor((F.col(c) - low) / 10).cast("long")
    return t.legs.select("path_id", "leg", cell("x1", 458000).alias("x0"), cell("y1", 5550500).alias("y0"), cell("x2", 458000).alias("x1"), cell("y2", 5550500).alias("y1"))


LINES = """l AS (SELECT path_id, leg, CAST(floor((x1 - 458000) / 10) AS BIGINT) AS x0, CAST(floor((y1 - 5550500) / 10) AS BIGINT) AS y0, CAST(floor((x2 - 458000) / 10) AS BIGINT) AS x1, CAST(floor((y2 - 5550500) / 10) AS BIGINT) AS y1 FROM fx_legs),
m AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS mj, least(abs(x1 - x0), abs(y1 - y0)) AS mn, abs(x1 - x0) > abs(y1 - y0) AS flat, CASE WHEN x1 > x0 THEN 1 ELSE -1 END AS sx, CASE WHEN y1 > y0 THEN 1 ELSE -1 END AS sy FROM l),
k AS (SELECT *, unnest(range(mj + 1)) AS k FROM m),
b AS (SELECT *, CASE WHEN mj = 0 THEN 0 ELSE greatest(0, CAST(ceil(CAST(2 * k * mn - mj AS DOUBLE) / (2 * mj)) AS BIGINT)) END AS s FROM k),
cells AS (SELECT path_id, leg, k, x0 + sx * CASE WHEN flat THEN k ELSE s END AS ix, y0 + sy * CASE WHEN flat THEN s ELSE k END AS iy FROM b)"""


@query(f"WITH {LINES} SELECT path_id, leg, k, ix, iy FROM cells")
def line_cells(t: Town):
    return J.line_cells(cell_lines(t), ("path_id", "leg"))


COSTS = "r AS (SELECT CAST((x - 458000) / 10 AS INT) AS ix, CAST((y - 5550500) / 10 AS INT) AS iy, CASE WHEN barrier = 'bollard' THEN 1 ELSE CAST(node_id % 10 AS DOUBLE) / 20 END AS cost FROM fx_nodes)"


@query(f"""WITH {LINES}, {COSTS}, g AS (SELECT path_id, leg, coalesce(avg(cost), 0) AS a, coalesce(max(cost) >= 1, false) AS blocked FROM cells LEFT JOIN r ON cells.ix = r.ix AND cells.iy = r.iy GROUP BY path_id, leg)
SELECT g.path_id, g.leg, round(a, 9) AS avg_cost, blocked, CASE WHEN NOT blocked THEN round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) * (1 + 5 * a), 5) END AS cost FROM g JOIN l ON g.path_id = l.path_id AND g.leg = l.leg""")
def segment_cost(t: Town):
    out = J.segment_cost(cell_lines(t), raster(t), ("path_id", "leg"))
    return out.select("path_id", "leg", F.round("avg_cost", 9).alias("avg_cost"), "blocked", F.round("cost", 5).alias("cost"))


@query(f"WITH {LINES}, {COSTS} SELECT path_id, leg, round(coalesce(avg(cost), 0), 9) AS avg_cost FROM cells LEFT JOIN r ON cells.ix = r.ix AND cells.iy = r.iy GROUP BY path_id, leg")
def segment_avg_cost(t: Town):
    return J.segment_cost(cell_lines(t), raster(t), ("path_id", "leg")).select("path_id", "leg", F.round("avg_cost", 9).alias("avg_cost"))


@query()
def line_of_sight_prune(t: Town):
    cell = lambda c, low: F.floor((F.col(c) - low) / 10).cast("long")
    paths = t.paths.select("path_id", "seq", cell("x", 458000).alias("ix"), cell("y", 5550500).alias("iy"))
    return J.line_of_sight_prune(paths, raster(t))


@query("SELECT a.node_id, a.way_id AS a, b.way_id AS b FROM (SELECT DISTINCT node_id, way_id FROM fx_foot) AS a JOIN (SELECT DISTINCT node_id, way_id FROM fx_foot) AS b ON a.node_id = b.node_id AND a.way_id < b.way_id")
def footways_near_junction(t: Town):
    return J.footways_near_junction(t.foot)


@query("SELECT f.node_id, way_id, hub FROM (SELECT DISTINCT node_id, way_id FROM fx_foot) AS f JOIN (SELECT node_id, min(way_id) AS hub FROM fx_foot GROUP BY node_id HAVING count(DISTINCT way_id) > 1) AS h ON h.node_id = f.node_id")
def junction_hubs(t: Town):
    return J.junction_hubs(t.foot)


@query("SELECT node_id, count, x, y, CAST(1.5 AS DOUBLE) AS radius FROM fx_crossroads")
def footway_crossroads(t: Town):
    return A.footway_crossroads(t.foot, t.nodes)


@query("""WITH l AS (SELECT node_id, 0.8 * x - 0.6 * y + 12.5 AS x, 0.6 * x + 0.8 * y - 7.25 AS y FROM fx_crossroads)
SELECT row_number() OVER (ORDER BY node_id) - 1 AS pose_id, node_id, round(x, 6) AS x, round(y, 6) AS y, CAST(0 AS DOUBLE) AS z FROM l WHERE x BETWEEN -2964000 AND -2963800 AND y BETWEEN 4715100 AND 4715600""")
def intersection_poses(t: Town):
    out = A.intersection_poses(A.footway_crossroads(t.foot, t.nodes), ROT, (-2964000.0, 4715100.0, -2963800.0, 4715600.0))
    return out.select("pose_id", "node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


def shaped(t: Town):
    shapes = J.resolve_way_geometry(t.way_nodes, t.nodes)
    return classified(t).join(shapes.withColumnRenamed("way_id", "base_id"), "base_id", "left").withColumn("map_id", F.lit(1))


@query("""WITH l AS (SELECT way_id, sum(length) AS len FROM fx_segments GROUP BY way_id), p AS (SELECT max(x) - min(x) AS w, max(y) - min(y) AS h FROM fx_placed)
SELECT 1 AS map_id, count(*) FILTER (category = 'road') AS n_road, count(*) FILTER (category = 'footway') AS n_footway, count(*) FILTER (category = 'barrier') AS n_barrier,
round(sum(CASE WHEN category = 'footway' THEN coalesce(len, 0) END), 3) AS footway_length, round(sum(CASE WHEN category = 'footway' THEN 2 * coalesce(len, 0) + 6 * pi() END), 3) AS footway_outline, max(w) * max(h) AS bbox_area, (SELECT count(DISTINCT path_id) FROM fx_paths) AS n_annotations
FROM fx_class AS c LEFT JOIN l ON c.way_id = l.way_id CROSS JOIN p""")
def map_stats(t: Town):
    out = A.map_stats(shaped(t), t.paths.select(F.lit(1).alias("map_id"), "path_id").distinct())
    return out.select("map_id", "n_road", "n_footway", "n_barrier", F.round("footway_length", 3).alias("footway_length"), F.round("footway_outline", 3).alias("footway_outline"), "bbox_area", "n_annotations")


@query("SELECT 1 AS map_id, count(*) FILTER (category = 'road') AS road, count(*) FILTER (category = 'footway') AS footway, count(*) FILTER (category = 'barrier') AS barrier, (SELECT count(*) FROM fx_crossroads) AS crossroad FROM fx_class")
def category_counts(t: Town):
    crossings = A.footway_crossroads(t.foot, t.nodes).select(F.lit(1).alias("map_id"), F.lit("crossroad").alias("category"))
    return A.category_counts(classified(t).select(F.lit(1).alias("map_id"), "category").unionByName(crossings))


@query("SELECT category, coalesce(highway, barrier, 'other') AS subtype, count(*) AS count FROM fx_class GROUP BY ALL")
def subtype_counts(t: Town):
    return A.subtype_counts(classified(t))


LABELS = """WITH RECURSIVE e AS (SELECT DISTINCT a.way_id AS a, b.way_id AS b FROM fx_foot AS a JOIN fx_foot AS b ON a.node_id = b.node_id),
r(a, b) AS (SELECT DISTINCT way_id, way_id FROM fx_foot UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""


@query(f"{LABELS} SELECT a AS way_id, min(b) AS component FROM r GROUP BY a")
def connected_components(t: Town):
    return A.connected_components(t.foot)


@query(f"{LABELS}, c AS (SELECT a AS way_id, min(b) AS component FROM r GROUP BY a) SELECT component, count(*) AS ways FROM c GROUP BY component")
def component_sizes(t: Town):
    return A.component_sizes(A.connected_components(t.foot))


@query("SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM fx_segments UNION ALL SELECT dst FROM fx_segments) AS u GROUP BY node_id")
def node_degree(t: Town):
    from ..operators.routing import build_graph

    return A.node_degree(build_graph(t.segments))


@query(f"""{LABELS}, c AS (SELECT a AS way_id, min(b) AS component FROM r GROUP BY a)
SELECT 'missing_geometry' AS rule, CAST(way_id AS VARCHAR) AS feature_id, NULL AS detail FROM fx_class WHERE n < 2
UNION ALL SELECT 'missing_nodes', CAST(way_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM fx_way_nodes WHERE node_id % 97 = 0 GROUP BY way_id
UNION ALL SELECT 'ambiguous_id', CAST(way_id AS VARCHAR), 'barrier,' || category FROM fx_class WHERE way_id % 1000 = 0 AND category <> 'barrier'
UNION ALL SELECT 'missing_metadata', NULL, 'zone_letter' UNION ALL SELECT 'disconnected', NULL, CAST(count(DISTINCT component) AS VARCHAR) FROM c HAVING count(DISTINCT component) > 1""")
def validate_map(t: Town):
    one = F.lit(1).alias("map_id")
    maps = t.spark.range(1).select(one, F.lit(33).alias("zone_number"), F.lit(None).cast("string").alias("zone_letter"))
    rows = classified(t).join(t.ways.select(F.col("way_id").alias("base_id"), "n"), "base_id").select(one, "category", "base_id", (F.col("n") > 1).alias("has_geometry"))
    twice = rows.filter("base_id % 1000 = 0 and category <> 'barrier'").select("map_id", F.lit("barrier").alias("category"), "base_id", F.lit(True).alias("has_geometry"))
    ways = t.way_nodes.join(classified(t).select(F.col("base_id").alias("way_id"), "category"), "way_id").select(one, "category", "way_id", "node_id")
    out = A.validate_map(maps, rows.unionByName(twice), ways, t.nodes.filter("node_id % 97 <> 0").select(one, "node_id"))
    return out.select("rule", "feature_id", "detail")


@query("SELECT node_id, min(way_id * 100 + pos) AS ord FROM fx_way_nodes GROUP BY node_id")
def dedupe_nodes(t: Town):
    return A.dedupe_nodes(t.way_nodes.select("node_id", (F.col("way_id") * 100 + F.col("pos")).alias("ord")))


@query()
def merge_way_chains(t: Town):
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda p: p["node_id"])
    ways = t.way_nodes.groupBy("way_id").agg(nodes.alias("nodes"))
    return A.merge_way_chains(ways.select(F.floor(F.col("way_id") / 100).alias("rel_id"), F.col("way_id").alias("ord"), "way_id", "nodes"))


@query("SELECT path_id, greatest(min(x) - 50, 458100) AS min_x, greatest(min(y) - 50, 5550500) AS min_y, least(max(x) + 50, 458400) AS max_x, least(max(y) + 50, 5550800) AS max_y FROM fx_paths GROUP BY path_id")
def bbox_agg(t: Town):
    return A.bbox_agg(t.paths, (458100.0, 5550500.0, 458400.0, 5550800.0))


@query("SELECT path_id, greatest(min(x) - 20, 458100) AS min_x, greatest(min(y) - 20, 5550500) AS min_y, least(max(x) + 20, 458400) AS max_x, least(max(y) + 20, 5550800) AS max_y FROM fx_paths GROUP BY path_id")
def planning_window(t: Town):
    return A.planning_window(t.paths, (458100.0, 5550500.0, 458400.0, 5550800.0), 20.0)


@query("SELECT category, CAST(way_id AS VARCHAR) AS feature_id FROM fx_class UNION ALL SELECT 'crossroad', 'c' || node_id FROM fx_crossroads UNION ALL SELECT 'waypoint', 'wp_' || path_id || '_' || seq FROM fx_paths")
def all_features(t: Town):
    ways = classified(t).select("category", F.col("base_id").cast("string").alias("feature_id"))
    crossings = A.footway_crossroads(t.foot, t.nodes).select(F.lit("crossroad").alias("category"), F.concat(F.lit("c"), "node_id").alias("feature_id"))
    points = t.paths.select(F.lit("waypoint").alias("category"), F.concat_ws("_", F.lit("wp"), "path_id", "seq").alias("feature_id"))
    return S.all_features(ways, crossings, points)


@query("SELECT way_id AS base_id, NULL::DOUBLE AS x FROM fx_class WHERE category = 'barrier' UNION ALL SELECT -node_id, x FROM fx_nodes WHERE barrier = 'block' AND node_id NOT IN (SELECT node_id FROM fx_way_nodes)")
def barriers_union(t: Town):
    ways = C.way_kind_filter(classified(t), ("barrier",)).select("base_id")
    nodes = C.obstacle_nodes(t.tagged_nodes, t.way_nodes, t.rules(("barrier", "block"))).select((-F.col("node_id")).alias("base_id"), "x")
    return S.barriers_union(ways, nodes).select("base_id", "x")


@query("SELECT node_id, CASE WHEN node_id % 13 = 0 THEN x + 1 ELSE x END AS x, y FROM fx_nodes")
def effective_nodes(t: Town):
    return S.effective_nodes(t.nodes, t.nodes.filter("node_id % 13 = 0").withColumn("x", F.col("x") + 1))


@query("SELECT node_id FROM fx_nodes WHERE node_id NOT IN (SELECT node_id FROM fx_way_nodes)")
def ids_except(t: Town):
    return S.ids_except(t.nodes.select("node_id"), t.way_nodes, "node_id")


@query("SELECT way_id, CAST(way_id AS VARCHAR) || ':' || pos AS rendered, way_id AS base_id, pos AS seg, 'Way_' || way_id || '__a' AS safe FROM fx_way_nodes")
def split_virtual_id(t: Town):
    rows = t.way_nodes.withColumn("rendered", T.render_id(F.col("way_id"), F.col("pos")))
    base, seg = T.split_virtual_id(F.col("rendered"))
    return rows.select("way_id", "rendered", base.alias("base_id"), seg.alias("seg"), T.sanitize_name(F.concat(F.lit("Way "), "way_id", F.lit("/!a"))).alias("safe"))


@query("SELECT way_id AS base_id, coalesce(surface, 'asphalt') AS surface, lower(coalesce(highway, barrier) || coalesce(' ' || surface, '') || ' x') AS text FROM fx_ways")
def tags_merge(t: Town):
    tags = T.tags_merge(F.col("tags"), F.create_map(F.lit("zz"), F.lit("X")))
    return t.features.select("base_id", T.tag_or_default(F.col("tags"), "surface", "asphalt").alias("surface"), T.tags_text(tags).alias("text"))


@query("SELECT way_id, 'line' AS kind, n, round(sx, 3) AS sx FROM (SELECT way_id, count(*) AS n, sum(x) AS sx FROM fx_placed GROUP BY way_id) AS p")
def wkt_to_geom(t: Town):
    """Lines written as WKT and read back."""
    shapes = J.resolve_way_geometry(t.way_nodes, t.nodes)
    text = shapes.select("way_id", T.geom_to_wkt(F.lit("line"), F.array("points")).alias("wkt"))
    g = text.select("way_id", T.wkt_to_geom(F.col("wkt")).alias("g"))
    total = F.aggregate(F.get("g.rings", F.lit(0)), F.lit(0.0), lambda s, p: s + p["x"])
    return g.select("way_id", F.col("g.kind").alias("kind"), F.size(F.get("g.rings", F.lit(0))).cast("long").alias("n"), F.round(total, 3).alias("sx"))


@query("SELECT way_id, pos = 0 OR pos = max(pos) OVER (PARTITION BY way_id) AS is_end, pos FROM fx_way_nodes")
def endpoint_flag(t: Town):
    return S.endpoint_flag(t.way_nodes).select("way_id", "is_end", "pos")


