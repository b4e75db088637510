"""Segments, splits and paths; graphs and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import routing as R
from ..operators import sequences as S
from .feature_queries import SNAPS, drawn_ends, raster
from .fixtures import Town, query


@query("SELECT way_id, seg, src, dst, round(length, 6) AS length FROM fx_segments")
def way_segments(t: Town):
    return S.way_segments(t.way_nodes, t.nodes).select("way_id", "seg", "src", "dst", F.round("length", 6).alias("length"))


@query("""WITH w AS (SELECT way_id, pos, node_id, max(pos) OVER (PARTITION BY way_id) AS hi, first_value(node_id) OVER (PARTITION BY way_id ORDER BY pos) = last_value(node_id) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AND count(*) OVER (PARTITION BY way_id) > 1 AS closed FROM fx_way_nodes),
c AS (SELECT *, CASE WHEN node_id % 3 = 0 AND pos > 0 AND pos < hi AND NOT closed THEN 1 ELSE 0 END AS cut FROM w),
p AS (SELECT *, sum(cut) OVER (PARTITION BY way_id ORDER BY pos) - cut AS part, sum(cut) OVER (PARTITION BY way_id) AS cuts FROM c),
b AS (SELECT way_id, pos, node_id, part, cuts FROM p UNION ALL SELECT way_id, pos, node_id, part + 1, cuts FROM p WHERE cut = 1)
SELECT way_id AS base_id, CASE WHEN cuts > 0 THEN CAST(part AS INT) END AS seg, row_number() OVER (PARTITION BY way_id, part ORDER BY pos) - 1 AS pos, node_id FROM b""")
def split_ways(t: Town):
    return S.split_ways(t.way_nodes, t.way_nodes.filter("node_id % 3 = 0"))


@query("""WITH l AS (SELECT *, lag(x) OVER (PARTITION BY path_id ORDER BY seq) AS lx, lag(y) OVER (PARTITION BY path_id ORDER BY seq) AS ly, count(*) OVER (PARTITION BY path_id) AS n FROM fx_paths)
SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY seq) - 1 AS seq, x, y FROM l WHERE lx IS NULL OR n <= 2 OR sqrt(pow(x - lx, 2) + pow(y - ly, 2)) > 100.25""")
def drop_close_points(t: Town):
    return S.drop_close_points(t.paths, 100.25)


@query("SELECT path_id, max(seq) OVER (PARTITION BY path_id) - seq AS seq, x, y FROM fx_paths")
def reverse_path(t: Town):
    return S.reverse_path(t.paths)


@query("SELECT path_id, seq, x, y FROM (SELECT *, max(seq) OVER (PARTITION BY path_id) AS hi FROM fx_paths) AS p WHERE seq % 10 = 0 OR seq = hi")
def subsample_path(t: Town):
    return S.subsample_path(t.paths)


@query("SELECT path_id, seq + 1 AS seq, x, y FROM fx_paths UNION ALL SELECT path_id, 0, x - 1, y FROM fx_paths WHERE seq = 0")
def prepend_position(t: Town):
    return S.prepend_position(t.paths, t.paths.filter("seq = 0").withColumn("x", F.col("x") - 1))


@query("""WITH a AS (SELECT op, event_id, 0 AS kind, (row_number() OVER (PARTITION BY op ORDER BY event_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY op) AS r FROM fx_edit_log WHERE NOT is_undo),
b AS (SELECT op, event_id, 1, (row_number() OVER (PARTITION BY op ORDER BY event_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY op) FROM fx_edit_log WHERE is_undo)
SELECT op, event_id, kind, row_number() OVER (PARTITION BY op ORDER BY r, kind, event_id) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) AS u""")
def interleave_changes(t: Town):
    log = t.edit_log.select("op", "event_id", "is_undo")
    return S.interleave_changes(log.filter("not is_undo").drop("is_undo"), log.filter("is_undo").drop("is_undo"), "event_id", ("op",))


@query("""WITH l AS (SELECT *, lag(x) OVER (PARTITION BY path_id ORDER BY seq) AS lx, lag(y) OVER (PARTITION BY path_id ORDER BY seq) AS ly, count(*) OVER (PARTITION BY path_id) AS n FROM fx_paths)
SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY seq) - 1 AS seq, x, y FROM l WHERE n > 1 AND (lx IS NULL OR sqrt(pow(x - lx, 2) + pow(y - ly, 2)) > 0.001)""")
def path_concat(t: Town):
    """Paths cut into legs and joined again are the paths, less points that don't move on."""
    legs = t.legs
    ends = [legs.select("path_id", "leg", F.lit(i).alias("pos"), F.col(x).alias("x"), F.col(y).alias("y")) for i, (x, y) in enumerate((("x1", "y1"), ("x2", "y2")))]
    return S.path_concat(ends[0].unionByName(ends[1]))


@query("""WITH k AS (SELECT 0.6e0 / (1.1e0 + sqrt(0.85e0)) AS r, 0.5e0 / sqrt(0.85e0) AS c),
p AS (SELECT path_id, seq, x, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY path_id) - 1 AS n, first_value(x) OVER w AS ox, first_value(y) OVER w AS oy FROM fx_paths WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
u AS (SELECT a.path_id, a.i, k.c * sum(pow(k.r, abs(a.i - b.i)) * (b.x - b.ox)) AS ux, k.c * sum(pow(k.r, abs(a.i - b.i)) * (b.y - b.oy)) AS uy FROM p AS a JOIN p AS b ON a.path_id = b.path_id, k GROUP BY a.path_id, a.i, k.c),
e AS (SELECT p.*, u.ux, u.uy, a.ux AS hx, a.uy AS hy, l.x - l.ox - b.ux AS tx, l.y - l.oy - b.uy AS ty FROM p JOIN u ON p.path_id = u.path_id AND p.i = u.i JOIN u AS a ON p.path_id = a.path_id AND a.i = 0 JOIN u AS b ON p.path_id = b.path_id AND b.i = p.n JOIN p AS l ON l.path_id = p.path_id AND l.i = p.n),
s AS (SELECT path_id, seq, x, y, i, n, ox + ux + (pow(r, i) * (-hx - tx * pow(r, n)) + pow(r, n - i) * (tx + hx * pow(r, n))) / nullif(1 - pow(r, 2 * n), 0) AS sx, oy + uy + (pow(r, i) * (-hy - ty * pow(r, n)) + pow(r, n - i) * (ty + hy * pow(r, n))) / nullif(1 - pow(r, 2 * n), 0) AS sy FROM e, k)
SELECT path_id, seq, round(CASE WHEN i > 0 AND i < n THEN sx ELSE x END, 4) AS x, round(CASE WHEN i > 0 AND i < n THEN sy ELSE y END, 4) AS y FROM s""")
def smooth_paths(t: Town):
    """Where sweeps end, to a tenth of a millimetre; the SQL sums every pair of a path's points."""
    return S.smooth_paths(t.paths).select("path_id", "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def simplify_paths(t: Town):
    return S.simplify_paths(t.paths, 25.0)



@query(f"{SNAPS} SELECT drawn, pos, way_id, seg, t, d AS dist, row_number() OVER (PARTITION BY way_id, seg ORDER BY t, d, drawn, pos) AS place FROM j")
def splits_along_segment(t: Town):
    joined = J.endpoint_edge_join(drawn_ends(t), t.segments)
    return S.splits_along_segment(joined.select(F.col("way_id").alias("drawn"), "pos", F.col("to_way").alias("way_id"), "seg", F.round("t", 6).alias("t"), F.round("dist", 6).alias("dist")))


@query("SELECT way_id, arg_min(node_id, (length, node_id)) AS node_id FROM (SELECT way_id, src AS node_id, length FROM fx_segments) AS s GROUP BY way_id")
def nearest_one(t: Town):
    return S.nearest_one(t.segments.select("way_id", F.col("src").alias("node_id"), "length"), "way_id", "length", "node_id").select("way_id", "node_id")


@query("SELECT event_id, op, way_id FROM fx_edit_log ORDER BY ts DESC, event_id DESC LIMIT 25")
def latest_changes(t: Town):
    return S.latest_changes(t.edit_log, 25).select("event_id", "op", "way_id")


@query("SELECT src, dst, length AS weight, way_id, seg FROM fx_segments UNION ALL SELECT dst, src, length, way_id, seg FROM fx_segments")
def build_graph(t: Town):
    return R.build_graph(t.segments)


@query()
def splice_annotations(t: Town):
    joined = J.endpoint_edge_join(drawn_ends(t), t.segments).withColumn("node_id", F.col("way_id"))
    out = R.splice_annotations(t.segments, joined)
    return out.select("src", "dst", F.round("weight", 6).alias("weight"))


def requests(t: Town):
    """Every footway's first node to its last, over the footways' graph."""
    w = t.sql("SELECT way_id AS req, arg AS src, last AS dst FROM (SELECT way_id, min_by(node_id, pos) AS arg, max_by(node_id, pos) AS last FROM fx_foot GROUP BY way_id) AS f WHERE arg <> last")
    return w


def node_cells(t: Town):
    """The partition of the town's nodes that searches go over: squares of 80 m and more."""
    return R.position_cells(t.nodes.select(F.col("node_id").alias("node"), "x", "y"), 80.0)


def foot_segments(t: Town):
    return t.sql("SELECT s.* FROM fx_segments AS s JOIN fx_ways AS w ON s.way_id = w.way_id WHERE w.highway IN ('footway', 'path')")


@query()
def shortest_paths(t: Town):
    out = R.shortest_paths(R.build_graph(foot_segments(t)).select("src", "dst", "weight"), requests(t), cells=node_cells(t))
    return out.select("req", "seq", "node", F.round("dist", 6).alias("dist"))


@query()
def route_waypoints(t: Town):
    """Requests: each leg of the paths whose id is divisible by 100, as a path of two points, by all roads and footways. Many legs' ends hang together by no way; those go."""
    legs = t.legs.filter("path_id % 100 = 0").withColumn("path_id", F.col("path_id") * 100_000 + F.col("leg"))
    ends = [legs.select("path_id", F.lit(i).alias("seq"), F.col(f"x{i + 1}").alias("x"), F.col(f"y{i + 1}").alias("y")) for i in (0, 1)]
    out = R.route_waypoints(ends[0].unionByName(ends[1]), t.segments, t.nodes)
    return out.select(F.floor(F.col("path_id") / 100_000).alias("path_id"), (F.col("path_id") % 100_000).alias("leg"), "seq", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def lattice(t: Town):
    cells = raster(t)
    return cells.withColumn("blocked", F.col("cost") >= 1)


@query()
def least_cost_raster_paths(t: Town):
    """From each leg's start cell to its end cell."""
    cell = lambda c, low: F.floor((F.col(c) - low) / 10).cast("int")
    wanted = t.legs.select(F.struct("path_id", "leg").alias("req"), cell("x1", 458000).alias("x0"), cell("y1", 5550500).alias("y0"), cell("x2", 458000).alias("x1"), cell("y2", 5550500).alias("y1"))
    return R.least_cost_raster_paths(lattice(t), wanted).select("req.path_id", "req.leg", "seq", "ix", "iy", F.round("dist", 6).alias("dist"))


@query()
def replan_paths(t: Town):
    out = R.replan_paths(t.paths, lattice(t), t.area_ring, (458000.0, 5550500.0), 10.0)
    return out.select("path_id", "seq", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("SELECT path_id, CASE WHEN path_id % 60 = 0 THEN 1 WHEN path_id % 40 = 0 THEN 0 ELSE -1 END AS state FROM (SELECT DISTINCT path_id FROM fx_paths) AS p")
def path_changed(t: Town):
    new = t.paths.filter("path_id % 60 <> 0").withColumn("x", F.col("x") + F.when(F.col("path_id") % 40 == 0, 0.2).otherwise(0.05))
    return R.path_changed(t.paths, new)
