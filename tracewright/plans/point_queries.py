"""Projections, poses and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import projection as P
from ..operators import aggregates as A
from .fixtures import Town, query

ROT = [[0.8, -0.6, 0.0, 12.5], [0.6, 0.8, 0.0, -7.25], [0.0, 0.0, 1.0, 3.0], [0.0, 0.0, 0.0, 1.0]]

#: The forward series as SQL over phi (radians), d (radians from the zone's middle), in named steps.
UTM = """
s1 AS (SELECT *, radians(lat) AS phi, radians(lon - (33 * 6 - 183)) AS d FROM src),
s2 AS (SELECT *, pow(tan(phi), 2) AS t, 0.00669438 / (1 - 0.00669438) * pow(cos(phi), 2) AS c, cos(phi) * d AS a, 6378137 / sqrt(1 - 0.00669438 * pow(sin(phi), 2)) AS n,
  6378137 * ((1 - 0.00669438 / 4 - 3 * pow(0.00669438, 2) / 64 - 5 * pow(0.00669438, 3) / 256) * phi
  - (3 * 0.00669438 / 8 + 3 * pow(0.00669438, 2) / 32 + 45 * pow(0.00669438, 3) / 1024) * sin(2 * phi)
  + (15 * pow(0.00669438, 2) / 256 + 45 * pow(0.00669438, 3) / 1024) * sin(4 * phi) - 35 * pow(0.00669438, 3) / 3072 * sin(6 * phi)) AS m FROM s1),
utm AS (SELECT *, 0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * 0.00669438 / (1 - 0.00669438)) * pow(a, 5) / 120) + 500000 AS x,
  0.9996 * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * 0.00669438 / (1 - 0.00669438)) * pow(a, 6) / 720)) AS y FROM s2)"""
GPS = "SELECT robot_id, msg_id, lat, lon FROM fx_telemetry WHERE topic = 'gps'"


def gps(t: Town):
    return t.telemetry.filter("topic = 'gps'")


@query(f"WITH src AS ({GPS}), {UTM} SELECT msg_id, 33 AS zone, 'U' AS letter, round(x, 3) AS x, round(y, 3) AS y FROM utm")
def to_utm(t: Town):
    zone = P.utm_zone(F.col("lat"), F.col("lon"))
    x, y = P.to_utm(F.col("lat"), F.col("lon"), zone)
    return gps(t).select("msg_id", zone.alias("zone"), P.utm_letter(F.col("lat")).alias("letter"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("SELECT msg_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM fx_telemetry WHERE topic = 'gps'")
def to_latlon(t: Town):
    x, y = P.to_utm(F.col("lat"), F.col("lon"), F.lit(33))
    lat, lon = P.to_latlon(F.col("x"), F.col("y"), F.lit(33))
    return gps(t).select("msg_id", x.alias("x"), y.alias("y")).select("msg_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query("SELECT node_id, round(0.8 * x - 0.6 * y + 12.5, 6) AS x, round(0.6 * x + 0.8 * y - 7.25, 6) AS y, CAST(1 AS DOUBLE) AS z FROM fx_nodes")
def rigid_transform(t: Town):
    x, y, z = P.rigid_transform(F.col("x"), F.col("y"), F.lit(0.0), ROT, 1.0)
    return t.nodes.select("node_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), z.alias("z"))


@query("SELECT p.path_id, seq, round(x - (lx + hx) / 2, 6) AS x, round(y - (ly + hy) / 2, 6) AS y FROM fx_paths AS p JOIN (SELECT path_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM fx_paths GROUP BY path_id) AS b ON p.path_id = b.path_id")
def recenter(t: Town):
    return A.recenter(t.paths, ("path_id",)).select("path_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT path_id, min(x) - 150 AS min_x, min(y) - 150 AS min_y, max(x) + 150 AS max_x, max(y) + 150 AS max_y FROM fx_paths GROUP BY path_id")
def map_bounds(t: Town):
    return A.map_bounds(t.paths, 150.0, ("path_id",))


@query("SELECT robot_id, round(greatest(max(lat) - min(lat), max(lon) - min(lon)) * 0.1, 9) AS margin FROM fx_telemetry GROUP BY robot_id")
def degree_margin(t: Town):
    box = t.telemetry.groupBy("robot_id").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    return box.select("robot_id", F.round(P.degree_margin(*(F.col(c) for c in "abcd")), 9).alias("margin"))


@query("""WITH c AS (SELECT area_id, 0.8 * min_x - 0.6 * min_y + 12.5 AS ax, 0.6 * min_x + 0.8 * min_y - 7.25 AS ay, 0.8 * max_x - 0.6 * max_y + 12.5 AS bx, 0.6 * max_x + 0.8 * max_y - 7.25 AS b2 FROM fx_boxes)
SELECT area_id, round(least(ax, bx), 6) AS min_x, round(least(ay, b2), 6) AS min_y, round(greatest(ax, bx), 6) AS max_x, round(greatest(ay, b2), 6) AS max_y FROM c""")
def local_grid_bounds(t: Town):
    out = A.local_grid_bounds(t.boxes, ROT)
    return out.select("area_id", *(F.round(c, 6).alias(c) for c in out.columns if c != "area_id"))


BOXES = "SELECT robot_id AS map_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) + robot_id % 5 - 2 AS min_lon, max(lon) + robot_id % 5 - 2 + 0.001 AS max_lon FROM fx_telemetry GROUP BY robot_id"


@query(f"WITH b AS ({BOXES}), z AS (SELECT map_id, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone FROM (SELECT map_id, min_lon AS lon FROM b UNION ALL SELECT map_id, max_lon FROM b) AS u) SELECT map_id, min(zone) AS low, max(zone) AS high, min(zone) <> max(zone) AS crosses FROM z GROUP BY map_id")
def utm_zone_audit(t: Town):
    return A.utm_zone_audit(t.sql(BOXES)).select("map_id", F.array_min("zones").alias("low"), F.array_max("zones").alias("high"), "crosses")


@query(f"""WITH bx AS (SELECT robot_id, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM fx_telemetry GROUP BY robot_id),
src AS (SELECT robot_id, 0 AS corner, a AS lat, c AS lon FROM bx UNION ALL SELECT robot_id, 1, a, d FROM bx UNION ALL SELECT robot_id, 2, b, d FROM bx UNION ALL SELECT robot_id, 3, b, c FROM bx), {UTM} SELECT robot_id AS map_id, corner, round(x, 3) AS x, round(y, 3) AS y FROM utm""")
def bbox_corners(t: Town):
    boxes = t.sql("SELECT robot_id AS map_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM fx_telemetry GROUP BY robot_id")
    return A.bbox_corners(boxes).select("map_id", "corner", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"WITH src AS (SELECT msg_id, lat, lon FROM fx_telemetry), {UTM} SELECT msg_id, round(x, 3) AS x, round(y, 3) AS y, CAST(2 AS DOUBLE) AS z FROM utm")
def node_points(t: Town):
    x, y = P.to_utm(F.col("lat"), F.col("lon"), F.lit(33))
    return t.telemetry.select("msg_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.lit(2.0).alias("z"))


@query("SELECT msg_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM fx_telemetry WHERE topic = 'gps'")
def plan_path_latlon(t: Town):
    """Poses of a frame moved by the inverse of a rigid motion come back to their latitude and longitude."""
    x, y = P.to_utm(F.col("lat"), F.col("lon"), F.lit(33))
    back = [[0.8, 0.6, 0.0, -(0.8 * 12.5 + 0.6 * -7.25)], [-0.6, 0.8, 0.0, -(-0.6 * 12.5 + 0.8 * -7.25)], ROT[2], ROT[3]]
    here = gps(t).select("msg_id", x.alias("x"), y.alias("y"))
    lx, ly, _ = P.rigid_transform(F.col("x"), F.col("y"), F.lit(0.0), back)
    local = here.select("msg_id", lx.alias("x"), ly.alias("y"))
    wx, wy, _ = P.rigid_transform(F.col("x"), F.col("y"), F.lit(0.0), ROT)
    lat, lon = P.to_latlon(F.col("x"), F.col("y"), F.lit(33))
    return local.select("msg_id", wx.alias("x"), wy.alias("y")).select("msg_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(f"WITH a AS (SELECT msg_id, 90 - degrees(2 * atan2(sin(num / 20), cos(num / 20))) AS h FROM fx_telemetry WHERE topic = 'speed') SELECT msg_id, round(h - 360 * floor(h / 360), 1) AS heading FROM a")
def heading_deg(t: Town):
    half = F.col("num") / 20
    rows = t.telemetry.filter("topic = 'speed'")
    return rows.select("msg_id", P.heading_deg(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)).alias("heading"))


@query("SELECT msg_id, round(sqrt(num * num + lon * lon), 2) AS speed FROM fx_telemetry WHERE topic = 'speed'")
def ground_speed(t: Town):
    return t.telemetry.filter("topic = 'speed'").select("msg_id", P.ground_speed(F.col("num"), F.col("lon")).alias("speed"))


HAV = "2 * 6371000 * asin(sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))"
LAGGED = "SELECT robot_id, msg_id, lat, lon, lag(lat) OVER (PARTITION BY robot_id ORDER BY msg_id) AS la, lag(lon) OVER (PARTITION BY robot_id ORDER BY msg_id) AS lo FROM fx_telemetry"


@query(f"SELECT msg_id, round({HAV}, 4) AS metres FROM ({LAGGED}) AS l WHERE la IS NOT NULL")
def haversine(t: Town):
    rows = t.sql(LAGGED).filter("la is not null")
    return rows.select("msg_id", F.round(P.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 4).alias("metres"))


@query(f"WITH s AS (SELECT robot_id AS path_id, coalesce(sum({HAV}), 0) AS m FROM ({LAGGED}) AS l GROUP BY robot_id) SELECT path_id, round(m, 3) AS length_m, m > 1000 AS in_km FROM s")
def path_length_m(t: Town):
    from ..operators.sequences import path_length_m as lengths

    rows = t.telemetry.select(F.col("robot_id").alias("path_id"), F.col("msg_id").alias("seq"), "lat", "lon")
    return lengths(rows).select("path_id", F.round("length_m", 3).alias("length_m"), F.endswith("label", F.lit(" km")).alias("in_km"))


@query(f"SELECT msg_id, k, round(lat + degrees(25 * cos(k * {2 * math.pi / 8!r}) / 6371000), 9) AS lat, round(lon + degrees(25 * sin(k * {2 * math.pi / 8!r}) / (6371000 * cos(radians(lat)))), 9) AS lon FROM fx_telemetry, (SELECT unnest(range(9)) AS k) AS r WHERE topic = 'gps'")
def circle_polygon(t: Town):
    ring = P.circle_polygon(F.col("lat"), F.col("lon"), F.lit(25.0), 8)
    rows = gps(t).select("msg_id", F.posexplode(ring).alias("k", "p"))
    return rows.select("msg_id", F.col("k").cast("long").alias("k"), F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


@query("SELECT path_id, leg, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) AS length FROM fx_legs")
def seg_len(t: Town):
    return t.legs.select("path_id", "leg", F.round(G.dist(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), 6).alias("length"))


@query("""WITH a AS (SELECT area_id, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS p, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, min(x1) AS min_x, max(x1) AS max_x, avg(x1) AS cx, avg(y1) AS cy FROM fx_ring_edges GROUP BY area_id)
SELECT area_id, round(p, 4) AS perimeter, round(area, 2) AS area, min_x, max_x, round(cx, 4) AS cx, round(cy, 4) AS cy, true AS closed, round((p - sqrt(p * p - 4 * pi() * area)) / (2 * pi()), 3) AS radius FROM (
  SELECT * FROM a WHERE p * p >= 4 * pi() * area) AS b""")
def ring_measures(t: Town):
    ring = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rows = t.area_ring.groupBy("area_id").agg(ring.alias("r"))
    c, b, p, a = G.centroid(F.col("r")), G.bounds(F.col("r")), G.line_length(F.col("r")), G.ring_area(F.col("r"))
    rows = rows.select("area_id", F.round(p, 4).alias("perimeter"), F.round(a, 2).alias("area"), b["min_x"].alias("min_x"), b["max_x"].alias("max_x"), F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"), G.is_closed(F.col("r")).alias("closed"), F.round(G.recover_buffer_radius(F.round(p, 9), F.round(a, 9)), 3).alias("radius"))
    return rows
