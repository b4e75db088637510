import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import projection as P
from tracewright.functions import text as T
from tracewright.functions.register import register

WAYS = "array<struct<x:double,y:double>>"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_utm_of_a_known_point(spark):
    x, y = P.to_utm(F.lit(50.0), F.lit(14.0), F.lit(33))
    got = one(spark, x, y)
    assert abs(got[0] - 428333.5525) < 1e-3 and abs(got[1] - 5539109.8157) < 1e-3


@pytest.mark.parametrize("lat,lon,zone,letter", [(50, 14, 33, "U"), (60, 5, 32, "V"), (78, 20, 33, "X"), (-33, 151, 56, "H"), (0, 180, 1, "N"), (84, 0, 31, "X"), (-81, 0, 31, None)])
def test_zones(spark, lat, lon, zone, letter):
    a, b = F.lit(float(lat)), F.lit(float(lon))
    assert tuple(one(spark, P.utm_zone(a, b), P.utm_letter(a))) == (zone, letter)


def test_utm_round_trip_within_a_millimetre(spark):
    rows = spark.range(500).select((F.rand(1) * 160 - 80).alias("lat"), (F.rand(2) * 360 - 180).alias("lon")).withColumn("zone", P.utm_zone(F.col("lat"), F.col("lon")))
    x, y = P.to_utm(F.col("lat"), F.col("lon"), F.col("zone"))
    rows = rows.select("*", x.alias("x"), y.alias("y"))
    lat, lon = P.to_latlon(F.col("x"), F.col("y"), F.col("zone"), F.col("lat") >= 0)
    rows = rows.withColumn("off", F.greatest(F.abs(lat - F.col("lat")), F.abs(lon - F.col("lon")) * F.cos(F.radians("lat"))))
    plain = F.abs(F.col("lon") - (F.col("zone") * 6 - 183)) <= 3
    usual, wide = rows.select(F.max(F.when(plain, F.col("off"))), F.max("off")).first()
    assert usual < 9e-9 and wide < 1e-7  # degrees; the series is less exact in the zones that are wider than 6


def test_haversine_and_poses(spark):
    r = one(spark, P.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), P.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)), P.heading_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), P.heading_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), P.ground_speed(F.lit(3.0), F.lit(4.0)), P.length_label(F.lit(1500.0)), P.length_label(F.lit(12.34)))
    assert abs(r[0] - 6371000 * math.pi / 180) < 1e-6 and r[1] is None and list(r[2:]) == [90.0, 270.0, 5.0, "1.50 km", "12.3 m"]
    ring = one(spark, P.circle_polygon(F.lit(50.0), F.lit(14.0), F.lit(100.0), 12))[0]
    assert len(ring) == 13 and abs(ring[0].lat - ring[12].lat) < 1e-12
    identity = [[float(i == j) for j in range(4)] for i in range(4)]
    moved = [[1, 0, 0, 1.0], [0, 1, 0, 2.0], [0, 0, 1, 3.0], [0, 0, 0, 1]]
    p = (F.lit(5.0), F.lit(6.0), F.lit(7.0))
    assert tuple(one(spark, *P.rigid_transform(*p, identity))) == (5, 6, 7) and tuple(one(spark, *P.rigid_transform(*p, moved, 9))) == (6, 8, 9)


def test_plane_geometry(spark):
    square = F.from_json(F.lit('[{"x":0,"y":0},{"x":4,"y":0},{"x":4,"y":4},{"x":0,"y":4},{"x":0,"y":0}]'), WAYS)
    line = F.from_json(F.lit('[{"x":0,"y":0},{"x":3,"y":4}]'), WAYS)
    point = F.from_json(F.lit('[{"x":1,"y":1}]'), WAYS)
    l = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = one(spark, G.ring_area(square), G.line_length(square), G.is_closed(square), G.is_closed(line), G.line_length(line), G.line_length(point), G.centroid(square), G.point_in_ring(*l(1, 1), square), G.point_in_ring(*l(5, 1), square), G.bounds(line))
    assert list(r[:6]) == [16, 16, True, False, 5, 0] and tuple(r[6]) == (2, 2) and (r[7], r[8]) == (True, False) and tuple(r[9]) == (0, 0, 3, 4)
    r = one(spark, G.point_segment_dist(*l(0, 5, -1, 0, 1, 0)), G.point_segment_dist(*l(3, 0, 0, 0, 0, 0)), G.segments_intersect(l(0, 0), l(2, 2), l(0, 2), l(2, 0)), G.segments_intersect(l(0, 0), l(1, 0), l(2, 0), l(3, 0)), G.segments_intersect(l(0, 0), l(2, 0), l(1, 0), l(1, 5)))
    assert list(r) == [5, 3, True, False, True]
    radius = one(spark, G.recover_buffer_radius(F.lit(2 * 10 + 2 * math.pi * 3), F.lit(2 * 10 * 3 + math.pi * 9)))[0]
    assert abs(radius - 3) < 1e-9


def test_texts(spark):
    tags = lambda s: F.from_json(F.lit(s), "map<string,string>")
    base, seg = T.split_virtual_id(F.lit("12:3"))
    b2, s2 = T.split_virtual_id(F.lit("-7"))
    b3, _ = T.split_virtual_id(F.lit("x1"))
    r = one(spark, base, seg, b2, s2, b3, T.render_id(F.lit(12), F.lit(3)), T.render_id(F.lit(12), F.lit(None).cast("int")), T.sanitize_name(F.lit("a b/ü.-_")), T.tags_merge(tags('{"a":"1","b":"2"}'), tags('{"b":"3"}')), T.tags_text(tags('{"a":"X","b":"y"}')))
    assert list(r) == [12, 3, -7, None, None, "12:3", "12", "a_b__.-_", {"a": "1", "b": "3"}, "x y"]
    wkt = "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))"
    g = T.wkt_to_geom(F.lit(wkt))
    r = one(spark, g, T.geom_to_wkt(g["kind"], g["rings"]), T.wkt_to_geom(F.lit("LINESTRING (1.5 2, -3e1 4)")), T.wkt_to_geom(F.lit("CURVE (1 2)")), T.geojson_geom(F.lit("line"), F.array(F.from_json(F.lit('[{"x":1,"y":2}]'), WAYS))), T.props_to_tags(F.lit('{"a":1,"b":null}')))
    assert len(r[0].rings) == 2 and r[1] == wkt and r[2].rings[0][1].x == -30 and r[3] is None and '"coordinates":[[1.0,2.0]]' in r[4] and r[5] == {"a": "1"}


def test_sql_functions(spark):
    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM densify(0D, 0D, 1D, 0D, 0.5D)").collect()] == [(1, 0.5, 0.0), (2, 1.0, 0.0)]
    assert [tuple(r)[1:] for r in spark.sql("SELECT * FROM grid_line(0, 0, 3, 1)").collect()][0::3] == [(0, 0), (3, 1)]
    assert spark.sql("SELECT render_feature_id(5, 2), seg_len(0, 0, 3, 4)").first()[:] == ("5:2", 5.0)
