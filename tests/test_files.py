import pytest

from tracewright.sources import files as S

GPX = '<?xml version="1.0"?><gpx version="1.1">{}</gpx>'


def test_gpx_fallback_per_file(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX.format('<!-- c --><wpt lat="1" lon="2"><ele>3</ele><name>n</name></wpt><wpt lat="4" lon="5"/><trk><trkseg><trkpt lat="9" lon="9"/></trkseg></trk>'))
    (tmp_path / "b.gpx").write_text(GPX.format('<trk><trkseg><trkpt lat="6" lon="7"/></trkseg><trkseg><trkpt lat="8" lon="7"/></trkseg></trk>'))
    (tmp_path / "c.gpx").write_text(GPX.format('<rte><rtept lat="0" lon="1"/></rte>'))
    (tmp_path / "d.gpx").write_text(GPX.format(""))
    got = sorted((r.path_id[-5], r.seq, r.lat, r.lon, r.ele, r.name) for r in S.read_gpx(spark, str(tmp_path)).collect())
    assert got == [("a", 0, 1.0, 2.0, 3.0, "n"), ("a", 1, 4.0, 5.0, None, None), ("b", 0, 6.0, 7.0, None, None), ("b", 1, 8.0, 7.0, None, None), ("c", 0, 0.0, 1.0, None, None)]


def test_legacy_maps_are_refused(spark, tmp_path):
    (tmp_path / "x.mapdata").write_bytes(b"\x80\x04abc")
    with pytest.raises(ValueError):
        S.read_mapdata(spark, str(tmp_path))


def test_map_without_crossroads(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"metadata":{"zone_number":33},"waypoints":[[1.0,2.0]],"roads":[{"id":5,"nodes":[1,2],"tags":{"highway":"primary"},"line":"LINESTRING (0 0, 1 1)"}],"footways":[],"barriers":[],"nodes_cache":{"1":{"lat":1,"lon":2,"tags":{}}}}')
    m = S.read_mapdata(spark, str(tmp_path))
    assert [(r.category, r.feature_id) for r in m["features"].collect()] == [("road", "5")] and m["nodes"].first().node_id == 1 and m["waypoints"].first().y == 2.0


def test_missing_and_corrupt_edits_are_empty(spark, tmp_path):
    assert S.read_edits(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "e.json").write_text('{"version": 1, "deleted_ways": [')
    assert S.read_edits(spark, str(tmp_path)).first().deleted_ways is None


def test_osm_elements(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"version":0.6,"elements":[{"type":"node","id":1,"lat":50.0,"lon":14.0,"tags":{"barrier":"block"}},{"type":"way","id":2,"nodes":[1,3],"tags":{"highway":"footway"}},{"type":"relation","id":9,"members":[{"type":"way","ref":2,"role":"outer"}],"tags":{"natural":"water"}}]}')
    o = S.read_osm_json(spark, str(tmp_path))
    assert o["nodes"].count() == 1 and o["ways"].first().nodes == [1, 3] and o["relation_members"].first().role == "outer"


def test_geojson_kinds(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"id":"a","properties":{},"geometry":{"type":"LineString","coordinates":[[14.0,50.0],[14.1,50.0]]}},{"id":"b","properties":{},"geometry":{"type":"Point","coordinates":[14.0,50.0]}},{"id":"c","properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[14.0,50.0],[14.1,50.0],[14.1,50.1],[14.0,50.0]]]]}}]}')
    got = {r.feature_id: r for r in S.read_geojson(spark, str(tmp_path), 33).collect()}
    assert abs(got["a"].rings[0][0].x - 428333.5525) < 1e-3 and got["b"].kind is None and got["b"].rings is None and got["c"].kind == "multipolygon" and len(got["c"].rings) == 1


def test_cloud_needs_four_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        S.write_cloud(spark.range(1).selectExpr("1.0 x", "2.0 y"), f"{tmp_path}/c")
