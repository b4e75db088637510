"""Files written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..sources import files as S
from ..tables import dealt, new_path
from .feature_queries import classified
from .fixtures import Town, query


def tracks(t: Town):
    rows = t.telemetry.filter("topic = 'gps'")
    return rows.select(F.col("robot_id").alias("path_id"), F.col("msg_id").alias("seq"), "lat", "lon")


GPX = "SELECT robot_id, row_number() OVER (PARTITION BY robot_id ORDER BY msg_id) - 1 AS seq, lat, lon FROM fx_telemetry WHERE topic = 'gps'"


def back(t: Town, as_track: bool):
    path = new_path(t.spark, "gpx")
    S.write_gpx(tracks(t), path, as_track)
    rows = S.read_gpx(t.spark, f"{path}/*/*")
    return rows.select(F.regexp_extract("path_id", r"path_id=(\d+)", 1).cast("long").alias("robot_id"), "seq", "lat", "lon")


@query(GPX)
def read_gpx(t: Town):
    return back(t, False)


@query(GPX)
def write_gpx(t: Town):
    return back(t, True)


def osm_folder(t: Town) -> str:
    """Element files of the town, one for each five thousand ids, so that files grow in number and not in size."""
    el = "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>"
    empty = lambda kind: F.lit(None).cast(kind)
    nodes = t.tagged_nodes.select(F.lit("node").alias("type"), F.col("node_id").alias("id"), F.col("y").alias("lat"), F.col("x").alias("lon"), empty("array<bigint>").alias("nodes"), "tags")
    members = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda p: p["node_id"])
    ways = t.way_nodes.groupBy("way_id").agg(members.alias("nodes")).join(t.features.withColumnRenamed("base_id", "way_id"), "way_id")
    ways = ways.select(F.lit("way").alias("type"), F.col("way_id").alias("id"), empty("double").alias("lat"), empty("double").alias("lon"), "nodes", "tags")
    rows = nodes.unionByName(ways).withColumn("part", F.floor(F.col("id") / 5000))
    names = [x.split()[0] for x in el.split(", ")]
    text = F.concat(F.lit('{"elements":['), F.array_join(F.collect_list(F.to_json(F.struct(*names))), ","), F.lit("]}"))
    path = new_path(t.spark, "osm")
    rows.groupBy("part").agg(text.alias("json")).write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
    return path


@query("SELECT 'node' AS kind, node_id AS id, x, barrier AS tag, 0 AS n FROM fx_nodes UNION ALL SELECT 'way', way_id, NULL, highway, n FROM fx_ways")
def read_osm_json(t: Town):
    read = S.read_osm_json(t.spark, f"{osm_folder(t)}/*/*")
    nodes = read["nodes"].select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("lon").alias("x"), F.try_element_at("tags", F.lit("barrier")).alias("tag"), F.lit(0).cast("long").alias("n"))
    ways = read["ways"].select(F.lit("way").alias("kind"), F.col("way_id").alias("id"), F.lit(None).cast("double").alias("x"), F.try_element_at("tags", F.lit("highway")).alias("tag"), F.size("nodes").cast("long").alias("n"))
    return nodes.unionByName(ways)


def map_folder(t: Town) -> str:
    """Native map files of the town, one for each five thousand ids."""
    part = lambda c: F.floor(F.col(c) / 5000).alias("map_id")
    shapes = J.resolve_way_geometry(t.way_nodes, t.nodes)
    members = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda p: p["node_id"])
    rows = classified(t).withColumnRenamed("base_id", "way_id").join(shapes, "way_id").join(t.way_nodes.groupBy("way_id").agg(members.alias("nodes")), "way_id")
    features = rows.select(part("way_id"), F.col("way_id").cast("string").alias("feature_id"), "category", "is_area", "nodes", "tags", T.geom_to_wkt(F.lit("line"), F.array("points")).alias("wkt"), F.lit("").alias("in_out"))
    nodes = t.tagged_nodes.select(part("node_id"), "node_id", F.col("y").alias("lat"), F.col("x").alias("lon"), "tags")
    points = t.paths.select(part("path_id"), (F.col("path_id") * 1000 + F.col("seq")).alias("seq"), "x", "y")
    maps = features.groupBy("map_id").agg(F.lit(33).alias("zone_number"), F.lit("U").alias("zone_letter"))
    path = new_path(t.spark, "maps")
    S.write_mapdata(features, nodes, points, maps, path)
    return path


@query("SELECT category, CAST(c.way_id AS VARCHAR) AS feature_id, p.n, p.sx FROM fx_class AS c JOIN (SELECT way_id, count(*) AS n, round(sum(x), 3) AS sx FROM fx_placed GROUP BY way_id) AS p ON c.way_id = p.way_id")
def read_mapdata(t: Town):
    f = S.read_mapdata(t.spark, f"{map_folder(t)}/*/*")["features"].withColumn("g", T.wkt_to_geom(F.col("wkt")))
    total = F.aggregate(F.get("g.rings", F.lit(0)), F.lit(0.0), lambda s, p: s + p["x"])
    return f.select("category", "feature_id", F.size("nodes").cast("long").alias("n"), F.round(total, 3).alias("sx"))


@query("SELECT 'nodes' AS what, count(*) AS n, round(sum(x), 3) AS sx FROM fx_nodes UNION ALL SELECT 'waypoints', count(*), round(sum(x), 3) FROM fx_paths UNION ALL SELECT 'maps', count(DISTINCT way_id // 5000), NULL FROM fx_way_nodes")
def write_mapdata(t: Town):
    read = S.read_mapdata(t.spark, f"{map_folder(t)}/*/*")
    sums = {"nodes": F.sum("lon"), "waypoints": F.sum("x"), "maps": F.lit(None).cast("double")}
    counts = [read[k].agg(F.lit(k).alias("what"), F.count("*").alias("n"), F.round(total, 3).alias("sx")) for k, total in sums.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT CAST(way_id // 5000 AS BIGINT) AS map_id, count(*) > 0 AS found FROM fx_ways GROUP BY 1")
def list_maps(t: Town):
    rows = S.list_maps(t.spark, map_folder(t), "*.txt")
    return rows.select(F.regexp_extract("path", r"map_id=(\d+)", 1).cast("long").alias("map_id"), (F.col("length") > 0).alias("found"))


@query("SELECT CAST(way_id // 5000 AS BIGINT) AS map_id, row_number() OVER (ORDER BY CAST(way_id // 5000 AS VARCHAR)) AS place FROM fx_ways GROUP BY way_id // 5000")
def sorted_maps(t: Town):
    from pyspark.sql import Window as W

    rows = S.list_maps(t.spark, map_folder(t), "*.txt").select("path", F.row_number().over(W.orderBy("path")).cast("long").alias("place"))
    return rows.select(F.regexp_extract("path", r"map_id=(\d+)", 1).cast("long").alias("map_id"), "place")


@query("SELECT robot_id // 20 AS map_id, count(*) AS changes, count(DISTINCT robot_id) AS tags FROM fx_telemetry WHERE topic = 'gps' GROUP BY robot_id // 20")
def read_edits(t: Town):
    """Sidecar files written from the messages, and a corrupt one, which counts as empty."""
    path, rows = new_path(t.spark, "edits"), t.telemetry.filter("topic = 'gps'")
    change = F.to_json(F.collect_list(F.struct(F.lit("tag").alias("type"), F.unix_timestamp("ts").cast("double").alias("ts"))))
    parts = rows.groupBy(F.floor(F.col("robot_id") / 20).alias("part")).agg(F.collect_set(F.col("robot_id").cast("string")).alias("ids"), change.alias("changes"))
    tags = F.to_json(F.map_from_arrays("ids", F.transform("ids", lambda i: F.create_map(F.lit("name"), i))))
    sound = parts.select("part", F.concat(F.lit('{"version":2,"tag_overrides":'), tags, F.lit(',"change_log":'), "changes", F.lit("}")).alias("json"))
    bad = t.spark.range(1).select(F.lit(-1).cast("long").alias("part"), F.lit('{"version":').alias("json"))
    sound.unionByName(bad).write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
    read = S.read_edits(t.spark, f"{path}/*/*").filter("version is not null")
    return read.select(F.regexp_extract("map_id", r"part=(\d+)", 1).cast("long").alias("map_id"), F.size("change_log").cast("long").alias("changes"), F.size("tag_overrides").cast("long").alias("tags"))


@query("SELECT DISTINCT 'barrier' AS key, barrier AS value FROM fx_nodes WHERE barrier IS NOT NULL")
def read_tag_rules(t: Town):
    path = new_path(t.spark, "rules")
    t.nodes.filter("barrier is not null").select(F.lit("barrier").alias("key"), F.col("barrier").alias("value")).distinct().write.csv(path)
    return S.read_tag_rules(t.spark, path)


def shapes(t: Town):
    ring = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    areas = dealt(t.area_ring, "area_id").groupBy("area_id").agg(ring.alias("r"))
    return areas.select(F.lit("town").alias("map_id"), F.col("area_id").cast("string").alias("feature_id"), F.lit("barrier").alias("category"), F.lit("polygon").alias("kind"), F.array("r").alias("rings"), F.from_json(F.lit("[]"), "array<bigint>").alias("nodes"), F.create_map(F.lit("barrier"), F.lit("wall")).alias("tags"), F.lit("").alias("in_out"))


def geojson_folder(t: Town) -> str:
    """Collections of the town's areas, one for each thousand ids, so that files grow in number and not in size."""
    one = S.geojson_features(shapes(t), 33).select(F.get_json_object("json", "$.properties.id").alias("id"), "json")
    each = F.concat(F.lit('{"id":"'), "id", F.lit('",'), F.expr("substring(json, 2)"))
    text = F.concat(F.lit('{"features":['), F.array_join(F.collect_list(each), ","), F.lit("]}"))
    path = new_path(t.spark, "geojson")
    one.groupBy(F.floor(F.col("id").cast("long") / 1000).alias("part")).agg(text.alias("json")).write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
    return path


@query("SELECT CAST(area_id AS VARCHAR) AS feature_id, 'polygon' AS kind, round(sum(x), 1) AS sx, round(sum(y), 1) AS sy FROM fx_area_ring GROUP BY area_id")
def read_geojson(t: Town):
    read = S.read_geojson(t.spark, f"{geojson_folder(t)}/*/*", 33)
    ring = F.get("rings", F.lit(0))
    total = lambda c: F.round(F.aggregate(ring, F.lit(0.0), lambda s, p: s + F.round(p[c], 0)), 1)
    return read.select("feature_id", "kind", total("x").alias("sx"), total("y").alias("sy"))


@query("SELECT CAST(area_id AS VARCHAR) AS feature_id, true AS is_node, 'Polygon' AS type, count(*) AS n FROM fx_area_ring GROUP BY area_id")
def write_geojson(t: Town):
    path = new_path(t.spark, "geojson")
    S.write_geojson(shapes(t), path, 33)
    read = t.spark.read.json(path, schema="properties struct<id:string,is_node:boolean>, geometry struct<type:string,coordinates:array<array<array<double>>>>")
    return read.select(F.col("properties.id").alias("feature_id"), "properties.is_node", "geometry.type", F.size(F.get("geometry.coordinates", F.lit(0))).cast("long").alias("n"))


@query("SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(0 AS FLOAT) AS z, CAST(CAST(node_id % 10 AS DOUBLE) / 20 AS FLOAT) AS cost FROM fx_nodes")
def write_cloud(t: Town):
    path = new_path(t.spark, "cloud")
    S.write_cloud(t.nodes.select("x", "y", F.lit(0.0).alias("z"), (F.col("node_id") % 10 / 20).alias("cost")), path)
    return t.spark.read.parquet(path)


@query("SELECT path_id, seq, 33 AS zone_number FROM (SELECT robot_id AS path_id, msg_id AS seq FROM fx_telemetry WHERE topic = 'gps') AS g")
def to_waypoints(t: Town):
    return S.to_waypoints(tracks(t)).select("path_id", "seq", "zone_number")


