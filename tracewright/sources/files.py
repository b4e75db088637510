"""Map files as tables, and tables as map files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import projection as P
from ..functions import text as T

POINT = "struct<_lat:double,_lon:double,ele:double,name:string>"
GPX = f"wpt array<{POINT}>, trk array<struct<trkseg:array<struct<trkpt:array<{POINT}>>>>>, rte array<struct<rtept:array<{POINT}>>>"
TAGS = "map<string,string>"
OSM = f"elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,members:array<struct<type:string,ref:bigint,role:string>>,tags:{TAGS}>>"
FEATURE = f"struct<id:string,is_area:boolean,nodes:array<bigint>,tags:{TAGS},line:string,in_out:string>"
META = "zone_number int, zone_letter string, min_x double, max_x double, min_y double, max_y double, min_lat double, max_lat double, min_long double, max_long double, coords_file string"
MAPDATA = f"metadata struct<{META.replace(' ', ':').replace(',:', ',')}>, waypoints array<array<double>>, roads array<{FEATURE}>, footways array<{FEATURE}>, barriers array<{FEATURE}>, crossroads array<{FEATURE}>, nodes_cache map<string,struct<lat:double,lon:double,tags:{TAGS}>>"
KINDS = {"roads": "road", "footways": "footway", "barriers": "barrier", "crossroads": "crossroad"}
EDITS = "version int, deleted_ways string, hidden_ways string, tag_overrides map<string,map<string,string>>, split_ways map<string,array<bigint>>, deleted_nodes string, node_position_overrides map<string,map<string,struct<lat:double,lon:double>>>, annotations string, added_nodes array<struct<id:bigint,way_id:string,after_node_id:bigint,lat:double,lon:double>>, change_log array<struct<type:string,ts:double>>, _corrupt_record string"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """path_id (the file), seq, lat, lon, ele, name: waypoints of each file, else its track points, else its route points. A file without any gives no rows."""
    flat = lambda a: F.flatten(a)
    tracks = flat(F.transform("trk", lambda t: flat(F.transform(t["trkseg"], lambda s: s["trkpt"]))))
    routes = flat(F.transform("rte", lambda r: r["rtept"]))
    some = lambda a: F.when(F.size(a) > 0, a)
    rows = spark.read.format("xml").option("rowTag", "gpx").schema(GPX).load(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path_id"), F.coalesce(some(F.col("wpt")), some(tracks), some(routes)).alias("p"))
    return rows.select("path_id", F.posexplode("p").alias("seq", "p")).select("path_id", "seq", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("ele"), F.col("p.name").alias("name"))


def read_osm_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """'nodes' (map_id, node_id, lat, lon, tags), 'ways' (map_id, way_id, nodes, tags), 'relation_members' (map_id, rel_id, ord, type, ref, role, tags)."""
    e = spark.read.schema(OSM).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("map_id"), F.explode("elements").alias("e")).select("map_id", "e.*")
    return {
        "nodes": e.filter("type = 'node'").select("map_id", F.col("id").alias("node_id"), "lat", "lon", "tags"),
        "ways": e.filter("type = 'way'").select("map_id", F.col("id").alias("way_id"), "nodes", "tags"),
        "relation_members": e.filter("type = 'relation'").select("map_id", F.col("id").alias("rel_id"), "tags", F.posexplode("members").alias("ord", "m")).select("map_id", "rel_id", "ord", "m.type", "m.ref", "m.role", "tags"),
    }


def read_mapdata(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """'features', 'nodes', 'waypoints', 'maps' of native map files; crossroads may be missing. A legacy binary file (first byte 0x80) is an error."""
    first = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 1).alias("b")).filter(F.hex("b") == "80")
    if legacy := first.select("path").take(1):
        raise ValueError(f"{legacy[0].path} is a legacy binary map")
    m = spark.read.schema(MAPDATA).json(path, multiLine=True).withColumn("map_id", F.col("_metadata.file_path"))
    parts = [m.select("map_id", F.lit(kind).alias("category"), F.explode(name).alias("f")).select("map_id", "category", F.col("f.id").alias("feature_id"), "f.is_area", "f.nodes", "f.tags", F.col("f.line").alias("wkt"), "f.in_out") for name, kind in KINDS.items()]
    features = parts[0]
    for p in parts[1:]:
        features = features.unionByName(p)
    return {
        "features": features,
        "nodes": m.select("map_id", F.explode("nodes_cache").alias("k", "n")).select("map_id", F.col("k").cast("long").alias("node_id"), "n.*"),
        "waypoints": m.select("map_id", F.posexplode("waypoints").alias("seq", "p")).select("map_id", "seq", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")),
        "maps": m.select("map_id", "metadata.*"),
    }


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """One row a sidecar file, in columns by kind of edit; a corrupt file is an empty store, and so is a missing one."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(EDITS).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
        rows = rows.withColumn("map_id", F.col("_metadata.file_path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], EDITS + ", map_id string")
    sound = F.col("_corrupt_record").isNull()
    return rows.select("map_id", *(F.when(sound, F.col(c)).alias(c) for c in rows.columns if c not in ("map_id", "_corrupt_record")))


def read_tag_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="key string, value string").filter("key is not null")


def read_geojson(spark: SparkSession, path: str, zone: int) -> DataFrame:
    """feature_id, properties, kind, rings (x, y in the zone) of the features in collections; kinds other than lines and polygons give null geometry."""
    schema = "features array<struct<id:string,properties:string,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select(F.col("f.id").alias("feature_id"), "f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    line, polygon, multi = F.from_json("c", "array<array<double>>"), F.from_json("c", "array<array<array<double>>>"), F.from_json("c", "array<array<array<array<double>>>>")
    rings = F.when(F.col("type") == "LineString", F.array(line)).when(F.col("type") == "Polygon", polygon).when(F.col("type") == "MultiPolygon", F.flatten(multi))

    planar = lambda r: P.utm_points(r, F.lit(zone), lambda p: F.get(p, F.lit(1)), lambda p: F.get(p, F.lit(0)))
    kind = F.when(F.col("type") == "LineString", "line").when(F.col("type") == "Polygon", "polygon").when(F.col("type") == "MultiPolygon", "multipolygon")
    return f.select("feature_id", "properties", kind.alias("kind"), F.transform(rings, planar).alias("rings"))


def geojson_features(features: DataFrame, zone: int) -> DataFrame:
    """map_id, json: a GeoJSON feature of every row of features (map_id, feature_id, category, kind, rings, nodes, tags, in_out); those without a geometry go."""

    def degrees(ring):
        return F.transform(P.latlon_points(ring, F.lit(zone)), lambda p: F.struct(F.round(p["lon"], 7).alias("x"), F.round(p["lat"], 7).alias("y")))

    g = T.geojson_geom(F.col("kind"), F.transform("rings", degrees))
    node = (F.col("category") == "barrier") & (F.size("nodes") == 0)
    properties = F.struct(F.col("feature_id").alias("id"), "category", node.alias("is_node"), "tags", "in_out")
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), F.col("g"), F.lit("}"))
    # the kinds that have one; asking for the text itself would make it twice
    return features.filter(F.col("kind").isin("polygon", "line", "point")).withColumn("g", g).select("map_id", text.alias("json"))


def write_geojson(features: DataFrame, path: str, zone: int) -> None:
    """Newline-delimited features, a folder a map."""
    geojson_features(features, zone).write.partitionBy("map_id").text(path)


def write_mapdata(features: DataFrame, nodes: DataFrame, waypoints: DataFrame, maps: DataFrame, path: str) -> None:
    """Native map files, one JSON object a line, a folder a map. Each map is one record of the format, so one row gathers it."""
    f = F.struct(F.col("feature_id").alias("id"), "is_area", "nodes", "tags", F.col("wkt").alias("line"), "in_out")
    sets = [F.array_sort(F.collect_list(F.when(F.col("category") == kind, F.struct("feature_id", F.to_json(f).alias("j"))))).alias(name) for name, kind in KINDS.items()]
    out = features.groupBy("map_id").agg(*sets).join(nodes.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "lat", "lon", F.to_json("tags").alias("tags")))).alias("n")), "map_id", "left")
    out = out.join(waypoints.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("w")), "map_id", "left").join(maps.select("map_id", F.to_json(F.struct(*[c for c in maps.columns if c != "map_id"])).alias("meta")), "map_id", "left")
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x["j"]), ","), F.lit("]"))
    cache = F.concat(F.lit("{"), F.array_join(F.transform("n", lambda x: F.concat(F.lit('"'), x["node_id"].cast("string"), F.lit('":{"lat":'), x["lat"].cast("string"), F.lit(',"lon":'), x["lon"].cast("string"), F.lit(',"tags":'), F.coalesce(x["tags"], F.lit("{}")), F.lit("}"))), ","), F.lit("}"))
    points = F.to_json(F.transform("w", lambda p: F.array(p["x"], p["y"])))
    body = [F.lit('{"metadata":'), F.coalesce("meta", F.lit("null"))]
    for name in KINDS:
        body += [F.lit(f',"{name}":'), listed(F.col(name))]
    text = F.concat(*body, F.lit(',"waypoints":'), F.coalesce(points, F.lit("[]")), F.lit(',"nodes_cache":'), F.coalesce(cache, F.lit("{}")), F.lit("}"))
    out.select("map_id", text.alias("json")).write.partitionBy("map_id").text(path)


def gpx_texts(paths: DataFrame, as_track: bool = False) -> DataFrame:
    """path_id, gpx: a file's text of each path (path_id, seq, lat, lon), as waypoints or as one track; rows without a position go."""
    tag = "trkpt" if as_track else "wpt"
    rows = paths.filter("lat is not null and lon is not null").select("path_id", "seq", F.concat(F.lit(f'<{tag} lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"></' + tag + ">")).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda p: p["t"]), "")
    head, tail = ("<trk><trkseg>", "</trkseg></trk>") if as_track else ("", "")
    return rows.groupBy("path_id").agg(F.concat(F.lit(f'<gpx version="1.1" creator="tracewright">{head}'), body, F.lit(f"{tail}</gpx>")).alias("gpx"))


def write_gpx(paths: DataFrame, path: str, as_track: bool = False) -> None:
    """One file a path, in a folder of its own."""
    texts = gpx_texts(paths, as_track)
    texts.repartition("path_id").write.partitionBy("path_id").option("maxRecordsPerFile", 1).text(path)


def write_cloud(cloud: DataFrame, path: str) -> None:
    """Four float columns as Parquet."""
    if [c for c in cloud.columns if c not in ("x", "y", "z", "cost")] or len(cloud.columns) != 4:
        raise ValueError("a cloud has the columns x, y, z and cost")
    cloud.select(*(F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "cost"))).write.parquet(path)


def list_maps(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """path, length of the map files below a folder, in order of path; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length").orderBy("path")


def to_waypoints(points: DataFrame) -> DataFrame:
    """points (path_id, seq, lat, lon) with x, y in the zone of each path's first point, and the zone."""
    first = F.first(P.utm_zone(F.col("lat"), F.col("lon"))).over(W.partitionBy("path_id").orderBy("seq"))
    rows = points.withColumn("zone_number", first)
    x, y = P.to_utm(F.col("lat"), F.col("lon"), F.col("zone_number"))
    return rows.withColumns({"x": x, "y": y, "zone_letter": P.utm_letter(F.col("lat"))})
