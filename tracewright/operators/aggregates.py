"""Counts, junctions, components, validation and ring assembly over feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..components import components
from ..functions import geometry as G
from ..tables import cut
from .chains import merge_way_chains  # noqa: F401
from .classify import subtype


def footway_crossroads(way_nodes: DataFrame, nodes: DataFrame, radius: float = 1.5, by: tuple[str, ...] = ()) -> DataFrame:
    """node_id, count, x, y, radius: nodes used more than twice by way_nodes (footways), or twice but not both times as an end.

    A node that a way repeats counts each time. Nodes without a position go.
    """
    ends = W.partitionBy(*by, "way_id")
    used = way_nodes.withColumn("is_end", (F.col("pos") == F.min("pos").over(ends)) | (F.col("pos") == F.max("pos").over(ends)))
    counts = used.groupBy(*by, "node_id").agg(F.count("*").alias("n"), F.sum(F.col("is_end").cast("int")).alias("ends"))
    junctions = counts.filter("n > 2 or (n = 2 and ends < 2)").select(*by, "node_id", F.col("n").cast("string").alias("count"))
    return junctions.join(nodes.select(*by, "node_id", "x", "y"), [*by, "node_id"]).withColumn("radius", F.lit(radius))


def intersection_poses(crossroads: DataFrame, matrix: list[list[float]], box: tuple[float, float, float, float]) -> DataFrame:
    """pose_id (from 0 in order of node_id), x, y, z = 0 of crossroads moved to a local frame, inside the box."""
    from ..functions.projection import rigid_transform

    x, y, _ = rigid_transform(F.col("x"), F.col("y"), F.lit(0.0), matrix)
    local = crossroads.select("node_id", x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    return numbered(local.filter(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])), "node_id", "pose_id")


def numbered(rows: DataFrame, key: str, name: str, span: int = 1 << 16) -> DataFrame:
    """rows with 0, 1, 2, ... in order of a whole-number key. Rows are numbered within spans of the key, from the count of the spans before."""
    parts = rows.withColumn("__span", F.floor(F.col(key) / span))
    counts = parts.groupBy("__span").agg(F.count("*").alias("__n"))
    before = counts.select("__span", (F.sum("__n").over(W.orderBy("__span")) - F.col("__n")).alias("__before"))  # one row a span
    placed = parts.join(before, "__span").withColumn(name, F.col("__before") + F.row_number().over(W.partitionBy("__span").orderBy(key)) - 1)
    return placed.drop("__span", "__before")


def map_stats(features: DataFrame, annotations: DataFrame | None = None, by: tuple[str, ...] = ("map_id",)) -> DataFrame:
    """Counts by category, centreline length and capsule outline of footways, and the area of the bounding box. features: category, points, radius.

    annotations: a row a drawn feature; with it n_annotations of each map, 0 where it has none. Maps without features aren't listed.
    """
    b, length = G.bounds(F.col("points")), G.line_length(F.col("points"))
    rows = features.select(*by, "category", length.alias("length"), G.capsule_perimeter(length, F.col("radius")).alias("outline"), b.alias("b"))
    foot = F.col("category") == "footway"
    counts = [F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ("road", "footway", "barrier")]
    area = (F.max("b.max_x") - F.min("b.min_x")) * (F.max("b.max_y") - F.min("b.min_y"))
    stats = rows.groupBy(*by).agg(*counts, F.sum(F.when(foot, F.col("length"))).alias("footway_length"), F.sum(F.when(foot, F.col("outline"))).alias("footway_outline"), area.alias("bbox_area"))
    if annotations is None:
        return stats
    drawn = annotations.groupBy(*by).agg(F.count(F.lit(1)).alias("n_annotations"))
    return stats.join(drawn, list(by), "left").na.fill(0, ["n_annotations"])


def category_counts(features: DataFrame, by: tuple[str, ...] = ("map_id",)) -> DataFrame:
    return features.groupBy(*by).pivot("category", ["road", "footway", "barrier", "crossroad"]).count().na.fill(0)


def subtype_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("category", subtype(F.col("category"), F.col("tags")).alias("subtype")).count().orderBy("category", "subtype")


def validate_map(maps: DataFrame, features: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """map_id, rule, category, feature_id, detail: what is wrong with each map.

    maps: map_id and metadata columns; features: map_id, category, base_id, has_geometry; way_nodes: map_id, category, way_id,
    node_id; nodes: map_id, node_id.
    """

    def rows(df: DataFrame, rule: str, category="category", feature="base_id", detail=None) -> DataFrame:
        c = F.col(category) if category else F.lit(None).cast("string")
        f = F.col(feature).cast("string") if feature else F.lit(None).cast("string")
        return df.select("map_id", F.lit(rule).alias("rule"), c.alias("category"), f.alias("feature_id"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))

    lacking = [F.when(F.col(c).isNull(), F.lit(c)) for c in maps.columns if c != "map_id"]
    metadata = rows(maps.withColumn("lacks", F.array_join(F.array_compact(F.array(*lacking)), ",")).filter("lacks <> ''"), "missing_metadata", None, None, F.col("lacks"))
    empty = rows(maps.join(features.select("map_id").distinct(), "map_id", "left_anti"), "no_content", None, None)
    shapeless = rows(features.filter("not has_geometry"), "missing_geometry")
    twice = features.groupBy("map_id", "base_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("cs"), F.count_distinct("category").alias("n")).filter("n > 1")
    known = way_nodes.join(nodes.select("map_id").distinct(), "map_id", "left_semi")
    lost = known.join(nodes.select("map_id", "node_id"), ["map_id", "node_id"], "left_anti").groupBy("map_id", "category", "way_id").count()
    parts = connected_components(way_nodes.filter("category = 'footway'").select("way_id", "node_id", "map_id"), ("map_id",))
    several = parts.groupBy("map_id").agg(F.count_distinct("component").alias("n")).filter("n > 1")
    found = [metadata, empty, shapeless, rows(twice, "ambiguous_id", None, "base_id", F.col("cs")), rows(lost, "missing_nodes", "category", "way_id", F.col("count")), rows(several.withColumn("category", F.lit("footway")), "disconnected", "category", None, F.col("n"))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def connected_components(way_nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """way_id, component (the smallest way_id that shared nodes lead to). Components don't cross `by`.

    Ways hang on their nodes: each node's smallest way is linked to the others, so a node that many ways share makes as many
    links, not pairs; then see components(). Ways are numbered in a table, so that ids and maps go as one number.
    """
    used = way_nodes.select(*by, "way_id", "node_id").distinct()
    ways = cut(used.select(*by, "way_id").distinct().withColumn("number", F.monotonically_increasing_id()), "ways")
    known = cut(used.join(ways, [*by, "way_id"]).select(*by, "node_id", "number"), "used")
    hub = known.groupBy(*by, "node_id").agg(F.min("number").alias("hub"))
    joined = components(known.join(hub, [*by, "node_id"]), "number", "hub").withColumnsRenamed({"node": "number", "component": "root"})
    labelled = ways.join(joined, "number", "left").withColumn("root", F.coalesce("root", "number"))
    least = labelled.groupBy("root").agg(F.min("way_id").alias("component"))
    return labelled.join(least, "root").select(*by, "way_id", "component")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("ways"))


def node_degree(edges: DataFrame) -> DataFrame:
    """node_id, degree of edges that stand in both directions."""
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))


def dedupe_nodes(nodes: DataFrame, order: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """One row a node_id: the first in ingest order."""
    return nodes.withColumn("rn", F.row_number().over(W.partitionBy(*by, "node_id").orderBy(order))).filter("rn = 1").drop("rn")


def map_bounds(waypoints: DataFrame, margin: float = 150.0, by: tuple[str, ...] = ("map_id",)) -> DataFrame:
    """The bounding box of each map's waypoints (x, y), grown by the margin."""
    return waypoints.groupBy(*by).agg((F.min("x") - margin).alias("min_x"), (F.min("y") - margin).alias("min_y"), (F.max("x") + margin).alias("max_x"), (F.max("y") + margin).alias("max_y"))


def planning_window(paths: DataFrame, limits: tuple[float, float, float, float], margin: float = 50.0, by: tuple[str, ...] = ("path_id",)) -> DataFrame:
    """Each path's box grown by the margin and clipped to the map's limits."""
    b = map_bounds(paths, margin, by)
    lows = {"min_x": limits[0], "min_y": limits[1]}
    highs = {"max_x": limits[2], "max_y": limits[3]}
    return b.select(*by, *(F.greatest(F.col(k), F.lit(v)).alias(k) for k, v in lows.items()), *(F.least(F.col(k), F.lit(v)).alias(k) for k, v in highs.items()))


def bbox_agg(paths: DataFrame, limits: tuple[float, float, float, float], by: tuple[str, ...] = ("path_id",)) -> DataFrame:
    return planning_window(paths, limits, 50.0, by)


def recenter(points: DataFrame, by: tuple[str, ...] = ("map_id",)) -> DataFrame:
    """points with x, y counted from the middle of their group's box."""
    middle = points.groupBy(*by).agg(((F.min("x") + F.max("x")) / 2).alias("mx"), ((F.min("y") + F.max("y")) / 2).alias("my"))
    return points.join(middle, list(by)).withColumns({"x": F.col("x") - F.col("mx"), "y": F.col("y") - F.col("my")}).drop("mx", "my")


def bbox_corners(boxes: DataFrame) -> DataFrame:
    """boxes (map_id, min_lat, max_lat, min_lon, max_lon) as four waypoints (corner 0 to 3: south-west, south-east, north-east, north-west) with x, y in the zone of the first corner."""
    from ..functions.projection import to_utm, utm_zone

    corner = lambda i, lat, lon: F.struct(F.lit(i).alias("corner"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    four = F.array(corner(0, "min_lat", "min_lon"), corner(1, "min_lat", "max_lon"), corner(2, "max_lat", "max_lon"), corner(3, "max_lat", "min_lon"))
    rows = boxes.select("map_id", utm_zone(F.col("min_lat"), F.col("min_lon")).alias("zone"), F.explode(four).alias("c")).select("map_id", "zone", "c.*")
    x, y = to_utm(F.col("lat"), F.col("lon"), F.col("zone"))
    return rows.withColumns({"x": x, "y": y})


def utm_zone_audit(boxes: DataFrame) -> DataFrame:
    """map_id, zones (sorted), crosses: whether a box's corners lie in more than one zone."""
    from ..functions.projection import utm_zone

    corners = bbox_corners(boxes).withColumn("own", utm_zone(F.col("lat"), F.col("lon")))
    return corners.groupBy("map_id").agg(F.array_sort(F.collect_set("own")).alias("zones")).withColumn("crosses", F.size("zones") > 1)


def local_grid_bounds(boxes: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """min_x, min_y, max_x, max_y of two opposite corners moved by the matrix."""
    from ..functions.projection import rigid_transform

    a = rigid_transform(F.col("min_x"), F.col("min_y"), F.lit(0.0), matrix)
    b = rigid_transform(F.col("max_x"), F.col("max_y"), F.lit(0.0), matrix)
    keys = [c for c in boxes.columns if c not in ("min_x", "min_y", "max_x", "max_y")]
    return boxes.select(*keys, F.least(a[0], b[0]).alias("min_x"), F.least(a[1], b[1]).alias("min_y"), F.greatest(a[0], b[0]).alias("max_x"), F.greatest(a[1], b[1]).alias("max_y"))
