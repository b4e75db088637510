"""Edit logs over feature tables: deletions, splits, moves, tags, drawn features; the last writer of a target wins.

`by` names the columns that tell maps apart (map_id): ids then count within a map only.

way_nodes: way_id, pos, node_id, x, y where a position is known. segments of split ways are rows of base_id, seg, pos, node_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from . import classify
from .aggregates import footway_crossroads
from .sequences import effective_nodes, interleave_changes, split_ways


def normalize_deletions(store: DataFrame) -> DataFrame:
    """store (map_id, deleted_ways, deleted_nodes as JSON text): map_id, way_id (text), node_id of both encodings.

    Ways stand as ids or as objects with an id; nodes as a map from way to ids or as a list of objects. A row with a null node_id
    deletes the way. Text that is no JSON gives no rows.
    """
    ways = store.select("map_id", F.explode(F.from_json("deleted_ways", "array<string>")).alias("w"))
    ways = ways.select("map_id", F.coalesce(F.get_json_object("w", "$.id"), F.col("w")).alias("way_id"), F.lit(None).cast("long").alias("node_id"))
    listed = store.filter(F.startswith(F.trim("deleted_nodes"), F.lit("["))).select("map_id", F.explode(F.from_json("deleted_nodes", "array<struct<way_id:string,node_id:bigint>>")).alias("n")).select("map_id", "n.way_id", "n.node_id")
    mapped = store.filter(F.startswith(F.trim("deleted_nodes"), F.lit("{"))).select("map_id", F.explode(F.from_json("deleted_nodes", "map<string,array<bigint>>")).alias("way_id", "ns")).select("map_id", "way_id", F.explode("ns").alias("node_id"))
    return ways.unionByName(listed).unionByName(mapped).distinct()


def apply_way_deletes(features: DataFrame, deletes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """features (base_id, seg) less whole ways (deletes with a null seg) and single segments."""
    whole = deletes.filter("seg is null").select(*by, "base_id").distinct()
    parts = deletes.filter("seg is not null").select(*by, "base_id", "seg").distinct()
    return features.join(whole, [*by, "base_id"], "left_anti").join(parts, [*by, "base_id", "seg"], "left_anti")


def apply_node_deletes(way_nodes: DataFrame, deletes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """way_nodes (way_id, pos, node_id, category, ...) less deleted nodes (way_id, node_id), numbered anew.

    Ways left with under two nodes go; a closed way whose joint was deleted is closed again at its new first node; a closed
    barrier needs three different nodes.
    """
    way = W.partitionBy(*by, "way_id")
    whole = way.orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    closed = (F.first("node_id").over(whole) == F.last("node_id").over(whole)) & (F.count("*").over(way) > 2)
    rows = way_nodes.withColumn("closed", closed).join(deletes.select(*by, "way_id", "node_id").distinct(), [*by, "way_id", "node_id"], "left_anti")
    rows = rows.withColumns({"first": F.first("node_id").over(whole), "final": F.last("node_id").over(whole), "begin": F.min("pos").over(way), "end": F.max("pos").over(way)})
    again = rows.filter("closed and first <> final and pos = begin").withColumn("pos", F.col("end") + 1)
    both = rows.unionByName(again).withColumns({"n": F.count("*").over(way), "different": F.size(F.collect_set("node_id").over(way))})
    kept = both.filter((F.col("n") >= 2) & (F.col("different") >= F.when(F.col("closed") & (F.col("category") == "barrier"), 3).otherwise(2)))
    return kept.withColumn("pos", F.row_number().over(way.orderBy("pos")) - 1).select(*way_nodes.columns)


def apply_splits(way_nodes: DataFrame, splits: DataFrame, deletes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """base_id, seg, pos, node_id of split ways, less the deleted segments (base_id, seg)."""
    return apply_way_deletes(split_ways(way_nodes, splits, by), deletes, by)


def apply_moves(way_nodes: DataFrame, moves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """way_nodes (way_id, pos, node_id, x, y) with the last position a move (way_id, node_id, ts, x, y) gives a node of that way."""
    last = moves.groupBy(*by, "way_id", "node_id").agg(F.max(F.struct("ts", "x", "y")).alias("m")).select(*by, "way_id", "node_id", F.col("m.x").alias("mx"), F.col("m.y").alias("my"))
    met = way_nodes.join(last, [*by, "way_id", "node_id"], "left")
    return met.withColumns({"x": F.coalesce("mx", "x"), "y": F.coalesce("my", "y")}).select(*way_nodes.columns)


def move_shapes(features: DataFrame, moves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """features without nodes (base_id, points) shifted so that the mean point comes to their last move (base_id, ts, x, y)."""
    last = moves.groupBy(*by, "base_id").agg(F.max(F.struct("ts", "x", "y")).alias("m"))
    c = G.centroid(F.col("points"))
    moved = F.when(F.col("m").isNull(), F.col("points")).otherwise(G.translate(F.col("points"), F.col("m.x") - c["x"], F.col("m.y") - c["y"]))
    return features.join(last, [*by, "base_id"], "left").withColumn("points", moved).select(*features.columns)


def apply_added_nodes(way_nodes: DataFrame, added: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """way_nodes with added nodes (way_id, after_node_id, node_id, ts) after their anchor, in order of ts; a missing anchor skips them."""
    anchors = way_nodes.groupBy(*by, "way_id", F.col("node_id").alias("after_node_id")).agg(F.min("pos").alias("anchor"))
    new = added.join(anchors, [*by, "way_id", "after_node_id"]).select(*by, "way_id", "node_id", F.col("anchor").alias("pos"), F.row_number().over(W.partitionBy(*by, "way_id", "anchor").orderBy("ts", "node_id")).alias("sub"))
    both = way_nodes.select(*by, "way_id", "node_id", "pos", F.lit(0).alias("sub")).unionByName(new)
    return both.select(*by, "way_id", (F.row_number().over(W.partitionBy(*by, "way_id").orderBy("pos", "sub")) - 1).alias("pos"), "node_id")


def apply_tag_overrides(features: DataFrame, overrides: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """features (base_id, category, tags) with override maps (base_id, tags) over their tags; roads and footways are told apart anew.

    A road or footway whose highway is emptied keeps its category.
    """
    met = features.join(overrides.select(*by, "base_id", F.col("tags").alias("new")), [*by, "base_id"], "left").withColumn("tags", T.tags_merge(F.col("tags"), F.col("new")))
    highway = F.try_element_at("tags", F.lit("highway"))
    category = F.when(F.col("new").isNull() | (F.col("category") == "barrier"), F.col("category")).when(classify.is_footway(highway), "footway").when(classify.is_road(highway), "road").otherwise(F.col("category"))
    return met.withColumn("category", category).select(*features.columns)


def annotations_to_features(annotations: DataFrame) -> DataFrame:
    """annotations (map_id, ann_id, type, points, props, and geom if known) as features: base_id -1, -2, ... by ann_id, category, radius, nodes, tags, points.

    A 'path' is a road or footway by its highway ('path' unless given); a drawn line (geom LineString, or no geom) has a node a
    vertex and half its width (1.5 unless given) as radius, a drawn area neither. Others are barriers ('wall' unless given).
    Nodes get negative ids of their own, by map.
    """
    tags = F.coalesce("props", F.from_json(F.lit("{}"), "map<string,string>"))
    rows = annotations.withColumn("base_id", -F.row_number().over(W.partitionBy("map_id").orderBy("ann_id")).cast("long")).withColumn("tags", tags)
    path, highway = F.col("type") == "path", F.try_element_at("tags", F.lit("highway"))
    line = path & (F.coalesce("geom", F.lit("LineString")) == "LineString") if "geom" in annotations.columns else path
    category = F.when(path & classify.is_road(highway), "road").when(path, "footway").otherwise("barrier")
    default = F.map_from_arrays(F.array(F.when(path, "highway").otherwise("barrier")), F.array(F.when(path, "path").otherwise("wall")))
    width = F.coalesce(F.try_element_at("tags", F.lit("width")).try_cast("double"), F.lit(1.5))
    rows = rows.withColumns({"line": line, "category": category, "radius": F.when(line, width / 2).otherwise(0.0), "tags": T.tags_merge(default, F.col("tags"))})
    vertices = F.when(F.col("line"), F.size("points")).otherwise(0)
    first = F.coalesce(F.sum(vertices).over(W.partitionBy("map_id").orderBy(F.col("base_id").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nodes = F.when(vertices > 0, F.transform(F.sequence(F.lit(1), F.greatest(vertices, F.lit(1))), lambda i: -(F.col("first") + i).cast("long"))).otherwise(F.from_json(F.lit("[]"), "array<bigint>"))
    return rows.withColumn("first", first).select("map_id", "base_id", "category", "radius", nodes.alias("nodes"), "tags", "points")


def current_edits(log: DataFrame) -> DataFrame:
    """map_id, op, target, payload of the edits in force: log (map_id, event_id, ts, op, target, is_undo, payload), the last by ts and event_id of each op and target, unless it is an undo."""
    last = W.partitionBy("map_id", "op", "target").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return log.withColumn("rn", F.row_number().over(last)).filter("rn = 1 and not is_undo").select("map_id", "op", "target", "event_id", "ts", "payload")


def edited_map(features: DataFrame, way_nodes: DataFrame, nodes: DataFrame, edits: dict[str, DataFrame], with_added_nodes: bool = False, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The map under its edits: 'features' (base_id, seg, category, tags, and points if features has them), 'way_nodes' (base_id, seg, pos, node_id, x, y), 'crossroads'.

    edits: way_deletes (base_id, seg), node_deletes (way_id, node_id), splits (way_id, node_id), moves (way_id, node_id, ts, x, y),
    tags (base_id, tags); and optionally added (see apply_added_nodes, with x, y), shape_moves (see move_shapes) and annotations (see
    annotations_to_features). Order: way deletes, added nodes if asked for, node deletes, splits, segment deletes, moves, tags,
    crossroads, annotations. With by = ("map_id",) many maps are edited at once, and ids count within a map. An id that an
    annotation and a way share can't come from one map: drawn features have negative ids.
    """
    deletes = edits["way_deletes"]
    left = features.join(deletes.filter("seg is null").select(*by, "base_id").distinct(), [*by, "base_id"], "left_anti")
    known = nodes.select(*by, "node_id", "x", "y")
    category = left.select(*by, F.col("base_id").alias("way_id"), "category")
    rows = way_nodes.select(*by, "way_id", "pos", "node_id")
    if with_added_nodes:
        rows = apply_added_nodes(rows, edits["added"], by)
        if {"x", "y"} <= set(edits["added"].columns):
            known = effective_nodes(known, edits["added"], by)
    rows = apply_node_deletes(rows.join(category, [*by, "way_id"]), edits["node_deletes"], by)
    parts = apply_splits(rows, edits["splits"], deletes, by)
    placed = parts.join(known, [*by, "node_id"], "left").withColumnRenamed("base_id", "way_id")
    placed = apply_moves(placed, edits["moves"], by).select(*by, F.col("way_id").alias("base_id"), "seg", "pos", "node_id", "x", "y")
    tagged = apply_tag_overrides(left, edits["tags"], by)
    if "shape_moves" in edits:
        tagged = move_shapes(tagged, edits["shape_moves"], by)
    shown = tagged.join(placed.select(*by, "base_id", "seg").distinct(), [*by, "base_id"])
    foot = placed.join(tagged.filter("category = 'footway'").select(*by, "base_id"), [*by, "base_id"], "left_semi")
    foot = foot.select(*by, T.render_id(F.col("base_id"), F.col("seg")).alias("way_id"), "pos", "node_id")
    crossroads = footway_crossroads(foot, known, by=by)
    if "annotations" in edits:
        drawn = annotations_to_features(edits["annotations"])
        both = set(shown.columns)
        shown = shown.unionByName(drawn.withColumn("seg", F.lit(None).cast("int")).select(*(c for c in ("map_id", "base_id", "seg", "category", "radius", "tags", "points") if c in both)), allowMissingColumns=True)
        vertex = F.posexplode(F.transform("nodes", lambda n, i: F.struct(n.alias("node_id"), F.get("points", i).alias("p")))).alias("pos", "v")
        places = drawn.select(*by, "base_id", F.lit(None).cast("int").alias("seg"), vertex).select(*by, "base_id", "seg", "pos", "v.node_id", "v.p.x", "v.p.y")
        placed = placed.unionByName(places)
    return {"features": shown, "way_nodes": placed, "crossroads": crossroads}


def resolve_feature(edited: dict[str, DataFrame], ids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The edited features of a set of base_id values."""
    return edited["features"].join(ids.select(*by, "base_id").distinct(), [*by, "base_id"], "left_semi")


def feature_segments(edited: dict[str, DataFrame], ids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """feature_id (with its segment) and node list of the chosen features."""
    rows = edited["way_nodes"].join(ids.select(*by, "base_id").distinct(), [*by, "base_id"], "left_semi")
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda p: p["node_id"])
    return rows.groupBy(*by, "base_id", "seg").agg(nodes.alias("nodes")).select(*by, T.render_id(F.col("base_id"), F.col("seg")).alias("feature_id"), "nodes")


def feature_nodes(edited: dict[str, DataFrame], ids: DataFrame, tags: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """feature_id, pos, node_id, x, y, tags of the chosen features' nodes."""
    rows = edited["way_nodes"].join(ids.select(*by, "base_id").distinct(), [*by, "base_id"], "left_semi").join(tags.select(*by, "node_id", "tags"), [*by, "node_id"], "left")
    return rows.select(*by, T.render_id(F.col("base_id"), F.col("seg")).alias("feature_id"), "pos", "node_id", "x", "y", "tags")


def synthetic_node_ids(added: DataFrame) -> DataFrame:
    """added nodes with node_id -1, -2, ... in order of ts per map."""
    return added.withColumn("node_id", -F.row_number().over(W.partitionBy("map_id").orderBy("ts", "event_id")).cast("long"))


def change_log_backfill(edits: DataFrame, log: DataFrame) -> DataFrame:
    """map_id, section, place, kind, target, ts: entries for edits (map_id, kind, target) that the log (with ts) lacks, then the log's own.

    New entries come first: ways and nodes interleaved by middle rank, then tags, moves and splits; log entries without a time are
    of an older form and go. Running it on its own result changes nothing.
    """
    kept = log.filter("ts is not null")
    new = edits.join(kept.select("map_id", "kind", "target"), ["map_id", "kind", "target"], "left_anti")
    pair = interleave_changes(new.filter("kind = 'way'"), new.filter("kind = 'node'").select(*new.columns), "target", ("map_id",))
    head = pair.select("map_id", F.lit(0).alias("section"), "place", F.when(F.col("kind") == 0, "way").otherwise("node").alias("kind"), "target", F.lit(None).cast("timestamp").alias("ts"))
    order = F.when(F.col("kind") == "tag", 1).when(F.col("kind") == "move", 2).when(F.col("kind") == "split", 3).otherwise(4)
    rest = new.filter("kind not in ('way', 'node')").withColumn("section", order)
    rest = rest.select("map_id", "section", F.row_number().over(W.partitionBy("map_id", "section").orderBy("target")).alias("place"), "kind", "target", F.lit(None).cast("timestamp").alias("ts"))
    old = kept.select("map_id", F.lit(9).alias("section"), F.row_number().over(W.partitionBy("map_id").orderBy("ts", "kind", "target")).alias("place"), "kind", "target", "ts")
    return head.unionByName(rest).unionByName(old)


def change_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("op").agg(F.count("*").alias("n"))
