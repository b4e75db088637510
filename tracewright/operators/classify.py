"""Predicates and classification of tagged features.

Features are rows of base_id, tags (map) and, where noted, nodes, category or points (an array of x, y). Other columns pass
through; where tables are joined, `by` names the columns that tell maps apart (map_id).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

#: Highway kinds that count as footways, half widths by category, the radius of point obstacles.
FOOTWAYS = ("living_street", "pedestrian", "footway", "bridleway", "corridor", "track", "steps", "cycleway", "path")
RADII = {"road": 7.0, "footway": 3.0, "barrier": 2.0}
OBSTACLE_RADIUS = 2.0


def is_footway(highway: Column) -> Column:
    return F.coalesce(highway.isin(*FOOTWAYS), F.lit(False))


def is_road(highway: Column) -> Column:
    return F.coalesce((highway != "") & ~highway.isin(*FOOTWAYS), F.lit(False))


def matches_rules(features: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None, anti: DataFrame | None = None, key: str = "base_id", by: tuple[str, ...] = ()) -> DataFrame:
    """The distinct keys (by, key) of features with a tag that a rule (key, value) names, exactly or by '*' unless an exception names it, and no tag in anti.

    Tags are exploded and joined to the rules by equality; rules hold for all maps. Rows with null tags match nothing.
    """
    ids = [*by, key]
    tags = features.select(*ids, F.explode("tags").alias("__k", "__v"))
    named = lambda pairs: pairs.select(F.col("key").alias("__k"), F.col("value").alias("__v"))
    exact = tags.join(named(rules.filter("value <> '*'")), ["__k", "__v"], "left_semi")
    wild = tags.join(named(rules.filter("value = '*'")).select("__k"), "__k", "left_semi")
    if exceptions is not None:
        wild = wild.join(named(exceptions), ["__k", "__v"], "left_anti")
    found = exact.select(*ids).unionByName(wild.select(*ids)).distinct()
    if anti is not None:
        found = found.join(tags.join(named(anti), ["__k", "__v"], "left_semi").select(*ids).distinct(), ids, "left_anti")
    return found


def classify_ways(features: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None, anti: DataFrame | None = None, key: str = "base_id", by: tuple[str, ...] = ()) -> DataFrame:
    """features with category and radius: road, else footway, else barrier by the rules; others go."""
    highway = F.try_element_at("tags", F.lit("highway"))
    barrier = matches_rules(features, rules, exceptions, anti, key, by).withColumn("by_rule", F.lit(True))
    category = F.when(is_road(highway), "road").when(is_footway(highway), "footway").when(F.col("by_rule"), "barrier")
    known = features.join(barrier, [*by, key], "left").withColumn("category", category).drop("by_rule").filter("category is not null")
    return known.withColumn("radius", buffer_radius(F.col("category")))


def buffer_radius(category: Column, is_area: Column | None = None) -> Column:
    """The half width by category; a barrier's area has none."""
    radius = F.when(category == "road", RADII["road"]).when(category == "footway", RADII["footway"]).when(category == "barrier", RADII["barrier"])
    return radius if is_area is None else F.when((category == "barrier") & is_area, 0.0).otherwise(radius)


def buffer_kind(closed: Column, tags: Column, category: Column) -> Column:
    """'fill' for a barrier's closed outline or one tagged area=yes, 'ring' for other closed ways, else 'line'."""
    area = F.coalesce(F.try_element_at(tags, F.lit("area")) == "yes", F.lit(False))
    return F.when(closed & ((category == "barrier") | area), "fill").when(closed, "ring").otherwise("line")


def obstacle_nodes(nodes: DataFrame, way_nodes: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None, radius: float = OBSTACLE_RADIUS, by: tuple[str, ...] = ()) -> DataFrame:
    """nodes (node_id, tags, ...) that no way uses and whose tags match the rules, with a disc's radius."""
    free = nodes.join(way_nodes.select(*by, "node_id").distinct(), [*by, "node_id"], "left_anti")
    return free.join(matches_rules(free, rules, exceptions, key="node_id", by=by), [*by, "node_id"], "left_semi").withColumn("radius", F.lit(radius))


def subtype(category: Column, tags: Column) -> Column:
    value = F.when(category.isin("road", "footway"), F.try_element_at(tags, F.lit("highway"))).when(category == "barrier", F.try_element_at(tags, F.lit("barrier")))
    return F.coalesce(value, F.lit("other"))


def search_features(features: DataFrame, text: str, with_keys: bool = False) -> DataFrame:
    """Features whose id or any tag value contains the text, without regard to case; with_keys also looks at keys (annotations)."""
    needle = F.lit(text.lower())
    hit = F.contains(F.col("base_id").cast("string"), needle) | F.contains(T.tags_text(F.col("tags")), needle)
    if with_keys:
        hit |= F.contains(F.lower(F.array_join(F.map_keys("tags"), " ")), needle)
    return features.filter(F.coalesce(hit, F.lit(False)))


def visible_features(features: DataFrame, hidden: DataFrame, deleted: DataFrame, off: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Features that are neither hidden nor deleted (base_id each) and whose subtype isn't switched off."""
    shown = features.join(hidden.select(*by, "base_id").distinct(), [*by, "base_id"], "left_anti").join(deleted.select(*by, "base_id").distinct(), [*by, "base_id"], "left_anti")
    return shown.filter(~subtype(F.col("category"), F.col("tags")).isin(*off)) if off else shown


def bbox_filter(segments: DataFrame, box: tuple[float, float, float, float], grow: float = 0.0, key: str = "way_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Keys (by, key) of ways with a segment (x1, y1, x2, y2) that meets the box (min_x, min_y, max_x, max_y) grown by `grow`.

    Plain comparisons of bounds come first, so they reach the scan; then the exact test.
    """
    x0, y0, x1, y1 = box[0] - grow, box[1] - grow, box[2] + grow, box[3] + grow
    near = (F.least("x1", "x2") <= x1) & (F.greatest("x1", "x2") >= x0) & (F.least("y1", "y2") <= y1) & (F.greatest("y1", "y2") >= y0)
    corners = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    a, b = (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))
    inside = F.col("x1").between(x0, x1) & F.col("y1").between(y0, y1)
    crossing = inside
    for i in range(4):
        crossing = crossing | G.segments_intersect(a, b, corners[i], corners[(i + 1) % 4])
    return segments.filter(near).filter(crossing).select(*by, key).distinct()


def way_kind_filter(features: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return features.filter(F.col("category").isin(*kinds))


def has_geometry(features: DataFrame) -> DataFrame:
    return features.filter(F.col("points").isNotNull() & (F.size("points") > 0))


def in_grid_bounds(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    return points.filter(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


