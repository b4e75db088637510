"""Ids, tags and geometry as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def split_virtual_id(virtual: Column) -> tuple[Column, Column]:
    """'12:3' gives 12 and 3; without a segment the second is null; what is no number gives null."""
    return F.try_to_number(F.split_part(virtual, F.lit(":"), F.lit(1)), F.lit("S999999999999999999")).cast("long"), F.when(F.contains(virtual, F.lit(":")), F.split_part(virtual, F.lit(":"), F.lit(2)).try_cast("int"))


def render_id(base: Column, segment: Column) -> Column:
    return F.when(segment.isNull(), base.cast("string")).otherwise(F.concat_ws(":", base.cast("string"), segment.cast("string")))


def sanitize_name(name: Column) -> Column:
    """Letters, digits, '-', '_' and '.' stay; anything else becomes '_'."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_")


def tags_merge(under: Column, over: Column) -> Column:
    """Both maps' entries; over wins. Nulls count as empty."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    low, high = F.coalesce(under, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def tags_text(tags: Column) -> Column:
    """All values, for searching."""
    return F.lower(F.array_join(F.map_values(tags), " "))


def tag_or_default(tags: Column, key: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(default))


def number(value: Column) -> Column:
    """The shortest text of a double; whole numbers without a fraction."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), F.floor(value).cast("string")).otherwise(value.cast("string"))


def points_text(points: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))), ", "), F.lit(")"))


def geom_to_wkt(kind: Column, rings: Column) -> Column:
    """WKT of kind 'line', 'polygon' (outer ring, then holes) or 'point'."""
    return (
        F.when(kind == "polygon", F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, points_text), ", "), F.lit(")")))
        .when(kind == "line", F.concat(F.lit("LINESTRING "), points_text(F.get(rings, F.lit(0)))))
        .when(kind == "point", F.concat(F.lit("POINT "), points_text(F.get(rings, F.lit(0)))))
    )


def wkt_to_geom(wkt: Column) -> Column:
    """struct kind, rings of WKT text; a multi-part polygon's rings follow each other under kind 'multipolygon'; other kinds give null."""
    head = F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    kind = F.when(head == "LINESTRING", "line").when(head == "POLYGON", "polygon").when(head == "MULTIPOLYGON", "multipolygon").when(head == "POINT", "point")
    rings = F.transform(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1), lambda r: F.transform(F.split(r, r"\s*,\s*"), _point))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), rings.alias("rings")))


def _point(text: Column) -> Column:
    parts = F.split(F.trim(text), r"\s+")
    return F.struct(F.get(parts, F.lit(0)).cast("double").alias("x"), F.get(parts, F.lit(1)).cast("double").alias("y"))


def geojson_geom(kind: Column, rings: Column) -> Column:
    """GeoJSON text of kind 'line', 'polygon' or 'point' with x as longitude and y as latitude."""
    at = lambda p: F.array(p["x"], p["y"])
    whole = F.transform(rings, lambda r: F.transform(r, at))
    first = F.get(whole, F.lit(0))
    return (
        F.when(kind == "polygon", F.to_json(F.struct(F.lit("Polygon").alias("type"), whole.alias("coordinates"))))
        .when(kind == "line", F.to_json(F.struct(F.lit("LineString").alias("type"), first.alias("coordinates"))))
        .when(kind == "point", F.to_json(F.struct(F.lit("Point").alias("type"), F.get(first, F.lit(0)).alias("coordinates"))))
    )


def props_to_tags(properties: Column) -> Column:
    """A JSON object's entries as text; nulls go."""
    return F.map_filter(F.from_json(properties, "map<string,string>"), lambda _, v: v.isNotNull())


def seconds_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)
