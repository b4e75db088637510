"""Plane geometry on arrays of points (structs of x and y), and on plain coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def edges(ring: Column) -> Column:
    """The consecutive pairs of a point array, as structs a, b."""
    return F.when(F.size(ring) > 1, F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))).otherwise(
        F.from_json(F.lit("[]"), "array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")
    )


def line_length(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + dist(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def ring_area(ring: Column) -> Column:
    """The area inside a closed ring."""
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def capsule_perimeter(length: Column, radius: Column) -> Column:
    """The outline of a straight line of this length with a buffer."""
    return 2 * length + 2 * math.pi * radius


def centroid(ring: Column) -> Column:
    """The mean of the points of an open line, or of a closed ring's points less the repeated last."""
    points = F.when(is_closed(ring), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    n = F.size(points).cast("double")
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(points, zero, lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")), lambda s: F.struct((s["x"] / n).alias("x"), (s["y"] / n).alias("y")))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def is_closed(ring: Column) -> Column:
    return (F.size(ring) > 3) & (F.get(ring, F.lit(0)) == F.try_element_at(ring, F.lit(-1)))


def project_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The share of the segment, 0 to 1, at which the nearest point lies."""
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    return F.when(square == 0, 0.0).otherwise(F.least(F.greatest(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / square, F.lit(0.0)), F.lit(1.0)))


def interpolate(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def point_segment_dist(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = project_on_segment(px, py, ax, ay, bx, by)
    return dist(px, py, interpolate(ax, bx, t), interpolate(ay, by, t))


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether the ends of each of the segments ab and cd lie differently to the other's line; segments on one line don't cross."""
    return (side(*a, *b, *c) != side(*a, *b, *d)) & (side(*c, *d, *a) != side(*c, *d, *b))


def segments_intersect(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether segments ab and cd share a point; each end is a pair of columns."""
    s1, s2, s3, s4 = side(*a, *b, *c), side(*a, *b, *d), side(*c, *d, *a), side(*c, *d, *b)

    def within(p: tuple, q: tuple, r: tuple) -> Column:
        return r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))

    crossing = (s1 != s2) & (s3 != s4)
    touching = ((s1 == 0) & within(a, b, c)) | ((s2 == 0) & within(a, b, d)) | ((s3 == 0) & within(c, d, a)) | ((s4 == 0) & within(c, d, b))
    return crossing | touching


def crosses_ray(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether the edge meets the ray from the point towards greater x."""
    return ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Parity of the edges to the right."""
    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crosses_ray(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]), F.lit(False)))) % 2 == 1


def translate(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def recover_buffer_radius(perimeter: Column, area: Column, least: float = 0.0) -> Column:
    """The radius of a buffered line from its outline's length and area."""
    square = perimeter * perimeter - 4 * math.pi * area
    return F.greatest(F.when(square >= 0, (perimeter - F.sqrt(F.greatest(square, F.lit(0.0)))) / (2 * math.pi)).otherwise(area / perimeter), F.lit(least))


def blend_cost(way_cost: Column, off_path: float, d: Column, reach: float) -> Column:
    """From the way's cost on it to the cost off paths at the reach, with the square of the distance."""
    return way_cost + (off_path - way_cost) * (d / reach) * (d / reach)


def neighbor_cost(d: Column, reach: float, mode: str) -> Column:
    """The cost of a point near a way: 'linear' or 'quadratic' in the distance, else 0."""
    return {"linear": d / reach, "quadratic": (d / reach) * (d / reach)}.get(mode, d * 0.0)
