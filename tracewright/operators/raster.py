"""Cells, cost grids and point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..tables import cut, dealt, shuffled
from .joins import cell_of, crossing_x, finite, nearest_steps, nearest_within, points_near_segments, positions_inside, ring_edges, row_spans, tile_spans

#: Traversal costs by way kind and surface, and what holds where tags are missing or unknown.
HIGHWAY_COSTS = {"pedestrian": 0.0, "footway": 0.0, "path": 0.1, "living_street": 0.1, "track": 0.3, "service": 0.3, "residential": 0.5, "unclassified": 0.5, "tertiary": 0.7, "secondary": 0.9, "primary": 1.0}
SURFACE_COSTS = {"asphalt": 0.0, "paving_stones": 0.0, "concrete": 0.0, "fine_gravel": 0.1, "gravel": 0.2, "dirt": 0.3, "grass": 0.5, "sand": 0.4}
OFF_PATH, CAP, REACH = 0.9, 0.85, 2.0


#: Metres of a row that share its spans inside areas.
TILE_M = 64.0


def make_cells(boxes: DataFrame, size: float) -> DataFrame:
    """boxes' other columns, ix, iy, x, y: nodes low + i * size over [low, high)."""
    keys = [c for c in boxes.columns if c not in ("min_x", "min_y", "max_x", "max_y")]
    n = lambda low, high: F.ceil((F.col(high) - F.col(low)) / size).cast("int")
    rows = boxes.withColumns({"nx": n("min_x", "max_x"), "ny": n("min_y", "max_y")}).filter("nx > 0 and ny > 0")
    rows = dealt(rows, "min_x", "min_y").withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    return rows.select(*keys, "ix", "iy", (F.col("min_x") + F.col("ix") * size).alias("x"), (F.col("min_y") + F.col("iy") * size).alias("y"))


def make_cells_rounded(boxes: DataFrame, size: float) -> DataFrame:
    """The same over bounds that are rounded half to even."""
    return make_cells(boxes.withColumns({c: F.bround(c, 0).cast("int").cast("double") for c in ("min_x", "min_y", "max_x", "max_y")}), size)


def densify_ways(segments: DataFrame, step: float, payload: tuple[str, ...] = ()) -> DataFrame:
    """way_id, seg, k, x, y, payload: the first node (seg 0, k 0), then on each segment equal steps of at most `step` that end on its end; a segment of a millimetre or less gives its end only."""
    n = F.when(F.col("length") <= 0.001, 1).otherwise(F.ceil(F.col("length") / step)).cast("int")
    rows = segments.withColumn("n", n)
    steps = rows.withColumn("k", F.explode(F.when(F.col("seg") == 0, F.sequence(F.lit(0), F.col("n"))).otherwise(F.sequence(F.lit(1), F.col("n")))))
    t = F.col("k") / F.col("n")
    return steps.select("way_id", "seg", "k", G.interpolate(F.col("x1"), F.col("x2"), t).alias("x"), G.interpolate(F.col("y1"), F.col("y2"), t).alias("y"), *payload)


def lookup(table: dict[str, float], key: Column, unknown: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), key), F.lit(unknown))


def way_cost(highway: Column, surface: Column) -> Column:
    """Capped sum of both costs; a missing kind is a path, a missing surface asphalt; unknown ones cost 0.5 and 0."""
    return F.least(F.lit(CAP), lookup(HIGHWAY_COSTS, F.coalesce(highway, F.lit("path")), 0.5) + lookup(SURFACE_COSTS, F.coalesce(surface, F.lit("asphalt")), 0.0))


def unique_courses(segments: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """Segments (way_id, seg, x1, y1, x2, y2, payload) of different courses: of those that lie alike, and of ways' first segments that do, the smallest way and segment."""
    first = (F.col("seg") == 0).alias("first")
    least = segments.groupBy("x1", "y1", "x2", "y2", first).agg(F.min(F.struct("way_id", "seg", *payload)).alias("s"))
    return least.select("s.*", "x1", "y1", "x2", "y2", G.dist(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("length"))


#: Metres between the points along ways that costs refer to, at most.
WAY_STEP = 0.25


def _nearest(points: DataFrame, ref: DataFrame, reach: float, step: float, payload: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """The nearest of ref: points (ref_id, x, y), or the steps of segments (way_id, seg, x1, y1, x2, y2)."""
    return nearest_steps(points, ref, reach, step, payload, by) if "x1" in ref.columns else nearest_within(points, ref, reach, payload, by)


def _way_costs(points: DataFrame, ref: DataFrame, reach: float, step: float, by: tuple[str, ...] = ()) -> DataFrame:
    near = _nearest(points, ref, reach, step, ("way_cost",), by)
    return near.withColumn("cost", G.blend_cost(F.col("way_cost"), OFF_PATH, F.col("dist"), reach))


def nearest_way_cost(points: DataFrame, ref: DataFrame, reach: float = REACH, step: float = WAY_STEP, by: tuple[str, ...] = ()) -> DataFrame:
    """points (point_id, x, y) within reach of a way point: dist and the blended cost.

    ref: way points (ref_id, x, y, way_cost), or segments (way_id, seg, x1, y1, x2, y2, way_cost) whose points lie `step` apart.
    """
    near = _way_costs(positions(points, by), ref, reach, step, by).drop("x", "y").select(*by, "point_id.*", "dist", "ref_id", "way_cost", "cost")
    return points.select(*by, "point_id", "x", "y").join(shuffled(near), [*by, "x", "y"]).select(*by, "point_id", "x", "y", "dist", "ref_id", "way_cost", "cost")


def positions(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The distinct positions of cells, as points: point_id (x, y), x, y. Grids that overlap share theirs; each is asked for once."""
    return cells.select(*by, "x", "y").distinct().select(*by, F.struct("x", "y").alias("point_id"), "x", "y")


def burn_obstacles(cells: DataFrame, rings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """cells (point_id, x, y, ...) with blocked: inside any area, holes left out. Areas are filled row by row; cells meet the spans of their row in a tile."""
    rows = cells.withColumn("__tx", F.when(F.expr(finite("x", "y")), cell_of(F.col("x"), TILE_M)))
    spans = tile_spans(cells, rings, TILE_M, by).withColumnRenamed("tx", "__tx")
    hit = F.exists("__spans", lambda s: (F.col("x") >= s["low"]) & (F.col("x") < s["high"]))
    return rows.join(shuffled(spans), [*by, "__tx", "y"], "left").select(*cells.columns, F.coalesce(hit, F.lit(False)).alias("blocked"))


def cost_grid(cells: DataFrame, way_points: DataFrame, segments: DataFrame, rings: DataFrame, half_width: Column | float = 3.0, reach: float = REACH, step: float = WAY_STEP, by: tuple[str, ...] = ()) -> DataFrame:
    """cells (point_id, ix, iy, x, y) with cost and blocked. way_points: points or segments of ways with way_cost, as for nearest_way_cost().

    0.9 everywhere; 1 in areas away from ways by more than half_width (a number, or a column of segments, as roads are wider than
    footways); near a way the blend of its cost, if less; areas that no way covers are blocked with an infinite cost, which
    overrides the rest. All is worked out once a position, and then given to the cells there.
    """
    at = cut(positions(cells, by), "positions")
    inside = cut(positions_inside(at, rings, by=by).select(*by, F.struct("x", "y").alias("point_id"), "x", "y"), "inside")
    blocked = inside.join(shuffled(points_near_segments(inside, segments, half_width, by=by)), [*by, "point_id"], "left_anti").select(*by, "point_id", F.lit(True).alias("blocked"))
    near = _way_costs(at, way_points, reach, step, by).select(*by, "point_id", F.col("cost").alias("near_cost"))
    known = near.join(blocked, [*by, "point_id"], "full").select(*by, "point_id.*", "near_cost", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    rows = cells.join(shuffled(known), [*by, "x", "y"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    cost = F.when(F.col("blocked"), float("inf")).otherwise(F.least(F.lit(OFF_PATH), F.coalesce("near_cost", F.lit(OFF_PATH))))
    return rows.select(*by, "point_id", "ix", "iy", "x", "y", cost.alias("cost"), "blocked")


def world_to_cell(v: Column, low: float, size: float, count: int | None = None) -> Column:
    cell = F.floor((v - low) / size)
    return cell if count is None else F.least(F.greatest(cell, F.lit(0)), F.lit(count - 1))


def near_way_cloud(cells: DataFrame, ref: DataFrame, reach: float = 1.0, mode: str = "linear", step: float = WAY_STEP) -> DataFrame:
    """x, y, z = 0, cost of cells within reach of a way point; ref as for nearest_way_cost()."""
    near = _nearest(positions(cells), ref, reach, step).select("point_id.*", "dist")
    rows = cells.select("point_id", "x", "y").join(shuffled(near), ["x", "y"])
    return rows.select("point_id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"), G.neighbor_cost(F.col("dist"), reach, mode).cast("float").alias("cost"))


def fill_area_points(rings: DataFrame, density: float = 2.0) -> DataFrame:
    """area_id, x, y of the lattice points (multiples of 1 / density) inside each area, holes left out: each row's edge crossings, paired by the even-odd rule, make spans, and spans lattice points."""
    step = 1.0 / density
    e = ring_edges(rings).filter(finite("x1", "y1", "x2", "y2")).filter("y1 <> y2")
    rows = F.sequence(F.floor(F.least("y1", "y2") / step).cast("long"), F.ceil(F.greatest("y1", "y2") / step).cast("long"))
    e = e.withColumn("j", F.explode(rows)).withColumn("y", F.col("j") * F.lit(step))
    x = crossing_x(*(F.col(c) for c in ("y", "x1", "y1", "x2", "y2")))
    spans = row_spans(e.select("area_id", "ring", "y", x.alias("x")).filter("x is not null"))
    across = F.sequence(F.floor(F.col("low") / step).cast("long"), F.ceil(F.col("high") / step).cast("long"))
    return spans.withColumn("i", F.explode(across)).withColumn("x", F.col("i") * F.lit(step)).filter("x >= low and x < high").select("area_id", "x", "y")


def sample_outline(edges: DataFrame, density: float = 2.0) -> DataFrame:
    """edges (area_id, ring, pos, x1 .. y2) as points k = 0 .. n, n = ceil(length * density); joints repeat."""
    n = F.greatest(F.ceil(G.dist(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))) * density), F.lit(1)).cast("int")
    rows = edges.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("k") / F.col("n")
    return rows.select("area_id", "ring", "pos", "k", G.interpolate(F.col("x1"), F.col("x2"), t).alias("x"), G.interpolate(F.col("y1"), F.col("y2"), t).alias("y"))


def extend_line(segments: DataFrame, n: int, step: float = 1.0) -> DataFrame:
    """way_id, seg, k, x, y, dist: points k * step along each segment's line, n of them beyond either end; dist from the segment."""
    m = F.floor(F.col("length") / step).cast("int")
    rows = segments.filter("length > 0").withColumn("k", F.explode(F.sequence(F.lit(-n), m + n)))
    at = F.col("k") * step
    t = at / F.col("length")
    dist = F.when(at < 0, -at).when(at > F.col("length"), at - F.col("length")).otherwise(0.0)
    return rows.select("way_id", "seg", "k", G.interpolate(F.col("x1"), F.col("x2"), t).alias("x"), G.interpolate(F.col("y1"), F.col("y2"), t).alias("y"), dist.alias("dist"))


def corridor_points(legs: DataFrame, density: float = 1.0, width: float = 10.0) -> DataFrame:
    """path_id, leg, row, col, x, y, dist of a lattice band about each leg: rows along the normal, columns along the leg.

    dist is the row's distance from the leg. A leg without length gives its one point.
    """
    step, half = 1.0 / density, int(width / 2 * density)
    length = G.dist(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    rows = legs.withColumn("len", length).withColumn("n", F.ceil(F.col("len") * density).cast("int"))
    rows = rows.withColumn("row", F.explode(F.when(F.col("len") > 0, F.sequence(F.lit(-half), F.lit(half))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t, off = F.when(F.col("n") > 0, F.col("col") / F.col("n")).otherwise(0.0), F.col("row") * step
    nx, ny = F.coalesce(-(F.col("y2") - F.col("y1")) / F.nullif("len", F.lit(0.0)), F.lit(0.0)), F.coalesce((F.col("x2") - F.col("x1")) / F.nullif("len", F.lit(0.0)), F.lit(0.0))
    return rows.select("path_id", "leg", "row", "col", (G.interpolate(F.col("x1"), F.col("x2"), t) + nx * off).alias("x"), (G.interpolate(F.col("y1"), F.col("y2"), t) + ny * off).alias("y"), F.abs(off).alias("dist"))


def cost_grid_latlon(grid: DataFrame, zone: int) -> DataFrame:
    """lat, lon, cost of a grid's cells."""
    from ..functions.projection import to_latlon

    lat, lon = to_latlon(F.col("x"), F.col("y"), F.lit(zone))
    return grid.select("point_id", lat.alias("lat"), lon.alias("lon"), "cost")
