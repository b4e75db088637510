"""Joins of ways, nodes, points, edges and polygons. Distance joins go by grid cells, so they are equality joins.

`by` names the columns that tell maps apart (map_id): ids then count within a map only.

way_nodes: way_id, pos, node_id. nodes: node_id, x, y. segments: way_id, seg, x1, y1, x2, y2. rings: area_id, ring, pos, x, y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..tables import cut, new_path, shuffled


def resolve_way_geometry(way_nodes: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """way_id, points (in order), is_area: closed if the first and last coordinates are equal. Nodes that are missing are passed over."""
    met = way_nodes.join(nodes.select(*by, "node_id", "x", "y"), [*by, "node_id"])
    points = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return met.groupBy(*by, "way_id").agg(points.alias("points")).withColumn("is_area", G.is_closed(F.col("points")))


def way_node_positions(way_nodes: DataFrame, nodes: DataFrame, overrides: DataFrame, vertices: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """way_nodes with x, y: of the override (way_id, node_id, x, y), else of the node, else of the vertex (way_id, pos, x, y)."""
    o = overrides.select(*by, "way_id", "node_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    n = nodes.select(*by, "node_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    v = vertices.select(*by, "way_id", "pos", F.col("x").alias("vx"), F.col("y").alias("vy"))
    met = way_nodes.join(o, [*by, "way_id", "node_id"], "left").join(n, [*by, "node_id"], "left").join(v, [*by, "way_id", "pos"], "left")
    return met.select(*by, "way_id", "pos", "node_id", F.coalesce("ox", "nx", "vx").alias("x"), F.coalesce("oy", "ny", "vy").alias("y"))


def stamp_relations(ways: DataFrame, members: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """ways (way_id, tags) with in_out and tags of their relations. members: rel_id, way_id, role, tags (of the relation).

    Role 'outer' gives outer, any other inner; the last relation says which. Outer ways take the relation's tags over their own,
    later relations over earlier ones.
    """
    ordered = members.groupBy(*by, "way_id").agg(F.array_sort(F.collect_list(F.struct("rel_id", F.when(F.col("role") == "outer", "outer").otherwise("inner").alias("side"), F.to_json("tags").alias("tags")))).alias("m"))
    kind = "map<string,string>"

    def over(tags: Column, m: Column) -> Column:
        new = F.from_json(m["tags"], kind)
        merged = F.map_concat(F.map_filter(tags, lambda k, _: ~F.map_contains_key(new, k)), new)
        return F.when(m["side"] == "outer", merged).otherwise(tags)

    met = ways.join(ordered, [*by, "way_id"], "left")
    tags = F.when(F.col("m").isNull(), F.col("tags")).otherwise(F.aggregate("m", F.col("tags"), over))
    return met.select(*by, "way_id", tags.alias("tags"), F.coalesce(F.try_element_at("m", F.lit(-1))["side"], F.lit("")).alias("in_out"))


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def around(size: float, reach: int = 1) -> Column:
    """The cells about a point's own (x, y), `reach` each way, as an array of cx, cy."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((cell_of(F.col("x"), size) + i).alias("cx"), (cell_of(F.col("y"), size) + j).alias("cy")))))


def one_a_position(ref: DataFrame, payload: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """ref (ref_id, x, y, payload) with the smallest ref_id of each position: others can't be nearer, nor win a tie."""
    return ref.groupBy(*by, "x", "y").agg(F.min(F.struct("ref_id", *payload)).alias("r")).select(*by, "r.*", "x", "y")


MICRO = 1e6


def micro(d: Column) -> Column:
    """A distance in whole micrometres: what decides which of several is nearest, so that rounding errors decide no ties."""
    return F.floor(d * MICRO + 0.5)


def nearest_within(points: DataFrame, ref: DataFrame, reach: float, payload: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """points (point_id, x, y) with dist and cost = dist / reach to the nearest of ref (ref_id, x, y, payload) closer than reach; others go.

    ref, one row a position, is dealt to 3 x 3 cells of size reach; ties (to the micrometre) go to the smaller ref_id.
    """
    p = points.withColumn("cx", cell_of(F.col("x"), reach)).withColumn("cy", cell_of(F.col("y"), reach))
    r = one_a_position(ref, payload, by).select(*by, "ref_id", F.col("x").alias("rx"), F.col("y").alias("ry"), *payload, F.explode(around(reach)).alias("c"))
    r = r.select(*by, "ref_id", "rx", "ry", *payload, F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"))
    d = G.dist(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))
    met = p.join(shuffled(r), [*by, "cx", "cy"]).withColumn("dist", d).filter(micro(F.col("dist")) < reach * MICRO)
    best = F.min(F.struct(micro(F.col("dist")).alias("near"), "ref_id", *payload, "dist")).alias("best")
    near = met.groupBy(*by, "point_id").agg(F.first("x").alias("x"), F.first("y").alias("y"), best)
    return near.select(*by, "point_id", "x", "y", "best.dist", "best.ref_id", *(f"best.{c}" for c in payload)).withColumn("cost", F.col("dist") / reach)


def nearest_steps(points: DataFrame, segments: DataFrame, reach: float, step: float, payload: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """nearest_within() of the points that densify_ways() would put along the segments (way_id, seg, x1 .. y2, payload), without making them.

    ref_id is (way_id, seg, k). A segment's nearest step follows from where the point is projected on it. So segments are dealt to cells, and a point meets a segment near it once, however fine the steps.
    """
    size, at = 4 * reach, [F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]
    n = F.when(F.col("length") <= 0.001, 1).otherwise(F.ceil(F.col("length") / step)).cast("int")
    s = segments.withColumn("length", G.dist(*at[2:])).withColumn("n", n).select(*by, "way_id", "seg", "x1", "y1", "x2", "y2", "n", *payload)
    p = points.filter(finite("x", "y")).select(*by, "point_id", "x", "y", cell_of(F.col("x"), size).alias("cx"), cell_of(F.col("y"), size).alias("cy"))
    met = p.join(shuffled(segment_cells(s, size, reach)), [*by, "cx", "cy"])
    for v in "xy":
        met = met.filter(f"{v} between least({v}1, {v}2) - {reach} and greatest({v}1, {v}2) + {reach}")
    # the line through the segment passes within reach, too: long segments have wide bounds
    off = "((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1))"
    met = met.filter(f"{off} * {off} <= {(reach + SLACK) ** 2} * ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) + {SLACK}")
    # the step next to where the point is projected; of two that are as near, the first
    k = F.ceil(G.project_on_segment(*at) * F.col("n") - (0.5 + SLACK)).cast("int")
    met = met.withColumn("k", F.least(F.greatest(k, F.when(F.col("seg") == 0, 0).otherwise(1)), F.col("n")))
    t = F.col("k") / F.col("n")
    met = met.withColumn("dist", G.dist(at[0], at[1], G.interpolate(at[2], at[4], t), G.interpolate(at[3], at[5], t)))
    best = F.min(F.struct(micro(F.col("dist")).alias("near"), "way_id", "seg", "k", *payload, "dist")).alias("best")
    near = met.filter(micro(F.col("dist")) < reach * MICRO).groupBy(*by, "point_id").agg(F.first("x").alias("x"), F.first("y").alias("y"), best)
    ref = F.struct("best.way_id", "best.seg", "best.k").alias("ref_id")
    return near.select(*by, "point_id", "x", "y", "best.dist", ref, *(f"best.{c}" for c in payload)).withColumn("cost", F.col("dist") / reach)


#: Metres by which cells are dealt too widely, so that rounding loses none.
SLACK = 1e-6


def finite(*names: str) -> str:
    """The condition that the columns are numbers, neither null nor infinite."""
    return " and ".join(f"coalesce(abs({c}) < double('infinity'), false)" for c in names)


def segment_cells(segments: DataFrame, size: float, margin: Column | float = 0.0) -> DataFrame:
    """segments, a row for each cell of size `size` that they come within `margin` of, by either axis: cx, cy.

    Cells are dealt column by column along the segment, so a long one makes rows by its length and not by its bounds. Segments
    with coordinates that are no finite numbers make none. Choose size near the usual length.
    """
    m = (margin if isinstance(margin, Column) else F.lit(margin)) + SLACK
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rows = segments.filter(finite("x1", "y1", "x2", "y2")).withColumn("cx", F.explode(F.sequence(cell_of(F.least(x1, x2) - m, size), cell_of(F.greatest(x1, x2) + m, size))))
    slope = (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))  # least() and greatest() pass over nulls
    low_x, high_x = F.greatest(F.least(x1, x2), F.col("cx") * size - m), F.least(F.greatest(x1, x2), (F.col("cx") + 1) * size + m)
    at = lambda x, otherwise: F.when(x1 == x2, otherwise).otherwise(F.least(F.greatest(y1 + (x - x1) * slope, F.least(y1, y2)), F.greatest(y1, y2)))
    ends = at(low_x, y1), at(high_x, y2)
    return rows.withColumn("cy", F.explode(F.sequence(cell_of(F.least(*ends) - m, size), cell_of(F.greatest(*ends) + m, size))))


def snap_to_edge(points: DataFrame, segments: DataFrame, size: float = 25.0, rounds: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """points (point_id, x, y) with the nearest segment's way_id, seg, the projected px, py and dist; ties (to the micrometre) to the smaller way and segment.

    Cells double in size until every point has a segment within reach; a point found at distance d in a pass of reach r >= d is
    settled, the rest go on. A point without finite coordinates gets no row, nor does any whose map has no segments that have them.
    Points that are left after `rounds` passes are an error.
    """
    left, done = points.select(*by, "point_id", "x", "y").filter(finite("x", "y")), None
    segments = segments.filter(finite("x1", "y1", "x2", "y2"))
    if by:  # a map without segments would never settle
        left = cut(left.join(segments.select(*by).distinct(), list(by), "left_semi"), "unsnapped")
    for k in range(rounds):
        reach = size * 2**k
        p = left.select(*by, "point_id", "x", "y", F.explode(around(reach)).alias("c")).select(*by, "point_id", "x", "y", "c.cx", "c.cy")
        met = p.join(shuffled(segment_cells(segments, reach)), [*by, "cx", "cy"])
        t = G.project_on_segment(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
        met = met.withColumn("px", G.interpolate(F.col("x1"), F.col("x2"), t)).withColumn("py", G.interpolate(F.col("y1"), F.col("y2"), t))
        met = met.withColumn("dist", G.dist(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).filter(micro(F.col("dist")) <= reach * MICRO)
        best = F.min(F.struct(micro(F.col("dist")).alias("near"), "way_id", "seg", "px", "py", "dist")).alias("n")
        near = met.groupBy(*by, "point_id").agg(best).select(*by, "point_id", "n.dist", "n.way_id", "n.seg", "n.px", "n.py")
        found = cut(points.select(*by, "point_id", "x", "y").join(near, [*by, "point_id"]), "snapped")
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found.select(*by, "point_id"), [*by, "point_id"], "left_anti"), "unsnapped")
        if left.isEmpty() or k == 0 and segments.isEmpty():
            return done
    raise RuntimeError(f"points are left after {rounds} rounds of snapping")


def endpoint_edge_join(endpoints: DataFrame, segments: DataFrame, reach: float = 5.0, by: tuple[str, ...] = ()) -> DataFrame:
    """endpoints (way_id, pos, x, y) of drawn ways with the nearest segment of another way within reach: to_way, seg, px, py, dist, t. Ties (to the micrometre) go to the smaller way and segment."""
    p = endpoints.select(*by, F.col("way_id").alias("own"), "pos", "x", "y", F.explode(around(reach)).alias("c")).select(*by, "own", "pos", "x", "y", "c.cx", "c.cy")
    met = p.join(shuffled(segment_cells(segments, reach)), [*by, "cx", "cy"]).filter("own <> way_id")
    met = met.withColumn("t", G.project_on_segment(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))))
    met = met.withColumn("px", G.interpolate(F.col("x1"), F.col("x2"), F.col("t"))).withColumn("py", G.interpolate(F.col("y1"), F.col("y2"), F.col("t")))
    met = met.withColumn("dist", G.dist(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).filter(micro(F.col("dist")) <= reach * MICRO)
    best = F.min(F.struct(micro(F.col("dist")).alias("near"), F.col("way_id").alias("to_way"), "seg", "px", "py", "t", "dist")).alias("n")
    return met.groupBy(*by, F.col("own").alias("way_id"), "pos").agg(best).select(*by, "way_id", "pos", "n.dist", "n.to_way", "n.seg", "n.px", "n.py", "n.t")


def ring_edges(rings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """area_id, ring, pos, x1, y1, x2, y2 of the consecutive ring points."""
    w = W.partitionBy(*by, "area_id", "ring").orderBy("pos")
    return rings.select(*by, "area_id", "ring", "pos", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).filter("x2 is not null")


#: Rows of cells that an area's edges are dealt to, at most; cells that its bounds touch each way, about.
ROWS, ACROSS = 1024, 4


def area_boxes(rings: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """area_id, x1, y1, x2, y2, level and row of each area: cells of size * 2**level span its bounds in a few, rows of height `row` in ROWS at most."""
    b = rings.filter(finite("x", "y")).groupBy(*by, "area_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    wide, high = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.col("y2") - F.col("y1")
    level = F.when(wide > size * ACROSS, F.ceil(F.log2(wide / (size * ACROSS)))).otherwise(0).cast("int")
    return b.withColumn("level", level).withColumn("row", F.greatest(F.lit(size), high / ROWS))


def crossing_x(y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where the edge meets the height y; null where it doesn't: an edge holds its lower end and not its upper one."""
    return F.when((y1 > y) != (y2 > y), (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def row_spans(crossings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """area_id, y, low, high: the stretches low <= x < high of each row inside an area, from its crossings (area_id, ring, y, x).

    In a row the crossings of a ring, in order, open and close it by turns (even-odd rule). Inside is where the outer ring (0) is open and
    no hole is.
    """
    rows = crossings.repartition(*by, "area_id", "y")  # both windows go by this one shuffle
    turn = F.row_number().over(W.partitionBy(*by, "area_id", "ring", "y").orderBy("x")) % 2 * 2 - 1
    w = W.partitionBy(*by, "area_id", "y").orderBy("x")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    outer = F.sum(F.when(F.col("ring") == 0, F.col("turn")).otherwise(0)).over(upto)
    holes = F.sum(F.when(F.col("ring") == 0, 0).otherwise(F.col("turn"))).over(upto)
    swept = rows.withColumn("turn", turn).select(*by, "area_id", "y", F.col("x").alias("low"), F.lead("x").over(w).alias("high"), outer.alias("outer"), holes.alias("holes"))
    return swept.filter("outer = 1 and holes = 0 and low < high").select(*by, "area_id", "y", "low", "high")


def positions_inside(at: DataFrame, rings: DataFrame, tile: float = 64.0, by: tuple[str, ...] = ()) -> DataFrame:
    """x, y of the rows of at that lie inside any area, holes left out, row of positions by row.

    The different heights y in a tile's width are rows. A row meets the areas whose bounds it crosses (by cells whose size goes with the area's), the
    edges of an area it meets are found by height, and their crossings make spans. Positions then ask only whether a span of their row
    and tile holds them, so no position meets an edge. Coordinates that are no finite numbers are in nothing and bound nothing.
    """
    p = at.filter(finite("x", "y")).select(*by, "x", "y", cell_of(F.col("x"), tile).alias("tx"))
    a, b = p.alias("a"), _row_pieces(p, rings, tile, by).alias("b")
    held = (F.col("a.tx") == F.col("b.tx")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.x") >= F.col("b.low")) & (F.col("a.x") < F.col("b.high"))
    for c in by:
        held = held & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(shuffled(b), held, "left_semi").select(*by, "x", "y")


def tile_spans(at: DataFrame, rings: DataFrame, tile: float, by: tuple[str, ...] = ()) -> DataFrame:
    """tx, y, __spans (low, high) of the tiles and heights of the positions at: the stretches low <= x < high inside any area, those that overlap put together."""
    p = at.filter(finite("x", "y")).select(*by, "x", "y", cell_of(F.col("x"), tile).alias("tx"))
    w = W.partitionBy(*by, "tx", "y").orderBy("low", "high")
    upto = F.max("high").over(w.rowsBetween(W.unboundedPreceding, -1))
    pieces = _row_pieces(p, rings, tile, by).distinct().withColumn("new", F.coalesce((F.col("low") > upto).cast("int"), F.lit(1)))
    pieces = pieces.withColumn("k", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = pieces.groupBy(*by, "tx", "y", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return spans.groupBy(*by, "tx", "y").agg(F.collect_list(F.struct("low", "high")).alias("__spans"))


def _row_pieces(p: DataFrame, rings: DataFrame, tile: float, by: tuple[str, ...]) -> DataFrame:
    """y, low, high, tx: the stretches inside areas on the rows of p (x, y, tx), by the tiles that they touch."""
    boxes = area_boxes(rings, tile, by)
    levels = sorted(r.level for r in boxes.select("level").distinct().collect())  # doublings of a size: some tens at most
    rows = p.select(*by, "tx", "y").distinct().withColumn("level", F.explode(F.array(*(F.lit(k) for k in levels or [0]))))
    own = F.lit(tile) * F.pow(F.lit(2.0), F.col("level"))
    rows = rows.withColumns({"cx": F.floor(F.col("tx") * tile / own).cast("long"), "cy": F.floor(F.col("y") / own).cast("long")})
    span = lambda c: F.sequence(F.floor(F.col(c + "1") / own).cast("long"), F.floor(F.col(c + "2") / own).cast("long"))
    cells = boxes.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    wanted = rows.join(shuffled(cells), [*by, "level", "cx", "cy"]).filter(f"y >= y1 and y <= y2 and tx * {tile} <= x2 and (tx + 1) * {tile} > x1")
    wanted = wanted.select(*by, "area_id", "y", F.floor(F.col("y") / F.col("row")).cast("long").alias("band")).distinct()
    e = ring_edges(rings, by).filter(finite("x1", "y1", "x2", "y2")).filter("y1 <> y2").join(boxes.select(*by, "area_id", "row"), [*by, "area_id"])
    e = e.withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2") / F.col("row")).cast("long"), F.floor(F.greatest("y1", "y2") / F.col("row")).cast("long")))).drop("row")
    x = crossing_x(*(F.col(c) for c in ("y", "x1", "y1", "x2", "y2")))
    spans = row_spans(wanted.join(shuffled(e), [*by, "area_id", "band"]).select(*by, "area_id", "ring", "y", x.alias("x")).filter("x is not null"), by)
    return spans.select(*by, "y", "low", "high", F.explode(F.sequence(cell_of(F.col("low"), tile), cell_of(F.col("high"), tile))).alias("tx"))


def points_in_polygons(points: DataFrame, rings: DataFrame, size: float = 10.0, by: tuple[str, ...] = ()) -> DataFrame:
    """point_id, area_id of points (point_id, x, y) inside areas: inside the outer ring (0) and in none of the holes (1, 2, ...).

    A point meets the areas whose bounds hold it by cells whose size goes with the area's, then their edges by area and row (y);
    parity is counted per ring. So an area makes few cells however large it is, and its edges are met row by row. Rows whose
    coordinates are no finite numbers are in nothing and bound nothing.
    """
    boxes = area_boxes(rings, size, by)
    levels = sorted(r.level for r in boxes.select("level").distinct().collect())  # doublings of a size: some tens at most
    at = F.col("size") if len(levels) > 1 else F.lit(size * 2.0 ** (levels[0] if levels else 0))
    p = points.filter(finite("x", "y")).select(*by, "point_id", "x", "y")
    if len(levels) > 1:
        p = p.withColumn("size", F.explode(F.array(*(F.lit(size * 2.0**k) for k in levels))))
    p = p.withColumns({"size": at, "cx": F.floor(F.col("x") / at).cast("long"), "cy": F.floor(F.col("y") / at).cast("long")})
    own = F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
    span = lambda c: F.sequence(F.floor(F.col(c + "1") / own).cast("long"), F.floor(F.col(c + "2") / own).cast("long"))
    cells = boxes.withColumn("size", own).withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    maybe = p.join(shuffled(cells.drop("level")), [*by, "size", "cx", "cy"]).filter("x >= x1 and x <= x2 and y >= y1 and y <= y2")
    maybe = maybe.select(*by, "point_id", "area_id", "x", "y", F.floor(F.col("y") / F.col("row")).cast("long").alias("cy"))
    e = ring_edges(rings, by).filter(finite("x1", "y1", "x2", "y2")).join(boxes.select(*by, "area_id", "row"), [*by, "area_id"])
    e = e.filter("y1 <> y2").withColumn("cy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / F.col("row")).cast("long"), F.floor(F.greatest("y1", "y2") / F.col("row")).cast("long")))).drop("row")
    met = maybe.join(shuffled(e), [*by, "area_id", "cy"]).filter(F.coalesce(G.crosses_ray(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))), F.lit(False)))
    # both groupings go by one shuffle
    odd = met.select(*by, "point_id", "area_id", "ring").repartition(*by, "point_id", "area_id").groupBy(*by, "point_id", "area_id", "ring").count().filter("count % 2 = 1")
    return odd.groupBy(*by, "point_id", "area_id").agg(F.min("ring").alias("low"), F.max("ring").alias("high")).filter("low = 0 and high = 0").select(*by, "point_id", "area_id")


def obstacles_minus_paths(cells: DataFrame, rings: DataFrame, segments: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells (point_id, x, y) inside an area and farther than radius from every way segment."""
    inside = points_in_polygons(cells, rings, by=by).select(*by, "point_id").distinct()
    hit = cut(cells.join(shuffled(inside), [*by, "point_id"], "left_semi"), "hit")
    return hit.join(shuffled(points_near_segments(hit, segments, radius, by=by)), [*by, "point_id"], "left_anti")


def near_segments(points: DataFrame, segments: DataFrame, radius: Column | float, size: float = 10.0, by: tuple[str, ...] = ()) -> DataFrame:
    """point_id, way_id, seg, dist of every segment within radius of a point; radius may be a column of segments."""
    return _met_segments(points, segments, radius, size, by).groupBy(*by, "point_id", "way_id", "seg").agg(F.min("dist").alias("dist"))


def points_near_segments(points: DataFrame, segments: DataFrame, radius: Column | float, size: float = 10.0, by: tuple[str, ...] = ()) -> DataFrame:
    """point_id of the points within radius of any segment; segments of one course count once, with their largest radius."""
    r = radius if isinstance(radius, Column) else F.lit(radius)
    courses = segments.groupBy(*by, "x1", "y1", "x2", "y2").agg(F.max(r).alias("within"))
    return _met_segments(points, courses, F.col("within"), size, by).select(*by, "point_id").distinct()


def _met_segments(points: DataFrame, segments: DataFrame, radius: Column | float, size: float, by: tuple[str, ...]) -> DataFrame:
    """Points with the segments within radius of them and dist: a point in its own cell, segments in all cells within their radius."""
    r = radius if isinstance(radius, Column) else F.lit(radius)
    p = points.filter(finite("x", "y")).select(*by, "point_id", "x", "y", cell_of(F.col("x"), size).alias("cx"), cell_of(F.col("y"), size).alias("cy"))
    met = p.join(shuffled(segment_cells(segments.withColumn("__within", r), size, F.col("__within"))), [*by, "cx", "cy"])
    met = met.filter("x between least(x1, x2) - __within and greatest(x1, x2) + __within and y between least(y1, y2) - __within and greatest(y1, y2) + __within")
    return met.withColumn("dist", G.point_segment_dist(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))).filter(F.col("dist") <= F.col("__within")).drop("__within")


def leg_collisions(legs: DataFrame, rings: DataFrame, inflate: float = 0.25, size: float = 25.0, by: tuple[str, ...] = ()) -> DataFrame:
    """path_id, leg of legs (path_id, leg, x1, y1, x2, y2) that meet an area grown by inflate: they cross or come near an edge, or start inside.

    Legs and edges meet in the cells along them; a pair is compared if their bounds and the leg's line come within inflate of the edge.
    """
    e = ring_edges(rings, by).select(*by, "x1", "y1", "x2", "y2").distinct()
    corners = ("x1", "y1", "x2", "y2")
    keys = (*by, "cx", "cy")
    near = segment_cells(e, size, inflate).select(*(F.col(c).alias("e" + c) for c in (*keys, *corners)))
    # bounds that come within inflate, and an edge that isn't wholly on one side of the leg's line, farther from it than inflate
    off = [f"((x2 - x1) * (ey{i} - y1) - (y2 - y1) * (ex{i} - x1))" for i in (1, 2)]
    reach = f"{inflate + SLACK} * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
    close = [f"least({one}{v}1, {one}{v}2) <= greatest({two}{v}1, {two}{v}2) + {inflate}" for v in "xy" for one, two in (("", "e"), ("e", ""))]
    close = F.expr(" and ".join([*close, f"least({off[0]}, {off[1]}) <= {reach}", f"greatest({off[0]}, {off[1]}) >= -{reach}"]))
    a, b, c, d = ((F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y2"), ("ex1", "ey1"), ("ex2", "ey2")))
    gap = F.least(G.point_segment_dist(*a, *c, *d), G.point_segment_dist(*b, *c, *d), G.point_segment_dist(*c, *a, *b), G.point_segment_dist(*d, *a, *b))
    on = close & (G.segments_intersect(a, b, c, d) | (gap <= inflate))
    for k in keys:
        on = (F.col(k) == F.col("e" + k)) & on
    # the first edge that a leg meets in a cell settles it: no pair is kept
    crossing = segment_cells(legs.select(*by, "path_id", "leg", *corners), size).join(shuffled(near), on, "left_semi").select(*by, "path_id", "leg")
    starts = legs.select(*by, F.struct("path_id", "leg").alias("point_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    inside = points_in_polygons(starts, rings, by=by).select(*by, "point_id.*")
    return crossing.unionByName(inside).distinct()


def paths_near(legs: DataFrame, rings: DataFrame, size: float = 25.0) -> DataFrame:
    """path_id of paths that may come within a leg's own distance `within` of an area: a leg's bounds, grown by it, meet an edge's in a cell, or a leg starts inside. None that does is left out."""
    corners = ("x1", "y1", "x2", "y2")
    e = segment_cells(ring_edges(rings).select(*corners).distinct(), size).select("cx", "cy", *(F.col(c).alias("e" + c) for c in corners))
    a = segment_cells(legs.select("path_id", *corners, "within"), size, F.col("within"))
    met = [F.least(one + v + "1", one + v + "2") - F.col("within") <= F.greatest(two + v + "1", two + v + "2") for v in "xy" for one, two in (("", "e"), ("e", ""))]
    on = (a.cx == e.cx) & (a.cy == e.cy) & met[0] & met[1] & met[2] & met[3]
    starts = legs.select(F.struct("path_id", "leg").alias("point_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return a.join(shuffled(e), on, "left_semi").select("path_id").unionByName(points_in_polygons(starts, rings).select("point_id.path_id")).distinct()


def line_cells(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, k, ix, iy: the cells of the straight line from (x0, y0) to (x1, y1), whole numbers."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    rows = lines.withColumn("major", F.greatest(dx, dy)).withColumn("minor", F.least(dx, dy)).withColumn("flat", dx > dy)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("major").cast("long"))))
    m = F.when(F.col("major") == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((2 * F.col("k") * F.col("minor") - F.col("major")) / (2 * F.col("major"))))).cast("long")
    sx, sy = F.when(F.col("x1") > F.col("x0"), 1).otherwise(-1), F.when(F.col("y1") > F.col("y0"), 1).otherwise(-1)
    ix, iy = F.col("x0") + sx * F.when(F.col("flat"), F.col("k")).otherwise(m), F.col("y0") + sy * F.when(F.col("flat"), m).otherwise(F.col("k"))
    return rows.select(*keys, "k", ix.cast("long").alias("ix"), iy.cast("long").alias("iy"))


def segment_cost(lines: DataFrame, cells: DataFrame, keys: tuple[str, ...], weight: float = 5.0, threshold: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """keys, avg_cost, blocked, cost of lines over cells (ix, iy, cost): blocked if a cell costs threshold or more, else length * (1 + weight * mean). Cells off the grid don't count. by: columns among keys that cells have, too."""
    met = line_cells(lines, keys).join(cells.select(*by, "ix", "iy", "cost"), [*by, "ix", "iy"], "left").groupBy(*keys).agg(F.avg("cost").alias("avg_cost"), F.max("cost").alias("most"))
    length = G.dist(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))
    met = lines.select(*keys, length.alias("length")).join(met, list(keys))
    blocked = F.coalesce(F.col("most") >= threshold, F.lit(False))
    return met.select(*keys, F.coalesce("avg_cost", F.lit(0.0)).alias("avg_cost"), blocked.alias("blocked"), F.when(~blocked, F.col("length") * (1 + weight * F.coalesce("avg_cost", F.lit(0.0)))).alias("cost"))


#: Later points that are tried from a kept point at first, from the far end on; each try that finds none takes twice as many.
LOOK = 32


def line_of_sight_prune(paths: DataFrame, cells: DataFrame, threshold: float = 1.0, look: int = LOOK) -> DataFrame:
    """paths (path_id, seq, ix, iy): from each kept point on to the farthest later point with a free line of cells, the next one at least.

    All paths go on at once. A round tries, for each path, a block of later points from its kept point on, the farthest first, until a
    block holds a free one; that is kept and is where the path goes on. So a round has at most a block of lines a path; blocks double
    while nothing is free. Kept points are appended to a table; a path that has come to its end leaves.
    """
    by = W.partitionBy("path_id").orderBy("seq")
    rows = cut(paths.withColumns({"at": F.row_number().over(by).cast("long"), "last": F.count(F.lit(1)).over(W.partitionBy("path_id"))}), "points")
    spark, out = rows.sparkSession, new_path(rows.sparkSession, "kept")
    start = rows.filter("at = 1").select("path_id", F.col("at").alias("here"), "last", F.col("last").alias("upto"), F.lit(look).cast("long").alias("block"))
    state = cut(start, "sight")
    state.select("path_id", F.col("here").alias("at")).write.parquet(out)
    state = state.filter("here < last")
    while not state.isEmpty():
        low = F.greatest(F.col("here") + 1, F.col("upto") - F.col("block") + 1)
        here = state.join(rows.select("path_id", F.col("at").alias("here"), F.col("ix").alias("x0"), F.col("iy").alias("y0")), ["path_id", "here"]).withColumn("low", low)
        lines = here.join(rows.select("path_id", "at", F.col("ix").alias("x1"), F.col("iy").alias("y1")), "path_id").filter("at >= low and at <= upto and at > here + 1")
        free = segment_cost(lines.select("path_id", "at", "x0", "y0", "x1", "y1"), cells, ("path_id", "at"), 0.0, threshold).filter("not blocked")
        found = free.groupBy("path_id").agg(F.max("at").alias("found"))
        step = here.select("path_id", "here", "last", "upto", "block", "low").join(found, "path_id", "left")
        to = F.coalesce("found", F.when(F.col("low") == F.col("here") + 1, F.col("low")))
        step = cut(step.select("path_id", F.coalesce(to, "here").alias("here"), to.isNotNull().alias("moved"), "last", F.when(to.isNotNull(), F.col("last")).otherwise(F.col("low") - 1).alias("upto"), F.when(to.isNotNull(), F.lit(look).cast("long")).otherwise(2 * F.col("block")).alias("block")), "sight")
        step.filter("moved").select("path_id", F.col("here").alias("at")).write.mode("append").parquet(out)
        state = step.filter("here < last").drop("moved")
    kept = spark.read.schema(rows.select("path_id", "at").schema).parquet(out)
    return rows.join(kept, ["path_id", "at"]).select(*paths.columns)


def footways_near_junction(way_nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """node_id, a, b: pairs of ways (a < b) that share the node. Pairs grow with the square of a node's ways; junction_hubs() has a row a way."""
    one = way_nodes.select(*by, "node_id", F.col("way_id").alias("a")).distinct()
    two = way_nodes.select(*by, "node_id", F.col("way_id").alias("b")).distinct()
    return one.join(two, [*by, "node_id"]).filter("a < b")


def junction_hubs(way_nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """node_id, way_id, hub (the node's smallest way) of nodes that several ways share: what footways_near_junction() pairs, a row a way."""
    used = way_nodes.select(*by, "node_id", "way_id").distinct()
    hubs = used.groupBy(*by, "node_id").agg(F.min("way_id").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return used.join(hubs, [*by, "node_id"])
