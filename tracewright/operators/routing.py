"""Graphs and batches of routes. edges: src, dst, weight, in both directions. requests: req, src, dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..tables import cut
from .joins import leg_collisions, snap_to_edge
from .overlay import Overlay, position_cells
from .sequences import drop_close_points, path_concat, simplify_paths, smooth_paths, splits_along_segment


def build_graph(segments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """src, dst, weight, way_id, seg of segments in both directions; a pair of nodes that several segments join keeps them all."""
    one = segments.select(*by, "src", "dst", F.col("length").alias("weight"), "way_id", "seg")
    return one.unionByName(one.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "way_id", "seg"))


def splice_annotations(segments: DataFrame, junctions: DataFrame) -> DataFrame:
    """src, dst, weight in both directions, as text ids 'n<node>': segments cut at junctions of drawn ways, and the connectors.

    junctions: way_id and pos of the drawn end with its node, to_way, seg, t, dist (see endpoint_edge_join). A junction's id is
    'j<way>:<pos>'. Each segment is cut on its own, in order along it.
    """
    text = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    j = junctions.select(F.concat(F.lit("j"), "way_id", F.lit(":"), "pos").alias("name"), text("node_id").alias("end"), F.col("to_way").alias("way_id"), "seg", "t", "dist")
    ends = segments.select("way_id", "seg", "length", F.explode(F.array(F.struct(F.lit(0.0).alias("t"), text("src").alias("name")), F.struct(F.lit(1.0).alias("t"), text("dst").alias("name")))).alias("p")).select("way_id", "seg", "length", "p.t", "p.name", F.lit(0.0).alias("dist"))
    stops = splits_along_segment(ends.unionByName(j.join(segments.select("way_id", "seg", "length"), ["way_id", "seg"]).select("way_id", "seg", "length", "t", "name", "dist")))
    w = W.partitionBy("way_id", "seg").orderBy("place")
    pieces = stops.select(F.col("name").alias("src"), F.lead("name").over(w).alias("dst"), ((F.lead("t").over(w) - F.col("t")) * F.col("length")).alias("weight")).filter("dst is not null")
    one = pieces.unionByName(j.select(F.col("end").alias("src"), F.col("name").alias("dst"), F.col("dist").alias("weight")))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


#: Steps that searches go on in one round.
HOPS = 3


def _relaxed(state: DataFrame, edges: DataFrame, goals: DataFrame) -> DataFrame:
    """One round: HOPS steps of offers from the fresh nodes, then the best of old and new a node; fresh are those that the last step improved.

    Offers that don't beat a search's way to its farthest goal, once all are reached, are dropped; along edges that are final (lead
    to a goal), so are those to other searches' goals.
    """
    met = state.join(goals, ["source", "node"], "left_semi").groupBy("source").agg(F.count("*").alias("met"), F.max("dist").alias("bound"))
    wanted = goals.groupBy("source").agg(F.count("*").alias("wanted"))
    bounds = met.join(wanted, "source").filter("met = wanted").select("source", "bound")
    final = ["final"] if "final" in edges.columns else []
    ahead, rows = state.filter("fresh").select("source", "node", "dist", "parent"), state.select("source", "node", "dist", "parent", F.lit(0).alias("hop"))
    for hop in range(1, HOPS + 1):
        offers = ahead.join(edges, (F.col("node") == F.col("src")) & (F.col("parent") != F.col("dst"))).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("parent"), *final)
        if final:
            offers = offers.filter("not final").unionByName(offers.filter("final").join(goals, ["source", "node"], "left_semi")).drop("final")
        offers = offers.join(bounds, "source", "left").filter("bound is null or dist < bound").drop("bound")
        ahead = offers.groupBy("source", "node").agg(F.min(F.struct("dist", "parent")).alias("b")).select("source", "node", "b.dist", "b.parent")
        rows = rows.unionByName(ahead.withColumn("hop", F.lit(hop)))
    # of equal offers the earliest stays: parents then never form a circle, steps without length included
    best = rows.groupBy("source", "node").agg(F.min(F.struct("dist", "hop", "parent")).alias("b"), F.min(F.when(F.col("hop") < HOPS, F.col("dist"))).alias("before"))
    return best.select("source", "node", "b.dist", "b.parent", F.coalesce(F.col("b.dist") < F.col("before"), F.lit(True)).alias("fresh"))


def _searched(edges: DataFrame, requests: DataFrame, most: int) -> DataFrame:
    """source, node, dist, parent of what the searches from the requests' different sources settled."""
    final = [F.first("final").alias("final")] if "final" in edges.columns else []
    best_edge = cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"), *final), "edges")
    goals = cut(requests.select(F.col("src").alias("source"), F.col("dst").alias("node")).distinct(), "goals")
    state = cut(goals.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.col("source").alias("parent"), F.lit(True).alias("fresh")).distinct(), "state")
    for _ in range(most):
        state = cut(_relaxed(state, best_edge, goals), "state")
        if state.filter("fresh").isEmpty():
            return state.drop("fresh")
    raise RuntimeError(f"searches aren't done after {most} rounds of {HOPS} steps")


def shortest_distances(edges: DataFrame, requests: DataFrame, most: int = 10_000) -> DataFrame:
    """req, node, dist, parent of every node that a request's search settled, by rounds of relaxation from its start.

    Requests from one start are one search. A round goes HOPS steps along the edges from the nodes that improved, keeps the best
    offer a node, and is a table in the shared folder. Searches that aren't done after `most` rounds are an error.
    """
    return requests.select("req", F.col("src").alias("source")).join(_searched(edges, requests, most), "source").select("req", "node", "dist", "parent")


def shortest_paths(edges: DataFrame, requests: DataFrame, most: int = 10_000, cells: DataFrame | None = None) -> DataFrame:
    """req, seq (from 0), node, dist along the shortest way of each request that has one.

    cells: node, cell (see overlay.position_cells); searches then go over the overlay of that partition, and any of several ways of
    the same length is found. Without cells they go from node to node, and ties go to what is found first, then to the smaller parent.
    """
    return found_ways(edges, requests, most) if cells is None else Overlay(edges, cells).paths(requests, most)


def found_ways(edges: DataFrame, requests: DataFrame, most: int = 10_000) -> DataFrame:
    """shortest_paths() from node to node.

    The ways back from the goals are found by pointer doubling: round k adds, to the nodes known to be on the way, their ancestors
    2**k steps up, so rounds grow with the logarithm of the way's length. Ways are worked out once a pair of start and goal.
    """
    tree = cut(_searched(edges, requests, most), "tree")
    pairs = requests.select(F.col("src").alias("source"), F.col("dst").alias("goal")).distinct()
    met = pairs.withColumn("node", F.col("goal")).join(tree.select("source", "node"), ["source", "node"], "left_semi")
    way = cut(met.select("source", "goal", "node", F.lit(0).cast("long").alias("back")), "way")
    up, steps = tree.filter("node <> parent").select("source", "node", F.col("parent").alias("to")), 1
    while not up.isEmpty():
        if steps > 1 << 40:
            raise RuntimeError("parents go round in a circle")
        way = cut(way.unionByName(way.join(up, ["source", "node"]).select("source", "goal", F.col("to").alias("node"), (F.col("back") + steps).alias("back"))), "way")
        above = up.select("source", F.col("node").alias("to"), F.col("to").alias("top"))
        up, steps = cut(up.join(above, ["source", "to"]).select("source", "node", F.col("top").alias("to")), "up"), 2 * steps
    placed = way.join(tree.select("source", "node", "dist"), ["source", "node"])
    placed = placed.withColumn("seq", F.row_number().over(W.partitionBy("source", "goal").orderBy(F.col("back").desc())) - 1)
    return requests.select("req", F.col("src").alias("source"), F.col("dst").alias("goal")).join(placed, ["source", "goal"]).select("req", "seq", "node", "dist")


def route_waypoints(paths: DataFrame, segments: DataFrame, nodes: DataFrame, cell_size: float = 40.0) -> DataFrame:
    """path_id, seq, x, y: each path's points routed along the ways, from point to its place on a way, along, and off to the next.

    Both ends of a leg get edges to the ends of the segment that they snap to; two on the same segment also a direct one. A path
    with a leg that can't be routed goes whole. Searches go over an overlay of squares of cell_size and its doublings.
    """
    by_path = W.partitionBy("path_id").orderBy("seq")
    points = paths.select(F.struct("path_id", "seq").alias("point_id"), "x", "y")
    snapped = cut(snap_to_edge(points, segments), "snapped")
    s = snapped.join(segments.select("way_id", "seg", "src", "dst", "x1", "y1", "x2", "y2"), ["way_id", "seg"])
    name = lambda side: F.concat(F.lit("p"), F.col("point_id.path_id"), F.lit(":"), F.col("point_id.seq"))
    s = cut(s.withColumn("name", name("")), "snapped")
    text = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    to_end = [s.select(F.col("name").alias("src"), text(end).alias("dst"), G.dist(F.col("px"), F.col("py"), F.col(x), F.col(y)).alias("weight")) for end, x, y in (("src", "x1", "y1"), ("dst", "x2", "y2"))]
    links = to_end[0].unionByName(to_end[1])
    legs = s.select("point_id.path_id", "point_id.seq", "name", "px", "py", "way_id", "seg").withColumns({c + "2": F.lead(c).over(by_path) for c in ("name", "px", "py", "way_id", "seg")}).filter("name2 is not null")
    direct = legs.filter("way_id = way_id2 and seg = seg2").select(F.col("name").alias("src"), F.col("name2").alias("dst"), G.dist(*(F.col(c) for c in ("px", "py", "px2", "py2"))).alias("weight"))
    graph = segments.select(text("src").alias("src"), text("dst").alias("dst"), F.col("length").alias("weight"))
    edges = graph.unionByName(links).unionByName(direct)
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    requests = cut(legs.select(F.struct("path_id", "seq").alias("req"), F.col("name").alias("src"), F.col("name2").alias("dst")), "requests")
    places = nodes.select(text("node_id").alias("node"), "x", "y").unionByName(s.select(F.col("name").alias("node"), F.col("px").alias("x"), F.col("py").alias("y")))
    routed = cut(shortest_paths(edges, requests, cells=position_cells(places, cell_size)), "routed")
    inner = routed.join(places, "node").select("req.path_id", F.col("req.seq").alias("leg"), (F.col("seq") + 1).alias("pos"), "x", "y")
    ok = routed.select("req").distinct()
    lost = requests.join(ok, "req", "left_anti").select("req.path_id").distinct()
    clicked = points.select("point_id.path_id", F.col("point_id.seq").alias("leg"), F.lit(0).alias("pos"), "x", "y")
    return path_concat(inner.unionByName(clicked).join(lost, "path_id", "left_anti"))


def raster_edges(cells: DataFrame, weight: float = 5.0) -> DataFrame:
    """src, dst, weight between neighbouring free cells (ix, iy, cost, blocked), eight ways: the step in cells times (1 + weight * cost of the cell stepped to)."""
    free = cells.filter(~F.col("blocked")).select("ix", "iy", "cost")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    out = free.select(F.struct("ix", "iy").alias("src"), F.explode(steps).alias("s"), "ix", "iy").select("src", (F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy"), F.sqrt(F.abs("s.i") + F.abs("s.j")).alias("step"))
    return out.join(free, ["ix", "iy"]).select("src", F.struct("ix", "iy").alias("dst"), (F.col("step") * (1 + weight * F.col("cost"))).alias("weight"))


#: Cells along a raster tile's side.
TILE = 16


def least_cost_raster_paths(cells: DataFrame, requests: DataFrame, weight: float = 5.0, simplify: bool = False, tile: int = TILE) -> DataFrame:
    """req, seq, ix, iy, dist of the cheapest ways between cells; requests: req, x0, y0, x1, y1. Ends off the grid or blocked give none.

    Searches go over tiles: cells along a tile's edges are its portals, and a search keeps portals only. simplify: ways of more than
    two cells keep the cells that lie off their chords by more than half a cell.
    """
    free = cells.filter(~F.col("blocked")).select("ix", "iy")
    wanted = requests.join(free.select(F.col("ix").alias("x0"), F.col("iy").alias("y0")), ["x0", "y0"], "left_semi").join(free.select(F.col("ix").alias("x1"), F.col("iy").alias("y1")), ["x1", "y1"], "left_semi")
    wanted = wanted.select("req", F.struct(F.col("x0").alias("ix"), F.col("y0").alias("iy")).alias("src"), F.struct(F.col("x1").alias("ix"), F.col("y1").alias("iy")).alias("dst"))
    tiles = free.select(F.struct("ix", "iy").alias("node"), F.xxhash64(F.floor(F.col("ix") / tile), F.floor(F.col("iy") / tile)).alias("cell"))
    found = shortest_paths(raster_edges(cells, weight), wanted, cells=tiles).select("req", "seq", "node.ix", "node.iy", "dist")
    if not simplify:
        return found
    found = cut(found, "found")
    thin = simplify_paths(found.select(F.col("req").alias("path_id"), "seq", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y")), 0.5, renumber=False)
    kept = found.join(thin.select(F.col("path_id").alias("req"), "seq"), ["req", "seq"])
    return kept.withColumn("seq", F.row_number().over(W.partitionBy("req").orderBy("seq")) - 1).select("req", "seq", "ix", "iy", "dist")


def replan_paths(paths: DataFrame, cells: DataFrame, rings: DataFrame, low: tuple[float, float], size: float, inflate: float = 0.25, simplify: bool = True, smooth: bool = False) -> DataFrame:
    """Legs that meet no obstacle stay; the others are routed over the cells; then close points go, and paths are smoothed or simplified as told. Paths with a leg that finds no way go."""
    w = W.partitionBy("path_id").orderBy("seq")
    legs = cut(paths.select("path_id", F.col("seq").alias("leg"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).filter("x2 is not null"), "legs")
    bad = cut(leg_collisions(legs, rings, inflate), "bad")
    cell = lambda c, i: F.floor((F.col(c) - low[i]) / size).cast("int")
    requests = legs.join(bad, ["path_id", "leg"], "left_semi").select(F.struct("path_id", "leg").alias("req"), cell("x1", 0).alias("x0"), cell("y1", 1).alias("y0"), cell("x2", 0).alias("x1"), cell("y2", 1).alias("y1"))
    routed = cut(least_cost_raster_paths(cells, requests), "routed")
    around = routed.select("req.path_id", "req.leg", (F.col("seq") + 1).alias("pos"), (low[0] + F.col("ix") * size).alias("x"), (low[1] + F.col("iy") * size).alias("y"))
    straight = legs.select("path_id", "leg", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1 << 30).alias("pos"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("path_id", "leg", "p.*")
    lost = bad.join(routed.select("req.path_id", "req.leg").distinct(), ["path_id", "leg"], "left_anti").select("path_id").distinct()
    new = drop_close_points(path_concat(straight.unionByName(around).join(lost, "path_id", "left_anti")))
    if smooth:
        new = smooth_paths(new, rings, inflate=inflate)
    return simplify_paths(new, size) if simplify else new


def path_changed(old: DataFrame, new: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """path_id, state: 1 if there is no new path, 0 if its point count differs or a point moved by more than the tolerance, else -1."""
    a, b = old.select("path_id", "seq", F.col("x").alias("ox"), F.col("y").alias("oy")), new.select("path_id", "seq", F.col("x").alias("nx"), F.col("y").alias("ny"))
    met = a.join(b, ["path_id", "seq"], "full")
    moved = F.coalesce(G.dist(*(F.col(c) for c in ("ox", "oy", "nx", "ny"))) > tolerance, F.lit(True))
    sums = met.groupBy("path_id").agg(F.bool_or(moved).alias("moved"), F.count("nx").alias("n"))
    return sums.select("path_id", F.when(F.col("n") == 0, 1).when(F.col("moved"), 0).otherwise(-1).alias("state"))
