"""Operators along ways and paths: segments, splits, thinning, joining, smoothing; and small set operators.

`by` names the columns that tell maps apart (map_id): ids then count within a map only.

way_nodes: way_id, pos, node_id. paths: path_id, seq, x, y.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import projection as P
from ..tables import cut

def by_path():
    return W.partitionBy("path_id").orderBy("seq")


def way_segments(way_nodes: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """way_id, seg, src, dst, x1, y1, x2, y2, length of consecutive nodes."""
    w = W.partitionBy(*by, "way_id").orderBy("pos")
    met = way_nodes.join(nodes.select(*by, "node_id", "x", "y"), [*by, "node_id"])
    rows = met.select(*by, "way_id", (F.row_number().over(w) - 1).alias("seg"), F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return rows.filter("dst is not null").withColumn("length", G.dist(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))


def split_ways(way_nodes: DataFrame, splits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """base_id, seg, pos, node_id: ways cut at interior split nodes (way_id, node_id), which belong to both sides.

    seg is null for closed ways and for ways on which no split has an effect; pos starts at 0 in each segment.
    """
    way = W.partitionBy(*by, "way_id")
    rows = way_nodes.join(splits.select(*by, "way_id", "node_id", F.lit(1).alias("cut")).distinct(), [*by, "way_id", "node_id"], "left")
    ends = [F.min("pos").over(way), F.max("pos").over(way)]
    ordered = way.orderBy("pos")
    rows = rows.withColumn("closed", F.first("node_id").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == F.last("node_id").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = rows.withColumn("n", F.count("*").over(way)).withColumn("closed", F.col("closed") & (F.col("n") > 1))
    rows = rows.withColumn("cut", F.when((F.col("pos") > ends[0]) & (F.col("pos") < ends[1]) & ~F.col("closed"), F.coalesce("cut", F.lit(0))).otherwise(0))
    rows = rows.withColumn("cuts", F.sum("cut").over(way)).withColumn("part", F.coalesce(F.sum("cut").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    both = F.when(F.col("cut") == 1, F.array(F.col("part"), F.col("part") + 1)).otherwise(F.array("part"))
    rows = rows.select(*by, "way_id", "pos", "node_id", "cuts", F.explode(both).alias("part"))
    place = F.row_number().over(W.partitionBy(*by, "way_id", "part").orderBy("pos")) - 1
    return rows.select(*by, F.col("way_id").alias("base_id"), F.when(F.col("cuts") > 0, F.col("part")).cast("int").alias("seg"), place.alias("pos"), "node_id")


def endpoint_flag(way_nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    way = W.partitionBy(*by, "way_id")
    return way_nodes.withColumn("is_end", (F.col("pos") == F.min("pos").over(way)) | (F.col("pos") == F.max("pos").over(way)))


def renumbered(paths: DataFrame, order: str = "seq") -> DataFrame:
    return paths.withColumn("seq", (F.row_number().over(W.partitionBy("path_id").orderBy(order)) - 1).cast("int"))


def drop_close_points(paths: DataFrame, least: float = 0.05) -> DataFrame:
    """Drops points at most `least` from the point before them; paths of two points or fewer stay."""
    d = G.dist(F.lag("x").over(by_path()), F.lag("y").over(by_path()), F.col("x"), F.col("y"))
    rows = paths.withColumns({"d": d, "n": F.count("*").over(W.partitionBy("path_id"))})
    return renumbered(rows.filter(F.col("d").isNull() | (F.col("d") > least) | (F.col("n") <= 2)).drop("d", "n"))


def reverse_path(paths: DataFrame) -> DataFrame:
    return paths.withColumn("seq", F.max("seq").over(W.partitionBy("path_id")) - F.col("seq"))


def subsample_path(paths: DataFrame, every: int = 10) -> DataFrame:
    """Every tenth point and the last."""
    return paths.withColumn("last", F.max("seq").over(W.partitionBy("path_id"))).filter((F.col("seq") % every == 0) | (F.col("seq") == F.col("last"))).drop("last")


def prepend_position(paths: DataFrame, positions: DataFrame) -> DataFrame:
    """Puts each path's current position (path_id, x, y) first."""
    return renumbered(paths.select("path_id", "seq", "x", "y").unionByName(positions.select("path_id", F.lit(-1).alias("seq"), "x", "y")))


def interleave_changes(one: DataFrame, two: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both lists by their middle rank (i + 1/2) / n, the first list's first on ties; adds kind (0, 1) and place."""
    keys = list(by) or [F.lit(0)]

    def ranked(df: DataFrame, kind: int) -> DataFrame:
        w = W.partitionBy(*keys)
        return df.withColumns({"kind": F.lit(kind), "rank": (F.row_number().over(w.orderBy(order)) - 0.5) / F.count("*").over(w)})

    both = ranked(one, 0).unionByName(ranked(two, 1))
    return both.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("rank", "kind", order))).drop("rank")


def path_concat(legs: DataFrame) -> DataFrame:
    """legs (path_id, leg, pos, x, y) as one path each, less points within a millimetre of the one before them."""
    w = W.partitionBy("path_id").orderBy("leg", "pos")
    rows = legs.withColumn("d", G.dist(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"))).filter(F.col("d").isNull() | (F.col("d") > 0.001))
    return rows.select("path_id", (F.row_number().over(w) - 1).cast("int").alias("seq"), "x", "y")


def path_length_m(paths: DataFrame) -> DataFrame:
    """path_id, length_m (great-circle, from lat and lon) and its label."""
    d = P.haversine(F.lag("lat").over(by_path()), F.lag("lon").over(by_path()), F.col("lat"), F.col("lon"))
    sums = paths.withColumn("d", d).groupBy("path_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length_m"))
    return sums.withColumn("label", P.length_label(F.col("length_m")))


#: What the sums of smooth_paths() leave out, as a share of a path's extent.
LEFT_OUT = 1e-13


def _faded(rows: DataFrame, sums: dict[str, Callable], ratio: float, w) -> DataFrame:
    """rows with each column v of sums as v + ratio * v' + ratio^2 * v'' ..., of the rows behind (F.lag) or ahead (F.lead): log2 steps, each of which doubles the reach, over one window."""
    reach = 1
    while ratio > 0 and ratio**reach > LEFT_OUT:
        rows = rows.withColumns({v: F.col(v) + ratio**reach * F.coalesce(side(v, reach).over(w), F.lit(0.0)) for v, side in sums.items()})
        reach *= 2
    return rows


def _settled(rows: DataFrame, w_data: float, w_smooth: float, w) -> DataFrame:
    """sx, sy: where sweeps end. How far points have moved there solves a tridiagonal system of the path's bends, whose influences fade by `ratio` a point; two multiples of that fading put the ends right."""
    root = math.sqrt(w_data * (w_data + 4 * w_smooth))
    ratio = 2 * w_smooth / (w_data + 2 * w_smooth + root) if w_smooth else 0.0
    if ratio == 1:  # nothing holds the points: they end evenly spaced on the chord
        return rows.withColumns({"s" + v: F.last(v).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.col("at") / F.nullif(F.col("n"), F.lit(0)) for v in "xy"})
    bends = {v: F.coalesce(F.lag(v).over(w) + F.lead(v).over(w) - 2 * F.col(v), F.lit(0.0)) for v in "xy"}
    rows = _faded(rows.withColumns({side + v: bends[v] for v in "xy" for side in "fbk"}), {"fx": F.lag, "fy": F.lag, "bx": F.lead, "by": F.lead}, ratio, w)
    rows = rows.withColumns({"u" + v: w_smooth / root * (F.col("f" + v) + F.col("b" + v) - F.col("k" + v)) for v in "xy"})
    whole, fade = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), lambda k: F.pow(F.lit(ratio), k)
    rows = rows.withColumns({end + v: -of("u" + v).over(whole) for v in "xy" for end, of in (("from", F.first), ("to", F.last))})
    far = fade(F.col("n"))

    def at(v: str) -> Column:
        one, two = F.col("from" + v), F.col("to" + v)
        return F.col(v) + F.col("u" + v) + ((one - two * far) * fade(F.col("at")) + (two - one * far) * fade(F.col("n") - F.col("at"))) / F.nullif(1 - far * far, F.lit(0.0))

    return rows.withColumns({"s" + v: at(v) for v in "xy"})


def _legs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """path_id, leg, x1 .. y2 of rows' points (ox + x, oy + y)."""
    ends = rows.select("path_id", F.col("seq").alias("leg"), (F.col("ox") + F.col(x)).alias("x1"), (F.col("oy") + F.col(y)).alias("y1"))
    w = W.partitionBy("path_id").orderBy("leg")
    return ends.withColumns({"x2": F.lead("x1").over(w), "y2": F.lead("y1").over(w)}).filter("x2 is not null")


def smooth_paths(paths: DataFrame, rings: DataFrame | None = None, w_data: float = 0.5, w_smooth: float = 0.3, tol: float = 1e-3, inflate: float = 0.25, most: int = 200) -> DataFrame:
    """path_id, seq, x, y: interior points relaxed towards the path and their neighbours, ends fixed.

    The rule is that of sweeps in order of seq, each point drawn by w_data to where it was and by w_smooth to its neighbours (that
    before it already moved), until a sweep moves a path's points by less than tol in sum. Without rings, points are put where sweeps
    end (_settled): one shuffle, whatever the length of a path, off by LEFT_OUT and the sweeps' own remainder, which is of the order of tol.
    With rings, a path whose new state meets an obstacle keeps its last free state. Only paths that might, by how far their
    points can get, are swept at all, a table a sweep; those that still move after `most` are an error, and so are weights with which
    sweeps don't settle. Points without finite coordinates stay, and are ends to the points beside them; paths of two points or fewer stay.
    """
    from .joins import finite, leg_collisions, paths_near

    if w_data < 0 or w_smooth < 0 or w_data + 2 * w_smooth >= 2:
        raise ValueError("sweeps don't settle with such weights")
    if not w_data and not w_smooth:
        return paths.select("path_id", "seq", "x", "y")
    bad = F.when(F.expr(finite("x", "y")), 0).otherwise(1)
    rows = paths.select("path_id", "seq", "x", "y").withColumn("part", 2 * F.sum(bad).over(by_path()) + bad)
    w = W.partitionBy("path_id", "part").orderBy("seq")
    placed = {"at": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(W.partitionBy("path_id", "part")) - 1, "ox": F.first("x").over(w), "oy": F.first("y").over(w)}
    rows = rows.withColumns({"x0": F.col("x"), "y0": F.col("y")}).withColumns(placed)
    rows = rows.withColumns({"x": F.col("x") - F.col("ox"), "y": F.col("y") - F.col("oy")})
    moves = (F.col("at") > 0) & (F.col("at") < F.col("n"))
    out = [F.when(moves, F.col("o" + v) + F.col("s" + v)).otherwise(F.col(v + "0")).alias(v) for v in "xy"]
    still = _settled(rows, w_data, w_smooth, w)
    if rings is None:
        return still.select("path_id", "seq", *out)
    rest = {"s" + v: F.when(moves, F.col("s" + v)).otherwise(F.col(v)) for v in "xy"}
    still = cut(still.withColumns(rest).select("path_id", "part", "seq", "at", "n", "ox", "oy", "x", "y", "x0", "y0", "sx", "sy"), "settled")
    # in every sweep points come no farther from where they end than the farthest point of their path was, if a sweep shrinks that
    shrinks = abs(1 - w_data - 2 * w_smooth) + 2 * w_smooth <= 1
    gap = still.groupBy("path_id").agg(G.dist(F.max(F.abs(F.col("x") - F.col("sx"))), F.max(F.abs(F.col("y") - F.col("sy"))), F.lit(0.0), F.lit(0.0)).alias("gap"))
    legs = _legs(still, "sx", "sy").join(gap, "path_id").withColumn("within", F.coalesce("gap", F.lit(0.0)) + inflate)
    near = cut(paths_near(legs, rings) if shrinks else still.select("path_id").distinct(), "near")
    done = still.join(near, "path_id", "left_anti").select("path_id", "seq", *out)
    state = cut(still.join(near, "path_id", "left_semi").drop("sx", "sy").withColumns({"px": F.col("x"), "py": F.col("y")}), "sweep")
    for _ in range(most):
        if state.isEmpty():
            return done
        drawn = {"s" + v: F.when(F.col("at") == 0, F.col(v)).otherwise((1 - w_data - 2 * w_smooth) * F.col(v) + w_data * F.col("p" + v) + w_smooth * F.lead(v).over(w)) for v in "xy"}
        step = _faded(state.withColumns(drawn), {"sx": F.lag, "sy": F.lag}, w_smooth, w).withColumns(rest)
        change = F.sum(F.coalesce(F.abs(F.col("sx") - F.col("x")) + F.abs(F.col("sy") - F.col("y")), F.lit(0.0))).over(W.partitionBy("path_id"))
        step = cut(step.withColumn("change", change), "swept")
        met = leg_collisions(_legs(step, "sx", "sy"), rings, inflate).select("path_id").distinct().withColumn("met", F.lit(True))
        step = cut(step.join(met, "path_id", "left"), "sweep")
        free = step.filter("met is null")
        held = step.filter("met").select("path_id", "seq", *(F.when(moves, F.col("o" + v) + F.col(v)).otherwise(F.col(v + "0")).alias(v) for v in "xy"))
        done = done.unionByName(held).unionByName(free.filter(F.col("change") < tol).select("path_id", "seq", *out))
        state = free.filter(F.col("change") >= tol).select(*(c for c in state.columns if c not in ("x", "y")), F.col("sx").alias("x"), F.col("sy").alias("y"))
    if state.isEmpty():
        return done
    raise RuntimeError(f"paths still move after {most} sweeps")


def simplify_paths(paths: DataFrame, eps: float, renumber: bool = True) -> DataFrame:
    """path_id, seq, x, y of the points that farthest-point simplification keeps: both ends, and wherever a stretch's farthest point lies off its chord by more than eps, that point, and so on to its sides.

    All stretches of all paths go one level a round, as rows of points with the ends of their stretch, so a long path is no single
    group; the farthest point is the first of several. Rounds go with the depth of the halving, and stretches that are done leave. A
    point whose distance is no number is never the farthest. seq counts from 0 anew, unless renumber is off.
    """
    points = paths.select("path_id", F.col("seq").cast("int").alias("seq"), "x", "y")
    ends = points.groupBy("path_id").agg(F.min(F.struct("seq", "x", "y")).alias("a"), F.max(F.struct("seq", "x", "y")).alias("b"))
    kept = ends.select("path_id", F.explode(F.array("a", "b")).alias("p")).select("path_id", "p.seq").distinct()
    live = points.join(ends, "path_id").filter("seq > a.seq and seq < b.seq")
    while True:
        d = G.point_segment_dist(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
        live = cut(live.select("path_id", "seq", "x", "y", "a", "b", F.when(d > eps, F.nanvl(d, F.lit(0.0))).otherwise(0.0).alias("d")), "stretches")
        far = live.groupBy("path_id", F.col("a.seq").alias("from")).agg(F.max(F.struct("d", (-F.col("seq")).alias("back"), "x", "y")).alias("m"))
        far = cut(far.filter(F.col("m.d") > eps).select("path_id", "from", F.struct((-F.col("m.back")).alias("seq"), "m.x", "m.y").alias("m")), "farthest")
        if far.isEmpty():
            break
        kept = kept.unionByName(far.select("path_id", "m.seq"))
        met = live.withColumn("from", F.col("a.seq")).join(far, ["path_id", "from"]).filter("seq <> m.seq")
        before = F.col("seq") < F.col("m.seq")
        live = met.select("path_id", "seq", "x", "y", F.when(before, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(before, F.col("m")).otherwise(F.col("b")).alias("b"))
    out = points.join(kept, ["path_id", "seq"])
    return renumbered(out) if renumber else out.select("path_id", "seq", "x", "y")


def splits_along_segment(junctions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """junctions (way_id, seg, t, dist, ...) with place: 1, 2, ... along the segment; ties go by their other columns."""
    return junctions.withColumn("place", F.row_number().over(W.partitionBy(*by, "way_id", "seg").orderBy("t", "dist", *(c for c in junctions.columns if c not in (*by, "way_id", "seg", "t", "dist")))))


def nearest_one(pairs: DataFrame, key: str, dist: str, tie: str) -> DataFrame:
    """Each key's row of the smallest distance, then the smallest tie column."""
    others = [c for c in pairs.columns if c not in (key, dist, tie)]
    return pairs.groupBy(key).agg(F.min(F.struct(dist, tie, *others)).alias("n")).select(key, "n.*")


def latest_changes(log: DataFrame, n: int) -> DataFrame:
    """The newest n changes."""
    return log.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def all_features(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def barriers_union(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    return ways.unionByName(nodes, allowMissingColumns=True)


def effective_nodes(nodes: DataFrame, added: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """nodes with added ones in place of those of the same node_id."""
    both = nodes.select(*by, "node_id", "x", "y", F.lit(1).alias("rank")).unionByName(added.select(*by, "node_id", "x", "y", F.lit(0).alias("rank")))
    return both.withColumn("rn", F.row_number().over(W.partitionBy(*by, "node_id").orderBy("rank"))).filter("rn = 1").drop("rn", "rank")


def ids_except(ids: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return ids.join(other.select(key).distinct(), key, "left_anti")
