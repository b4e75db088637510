"""Edit logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as E
from .feature_queries import classified
from .fixtures import Town, query


@query("SELECT op, way_id AS target, event_id FROM (SELECT *, row_number() OVER (PARTITION BY op, way_id ORDER BY ts DESC, event_id DESC) AS rn FROM fx_edit_log) AS l WHERE rn = 1 AND NOT is_undo")
def current_edits(t: Town):
    return E.current_edits(log(t)).select("op", "target", "event_id")


#: Maps of the log, a thousand ways each.
MAP = "CAST(floor(way_id / 1000) AS BIGINT)"


def log(t: Town):
    return t.edit_log.select(F.expr(MAP).alias("map_id"), "event_id", "ts", "op", F.col("way_id").alias("target"), "is_undo", F.col("num").alias("payload"))


@query("SELECT DISTINCT op AS map_id, CAST(way_id AS VARCHAR) AS way_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS node_id FROM fx_edit_log WHERE op IN ('delete', 'hide')")
def normalize_deletions(t: Town):
    """Deletions written in both encodings, a store row an event, and read to one."""
    rows = t.edit_log.filter("op in ('delete', 'hide')")
    way, node = F.col("way_id").cast("string"), F.col("event_id").cast("string")
    whole = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("["), way, F.lit("]"))).when(F.col("event_id") % 2 == 1, F.concat(F.lit('[{"id":'), way, F.lit(',"category":"road"}]'))).otherwise("[]")
    nodes = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"'), way, F.lit('":['), node, F.lit("]}"))).when(F.col("event_id") % 2 == 0, F.concat(F.lit('[{"way_id":"'), way, F.lit('","node_id":'), node, F.lit("}]"))).otherwise("[]")
    return E.normalize_deletions(rows.select(F.col("op").alias("map_id"), whole.alias("deleted_ways"), nodes.alias("deleted_nodes")))


@query("SELECT way_id AS base_id, pos AS seg FROM fx_way_nodes WHERE way_id % 70 <> 0 AND NOT (way_id % 30 = 0 AND pos = 1)")
def apply_way_deletes(t: Town):
    rows = t.way_nodes.select(F.col("way_id").alias("base_id"), F.col("pos").alias("seg"))
    whole = rows.filter("base_id % 70 = 0").select("base_id", F.lit(None).cast("int").alias("seg"))
    return E.apply_way_deletes(rows, whole.unionByName(rows.filter("base_id % 30 = 0 and seg = 1")))


WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query(f"""WITH r0 AS (SELECT w.way_id, pos, node_id, category, first_value(node_id) OVER (PARTITION BY w.way_id ORDER BY pos {WHOLE}) = last_value(node_id) OVER (PARTITION BY w.way_id ORDER BY pos {WHOLE}) AND count(*) OVER (PARTITION BY w.way_id) > 2 AS closed FROM fx_way_nodes AS w JOIN fx_class AS c ON c.way_id = w.way_id),
r1 AS (SELECT *, first_value(node_id) OVER (PARTITION BY way_id ORDER BY pos {WHOLE}) AS f, last_value(node_id) OVER (PARTITION BY way_id ORDER BY pos {WHOLE}) AS l, min(pos) OVER (PARTITION BY way_id) AS b, max(pos) OVER (PARTITION BY way_id) AS e FROM r0 WHERE node_id % 5 <> 0),
r2 AS (SELECT way_id, pos, node_id, category, closed FROM r1 UNION ALL SELECT way_id, e + 1, node_id, category, closed FROM r1 WHERE closed AND f <> l AND pos = b),
r3 AS (SELECT *, count(*) OVER (PARTITION BY way_id) AS n, count(DISTINCT node_id) OVER (PARTITION BY way_id) AS d FROM r2)
SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS pos, node_id FROM r3 WHERE n >= 2 AND d >= CASE WHEN closed AND category = 'barrier' THEN 3 ELSE 2 END""")
def apply_node_deletes(t: Town):
    rows = t.way_nodes.join(classified(t).select(F.col("base_id").alias("way_id"), "category"), "way_id").select("way_id", "pos", "node_id", "category")
    return E.apply_node_deletes(rows, rows.filter("node_id % 5 = 0")).drop("category")


@query("""WITH w AS (SELECT way_id, pos, node_id, max(pos) OVER (PARTITION BY way_id) AS hi, first_value(node_id) OVER (PARTITION BY way_id ORDER BY pos) = last_value(node_id) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AND count(*) OVER (PARTITION BY way_id) > 1 AS closed FROM fx_way_nodes),
c AS (SELECT *, CASE WHEN node_id % 3 = 0 AND pos > 0 AND pos < hi AND NOT closed THEN 1 ELSE 0 END AS cut FROM w),
p AS (SELECT *, sum(cut) OVER (PARTITION BY way_id ORDER BY pos) - cut AS part, sum(cut) OVER (PARTITION BY way_id) AS cuts FROM c),
b AS (SELECT way_id, pos, node_id, part, cuts FROM p UNION ALL SELECT way_id, pos, node_id, part + 1, cuts FROM p WHERE cut = 1),
o AS (SELECT way_id AS base_id, CASE WHEN cuts > 0 THEN CAST(part AS INT) END AS seg, row_number() OVER (PARTITION BY way_id, part ORDER BY pos) - 1 AS pos, node_id FROM b)
SELECT * FROM o WHERE NOT (seg IS NOT NULL AND seg = 1 AND base_id % 30 = 0 AND base_id IN (SELECT way_id FROM fx_way_nodes WHERE pos = 1))""")
def apply_splits(t: Town):
    rows = t.way_nodes.select("way_id", "pos", "node_id")
    deletes = rows.filter("way_id % 30 = 0 and pos = 1").select(F.col("way_id").alias("base_id"), F.col("pos").alias("seg"))
    return E.apply_splits(rows, rows.filter("node_id % 3 = 0"), deletes)


MOVES = "SELECT way_id, (way_id * 13) % (SELECT count(*) FROM part) AS node_id, event_id, ts, num FROM fx_edit_log WHERE op = 'move'"


@query(f"WITH m AS (SELECT way_id, node_id, arg_max(num, (ts, event_id)) AS dx FROM ({MOVES}) AS v GROUP BY way_id, node_id) SELECT p.way_id, pos, p.node_id, round(coalesce(458000 + dx, x), 6) AS x, y FROM fx_placed AS p LEFT JOIN m ON p.way_id = m.way_id AND p.node_id = m.node_id")
def apply_moves(t: Town):
    moves = t.sql(MOVES).join(t.nodes.select("node_id", "y"), "node_id").select("way_id", "node_id", F.struct("ts", "event_id").alias("ts"), (F.col("num") + 458000).alias("x"), "y")
    out = E.apply_moves(t.placed, moves)
    return out.select("way_id", "pos", "node_id", F.round("x", 6).alias("x"), "y")


@query("""WITH a AS (SELECT way_id, event_id, (way_id * 13) % (SELECT count(*) FROM part) AS anchor, ts FROM fx_edit_log WHERE op = 'add_node'),
b AS (SELECT way_id, pos, 0 AS sub, node_id FROM fx_way_nodes UNION ALL SELECT a.way_id, w.pos, row_number() OVER (PARTITION BY a.way_id, w.pos ORDER BY ts, event_id), -event_id FROM a JOIN (SELECT way_id, node_id, min(pos) AS pos FROM fx_way_nodes GROUP BY ALL) AS w ON a.way_id = w.way_id AND a.anchor = w.node_id)
SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY pos, sub) - 1 AS pos, node_id FROM b""")
def apply_added_nodes(t: Town):
    added = t.sql("SELECT way_id, -event_id AS node_id, (way_id * 13) % (SELECT count(*) FROM part) AS after_node_id, struct(ts, event_id) AS ts FROM fx_edit_log WHERE op = 'add_node'")
    return E.apply_added_nodes(t.way_nodes, added)


def overrides(t: Town):
    tags = F.create_map(F.lit("highway"), F.when(F.col("way_id") % 20 == 0, "steps").otherwise("service"), F.lit("name"), F.lit("n"))
    return t.ways.filter("way_id % 4 = 0").select(F.col("way_id").alias("base_id"), tags.alias("tags"))


@query("SELECT way_id AS base_id, CASE WHEN way_id % 4 <> 0 OR category = 'barrier' THEN category WHEN way_id % 20 = 0 THEN 'footway' ELSE 'road' END AS category, CASE WHEN way_id % 4 <> 0 THEN highway WHEN way_id % 20 = 0 THEN 'steps' ELSE 'service' END AS highway, surface FROM fx_class")
def apply_tag_overrides(t: Town):
    out = E.apply_tag_overrides(classified(t), overrides(t))
    return out.select("base_id", "category", F.try_element_at("tags", F.lit("highway")).alias("highway"), F.try_element_at("tags", F.lit("surface")).alias("surface"))


#: Drawn features: every third path a line with a highway or none, one in six with a width; the others walls and fences. Maps of a hundred paths.
DRAWN = """d0 AS (SELECT path_id, CAST(floor(path_id / 100) AS BIGINT) AS map_id, count(*) AS n, path_id % 3 = 0 AS line FROM fx_paths GROUP BY path_id),
d1 AS (SELECT *, -row_number() OVER (PARTITION BY map_id ORDER BY path_id) AS base_id FROM d0),
drawn AS (SELECT *, CASE WHEN line THEN CASE WHEN path_id % 9 = 0 THEN 'primary' ELSE 'path' END END AS highway, CASE WHEN NOT line THEN CASE WHEN path_id % 5 = 0 THEN 'fence' ELSE 'wall' END END AS barrier, CASE WHEN line AND path_id % 6 = 0 THEN '4' END AS width,
  CAST(coalesce(sum(CASE WHEN line THEN n ELSE 0 END) OVER (PARTITION BY map_id ORDER BY path_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d1)"""


def drawn(t: Town):
    shape = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    line = F.col("path_id") % 3 == 0
    props = F.create_map(F.lit("highway"), F.when(line & (F.col("path_id") % 9 == 0), "primary"), F.lit("width"), F.when(line & (F.col("path_id") % 6 == 0), "4"), F.lit("barrier"), F.when(~line & (F.col("path_id") % 5 == 0), "fence"))
    a = t.paths.groupBy("path_id").agg(shape.alias("points"))
    return a.select(F.floor(F.col("path_id") / 100).alias("map_id"), F.col("path_id").alias("ann_id"), F.when(line, "path").otherwise("obstacle").alias("type"), "points", F.map_filter(props, lambda _, v: v.isNotNull()).alias("props"))


@query(f"""WITH {DRAWN} SELECT map_id, base_id, CASE WHEN NOT line THEN 'barrier' WHEN highway = 'primary' THEN 'road' ELSE 'footway' END AS category, CASE WHEN NOT line THEN 0 WHEN width IS NULL THEN 0.75 ELSE 2 END::DOUBLE AS radius, highway, barrier, width,
CASE WHEN line THEN n ELSE 0 END AS n_nodes, CASE WHEN line THEN -before - 1 END AS first_node FROM drawn""")
def annotations_to_features(t: Town):
    tag = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    return E.annotations_to_features(drawn(t)).select("map_id", "base_id", "category", "radius", tag("highway"), tag("barrier"), tag("width"), F.size("nodes").cast("long").alias("n_nodes"), F.get("nodes", F.lit(0)).alias("first_node"))


def edits_of(t: Town) -> dict:
    edits = E.current_edits(log(t))
    ways = lambda op: edits.filter(F.col("op") == op).select(F.col("target").alias("way_id"), "ts", "event_id", "payload")
    first = t.way_nodes.filter("pos = 1").select("way_id", "node_id")
    moves = ways("move").join(t.placed.filter("pos = 0"), "way_id").select("way_id", "node_id", "ts", (F.col("x") + 1).alias("x"), "y")
    tags = ways("tag").select(F.col("way_id").alias("base_id"), F.create_map(F.lit("highway"), F.lit("steps")).alias("tags"))
    deletes = ways("delete").select(F.col("way_id").alias("base_id"), F.lit(None).cast("int").alias("seg"))
    return {"way_deletes": deletes, "node_deletes": ways("hide").join(first, "way_id").select("way_id", "node_id"), "splits": ways("add_node").join(first, "way_id").select("way_id", "node_id"), "moves": moves, "tags": tags}


def edited(t: Town) -> dict:
    return E.edited_map(classified(t), t.way_nodes.select("way_id", "pos", "node_id"), t.nodes, edits_of(t))


def edited_two(t: Town) -> dict:
    """The town as two maps, of the even and the odd ways, whose ids (the half) are the same, each under its edits and drawn features."""

    def two(df, key):
        half = F.floor(F.col(key) / 2)
        return df.withColumns({"map_id": F.col(key) % 2, key: half}).select("map_id", *df.columns)

    parts = {k: two(v, "way_id" if "way_id" in v.columns else "base_id") for k, v in edits_of(t).items()}
    maps = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("map_id")
    nodes = t.nodes.select(maps, "node_id", "x", "y").withColumn("x", F.col("x") + 1000 * F.col("map_id"))
    parts["moves"] = parts["moves"].withColumn("x", F.col("x") + 1000 * F.col("map_id"))
    features = two(classified(t).select("base_id", "category", "radius", "tags"), "base_id")
    return E.edited_map(features, two(t.way_nodes.select("way_id", "pos", "node_id"), "way_id"), nodes, parts | {"annotations": drawn(t)}, by=("map_id",))


ALL = WHOLE
#: The edited town as common table expressions: cur (edits in force), lw (ways left), parts, placed.
EDITED = f"""WITH cur AS (SELECT op, way_id FROM (SELECT *, row_number() OVER (PARTITION BY op, way_id ORDER BY ts DESC, event_id DESC) AS rn FROM fx_edit_log) AS l WHERE rn = 1 AND NOT is_undo),
lw AS (SELECT way_id, category, highway FROM fx_class WHERE way_id NOT IN (SELECT way_id FROM cur WHERE op = 'delete')),
p1 AS (SELECT op, w.way_id, node_id FROM fx_way_nodes AS w JOIN cur ON cur.way_id = w.way_id WHERE pos = 1),
r0 AS (SELECT w.way_id, w.pos, w.node_id, lw.category, first_value(node_id) OVER (PARTITION BY w.way_id ORDER BY pos {ALL}) = last_value(node_id) OVER (PARTITION BY w.way_id ORDER BY pos {ALL}) AND count(*) OVER (PARTITION BY w.way_id) > 2 AS closed FROM fx_way_nodes AS w JOIN lw ON w.way_id = lw.way_id),
r1 AS (SELECT * FROM r0 WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE op = 'hide' AND p1.way_id = r0.way_id AND p1.node_id = r0.node_id)),
r2 AS (SELECT *, first_value(node_id) OVER (PARTITION BY way_id ORDER BY pos {ALL}) AS f, last_value(node_id) OVER (PARTITION BY way_id ORDER BY pos {ALL}) AS l, min(pos) OVER (PARTITION BY way_id) AS b, max(pos) OVER (PARTITION BY way_id) AS e FROM r1),
r3 AS (SELECT way_id, pos, node_id, category, closed FROM r2 UNION ALL SELECT way_id, e + 1, node_id, category, closed FROM r2 WHERE closed AND f <> l AND pos = b),
r4 AS (SELECT *, count(*) OVER (PARTITION BY way_id) AS n, count(DISTINCT node_id) OVER (PARTITION BY way_id) AS d FROM r3),
r5 AS (SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS pos, node_id FROM r4 WHERE n >= 2 AND d >= CASE WHEN closed AND category = 'barrier' THEN 3 ELSE 2 END),
s0 AS (SELECT *, first_value(node_id) OVER (PARTITION BY way_id ORDER BY pos {ALL}) = last_value(node_id) OVER (PARTITION BY way_id ORDER BY pos {ALL}) AS closed, max(pos) OVER (PARTITION BY way_id) AS hi FROM r5),
s1 AS (SELECT *, CASE WHEN pos > 0 AND pos < hi AND NOT closed AND EXISTS (SELECT 1 FROM p1 WHERE op = 'add_node' AND p1.way_id = s0.way_id AND p1.node_id = s0.node_id) THEN 1 ELSE 0 END AS cut FROM s0),
s2 AS (SELECT *, sum(cut) OVER (PARTITION BY way_id ORDER BY pos) - cut AS part, sum(cut) OVER (PARTITION BY way_id) AS cuts FROM s1),
s3 AS (SELECT way_id, pos, node_id, part, cuts FROM s2 UNION ALL SELECT way_id, pos, node_id, part + 1, cuts FROM s2 WHERE cut = 1),
parts AS (SELECT way_id AS base_id, CASE WHEN cuts > 0 THEN CAST(part AS INT) END AS seg, row_number() OVER (PARTITION BY way_id, part ORDER BY pos) - 1 AS pos, node_id FROM s3),
moved AS (SELECT p.way_id, p.node_id FROM fx_placed AS p JOIN cur ON cur.way_id = p.way_id WHERE op = 'move' AND pos = 0),
placed AS (SELECT base_id, seg, pos, p.node_id, CASE WHEN m.way_id IS NOT NULL THEN x + 1 ELSE x END AS x, y FROM parts AS p JOIN fx_nodes AS n ON n.node_id = p.node_id LEFT JOIN moved AS m ON m.way_id = base_id AND m.node_id = p.node_id),
shown AS (SELECT way_id AS base_id, CASE WHEN category = 'road' AND way_id IN (SELECT way_id FROM cur WHERE op = 'tag') THEN 'footway' ELSE category END AS category FROM lw),
named AS (SELECT *, CAST(base_id AS VARCHAR) || CASE WHEN seg IS NULL THEN '' ELSE ':' || seg END AS feature_id FROM placed)"""
CHOSEN = "(SELECT path_id * 10 FROM fx_paths)"


@query(f"{EDITED} SELECT base_id, seg, pos, node_id, x, y FROM placed")
def edited_map(t: Town):
    return edited(t)["way_nodes"]


@query(f"""{EDITED}, u AS (SELECT node_id, count(*) AS n, sum(CASE WHEN pos = lo OR pos = hi THEN 1 ELSE 0 END) AS ends FROM (SELECT *, min(pos) OVER (PARTITION BY feature_id) AS lo, max(pos) OVER (PARTITION BY feature_id) AS hi FROM named WHERE base_id IN (SELECT base_id FROM shown WHERE category = 'footway')) AS f GROUP BY node_id)
SELECT u.node_id, CAST(n AS VARCHAR) AS count, x, y, CAST(1.5 AS DOUBLE) AS radius FROM u JOIN fx_nodes AS p ON u.node_id = p.node_id WHERE n > 2 OR n = 2 AND ends < 2""")
def edited_crossroads(t: Town):
    return edited(t)["crossroads"]


@query(f"""{EDITED}, {DRAWN} SELECT base_id % 2 AS map_id, base_id // 2 AS base_id, seg, pos, node_id, x + 1000 * (base_id % 2) AS x, y FROM placed
UNION ALL SELECT map_id, base_id, NULL, seq, -before - seq - 1, x, y FROM drawn JOIN fx_paths AS p ON p.path_id = drawn.path_id WHERE line""")
def edited_maps(t: Town):
    """Nodes of two edited maps whose way and synthetic ids are the same."""
    return edited_two(t)["way_nodes"]


@query(f"""{EDITED}, {DRAWN}, o AS (SELECT DISTINCT base_id, seg FROM placed) SELECT o.base_id % 2 AS map_id, o.base_id // 2 AS base_id, seg, s.category, CASE WHEN c.way_id IS NULL THEN lw.highway ELSE 'steps' END AS highway, f.barrier, f.surface, NULL AS width
FROM o JOIN shown AS s ON s.base_id = o.base_id JOIN lw ON lw.way_id = o.base_id JOIN fx_ways AS f ON f.way_id = o.base_id LEFT JOIN cur AS c ON c.op = 'tag' AND c.way_id = o.base_id
UNION ALL SELECT map_id, base_id, NULL, CASE WHEN NOT line THEN 'barrier' WHEN highway = 'primary' THEN 'road' ELSE 'footway' END, highway, barrier, NULL, width FROM drawn""")
def edited_features(t: Town):
    """Features and tags of the two edited maps."""
    tag = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    return edited_two(t)["features"].select("map_id", "base_id", "seg", "category", tag("highway"), tag("barrier"), tag("surface"), tag("width"))


def chosen(t: Town):
    return t.paths.select((F.col("path_id") * 10).alias("base_id")).distinct()


@query(f"{EDITED} SELECT p.base_id, s.category FROM (SELECT DISTINCT base_id, seg FROM placed) AS p JOIN shown AS s ON s.base_id = p.base_id WHERE p.base_id IN {CHOSEN}")
def resolve_feature(t: Town):
    return E.resolve_feature(edited(t), chosen(t)).select("base_id", "category")


@query(f"{EDITED} SELECT feature_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS nodes FROM named WHERE base_id IN {CHOSEN} GROUP BY feature_id")
def feature_segments(t: Town):
    return E.feature_segments(edited(t), chosen(t)).select("feature_id", F.array_join("nodes", ",").alias("nodes"))


@query(f"{EDITED} SELECT feature_id, pos, f.node_id, f.x, f.y, n.barrier FROM named AS f JOIN fx_nodes AS n ON n.node_id = f.node_id WHERE base_id IN {CHOSEN}")
def feature_nodes(t: Town):
    out = E.feature_nodes(edited(t), chosen(t), t.tagged_nodes)
    return out.select("feature_id", "pos", "node_id", "x", "y", F.try_element_at("tags", F.lit("barrier")).alias("barrier"))


@query(f"SELECT event_id, {MAP} AS map_id, -row_number() OVER (PARTITION BY {MAP} ORDER BY ts, event_id) AS node_id FROM fx_edit_log WHERE op = 'add_node'")
def synthetic_node_ids(t: Town):
    rows = log(t).filter("op = 'add_node'")
    return E.synthetic_node_ids(rows).select("event_id", "map_id", "node_id")


@query(f"""WITH e AS (SELECT CASE op WHEN 'delete' THEN 'way' WHEN 'hide' THEN 'node' WHEN 'tag' THEN 'tag' WHEN 'move' THEN 'move' ELSE 'split' END AS kind, way_id AS target, {MAP} AS map_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY op, way_id ORDER BY ts DESC, event_id DESC) AS rn FROM fx_edit_log) AS l WHERE rn = 1 AND NOT is_undo),
n AS (SELECT * FROM e WHERE target % 60 <> 0), r AS (SELECT map_id, kind, target, (row_number() OVER (PARTITION BY map_id, kind ORDER BY target) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY map_id, kind) AS r FROM n WHERE kind IN ('way', 'node'))
SELECT map_id, 0 AS section, row_number() OVER (PARTITION BY map_id ORDER BY r, CASE kind WHEN 'way' THEN 0 ELSE 1 END, target) AS place, kind, target FROM r
UNION ALL SELECT map_id, CASE kind WHEN 'tag' THEN 1 WHEN 'move' THEN 2 ELSE 3 END, row_number() OVER (PARTITION BY map_id, kind ORDER BY target), kind, target FROM n WHERE kind NOT IN ('way', 'node')
UNION ALL SELECT map_id, 9, row_number() OVER (PARTITION BY map_id ORDER BY ts, kind, target), kind, target FROM e WHERE target % 60 = 0""")
def change_log_backfill(t: Town):
    kinds = F.create_map(*(F.lit(v) for kv in {"delete": "way", "hide": "node", "tag": "tag", "move": "move", "add_node": "split"}.items() for v in kv))
    edits = E.current_edits(log(t)).select("map_id", F.try_element_at(kinds, F.col("op")).alias("kind"), "target", "ts")
    return E.change_log_backfill(edits.drop("ts"), edits.filter("target % 60 = 0")).drop("ts")


@query("SELECT op, count(*) AS n FROM fx_edit_log GROUP BY op")
def change_counts(t: Town):
    return E.change_counts(log(t))
