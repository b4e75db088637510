"""Map tables derived from the star-schema tables, by SQL that Spark and DuckDB both run; and the registry of queries.

The town grows with its tables: nodes, areas and the boxes of paths reach farther north with their keys, and are not denser.
The piled views hold the same areas and points of paths within the first box, so that each point meets more areas the larger the tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "fx_nodes": """
SELECT CAST(p_partkey AS BIGINT) AS node_id,
       CAST(458000 + 10 * (p_partkey % 50) AS DOUBLE) AS x,
       CAST(5550500 + 10 * ((p_partkey - p_partkey % 50) / 50) AS DOUBLE) AS y,
       CASE p_type WHEN 'SMALL' THEN 'block' WHEN 'PROMO' THEN 'entrance' WHEN 'LARGE' THEN 'bollard' END AS barrier
FROM part""",
    "fx_way_nodes": """
SELECT way_id, CAST(pos AS INT) AS pos,
       CAST((way_id * 13 + pos * CASE WHEN way_id % 20 = 0 THEN 1 ELSE 50 END) % (SELECT count(*) FROM part) AS BIGINT) AS node_id,
       CASE pr WHEN '1-URGENT' THEN 'primary' WHEN '2-HIGH' THEN 'residential' WHEN '3-MEDIUM' THEN 'footway' WHEN '4-NOT SPECIFIED' THEN 'path' END AS highway,
       CASE WHEN pr = '5-LOW' THEN 'wall' END AS barrier,
       CASE st WHEN 'F' THEN 'asphalt' WHEN 'O' THEN 'gravel' END AS surface
FROM (SELECT o_orderkey AS way_id, o_orderpriority AS pr, o_orderstatus AS st, row_number() OVER (PARTITION BY o_orderkey ORDER BY ln) - 1 AS pos
      FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber AS ln FROM lineitem) AS l ON o_orderkey = l_orderkey) AS n""",
    "fx_area_ring": """
SELECT c_custkey AS area_id, 0 AS ring, pos,
       CAST(458003 + 10 * (c_custkey % 50) + dx * (1 + c_nationkey % 4) AS DOUBLE) AS x,
       CAST(5550503 + 10 * ((c_custkey - c_custkey % 50) / 50) + dy * (1 + c_nationkey % 4) AS DOUBLE) AS y
FROM customer CROSS JOIN (VALUES (0,-1,-1),(1,1,-1),(2,1,1),(3,-1,1),(4,-1,-1)) AS v(pos, dx, dy)""",
    "fx_paths": """
SELECT o_custkey AS path_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS seq,
       CAST(458000 + (o_orderkey * 17) % 490 AS DOUBLE) + CAST(o_orderkey % 7 AS DOUBLE) / 2 AS x,
       CAST(5550500 + 390 * ((o_custkey - o_custkey % 1500) / 1500) + (o_orderkey * 29) % 390 AS DOUBLE) + CAST(o_orderkey % 5 AS DOUBLE) / 2 AS y
FROM orders""",
    "fx_piled_ring": """
SELECT c_custkey AS area_id, 0 AS ring, pos,
       CAST(458003 + 10 * (c_custkey % 50) + dx * (1 + c_nationkey % 4) AS DOUBLE) AS x,
       CAST(5550503 + 10 * (c_custkey % 37) + dy * (1 + c_nationkey % 4) AS DOUBLE) AS y
FROM customer CROSS JOIN (VALUES (0,-1,-1),(1,1,-1),(2,1,1),(3,-1,1),(4,-1,-1)) AS v(pos, dx, dy)""",
    "fx_piled_paths": """
SELECT o_custkey AS path_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS seq,
       CAST(458000 + (o_orderkey * 17) % 490 AS DOUBLE) + CAST(o_orderkey % 7 AS DOUBLE) / 2 AS x,
       CAST(5550500 + (o_orderkey * 29) % 390 AS DOUBLE) + CAST(o_orderkey % 5 AS DOUBLE) / 2 AS y
FROM orders""",
    "fx_edit_log": """
SELECT event_id, ts, (event_id * 30) % (SELECT count(*) FROM orders) AS way_id,
       CASE event_type WHEN 'click' THEN 'move' WHEN 'view' THEN 'hide' WHEN 'signup' THEN 'add_node' WHEN 'purchase' THEN 'tag' ELSE 'delete' END AS op,
       event_id % 7 = 0 AS is_undo, value AS num
FROM events""",
    "fx_telemetry": """
SELECT user_id AS robot_id, event_id AS msg_id, ts,
       CASE event_type WHEN 'click' THEN 'speed' WHEN 'view' THEN 'gps' WHEN 'signup' THEN 'teleop' WHEN 'purchase' THEN 'voltage' ELSE 'motor_error' END AS topic,
       value AS num,
       CAST(50 AS DOUBLE) + CAST(event_id % 1000 AS DOUBLE) / 100000 AS lat,
       CAST(14 AS DOUBLE) + CAST(event_id % 777 AS DOUBLE) / 100000 AS lon
FROM events""",
    "fx_ways": "SELECT way_id, min(highway) AS highway, min(barrier) AS barrier, min(surface) AS surface, count(*) AS n FROM fx_way_nodes GROUP BY way_id",
    "fx_class": "SELECT *, CASE WHEN highway IN ('footway', 'path') THEN 'footway' WHEN highway IS NOT NULL THEN 'road' ELSE 'barrier' END AS category FROM fx_ways",
    "fx_foot": "SELECT way_id, pos, node_id FROM fx_way_nodes WHERE highway IN ('footway', 'path')",
    "fx_placed": "SELECT w.way_id, w.pos, w.node_id, n.x, n.y FROM fx_way_nodes AS w JOIN fx_nodes AS n ON w.node_id = n.node_id",
    "fx_segments": """
SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM (
  SELECT way_id, CAST(pos AS INT) AS seg, node_id AS src, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS dst, x AS x1, y AS y1,
         lead(x) OVER (PARTITION BY way_id ORDER BY pos) AS x2, lead(y) OVER (PARTITION BY way_id ORDER BY pos) AS y2
  FROM fx_placed) AS s WHERE dst IS NOT NULL""",
    "fx_legs": """
SELECT * FROM (SELECT path_id, seq AS leg, x AS x1, y AS y1, lead(x) OVER (PARTITION BY path_id ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY path_id ORDER BY seq) AS y2 FROM fx_paths) AS l WHERE x2 IS NOT NULL""",
    "fx_crossroads": """
SELECT u.node_id, CAST(u.n AS VARCHAR(20)) AS count, x, y FROM (
  SELECT node_id, count(*) AS n, sum(CASE WHEN pos = lo OR pos = hi THEN 1 ELSE 0 END) AS ends FROM (
    SELECT *, min(pos) OVER (PARTITION BY way_id) AS lo, max(pos) OVER (PARTITION BY way_id) AS hi FROM fx_foot) AS f GROUP BY node_id) AS u
JOIN fx_nodes AS p ON u.node_id = p.node_id WHERE u.n > 2 OR u.n = 2 AND u.ends < 2""",
    "fx_ring_edges": """
SELECT * FROM (SELECT area_id, ring, pos, x AS x1, y AS y1, lead(x) OVER (PARTITION BY area_id, ring ORDER BY pos) AS x2, lead(y) OVER (PARTITION BY area_id, ring ORDER BY pos) AS y2 FROM fx_area_ring) AS e WHERE x2 IS NOT NULL""",
    "fx_boxes": "SELECT area_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM fx_area_ring GROUP BY area_id",
    "fx_piled_boxes": "SELECT area_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM fx_piled_ring GROUP BY area_id",
}
TABLES = ("part", "orders", "lineitem", "customer", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def needed(text: str) -> list[str]:
    """The views that a query's text names, each after those that it needs itself."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            out += [n for n in [*needed(VIEWS[name]), name] if n not in out]
    return out


def with_views(text: str) -> str:
    """The query with its views as common table expressions before its own."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed(text))
    text = text.strip()
    if not views:
        return text
    if m := re.match(r"WITH (RECURSIVE )?", text):
        return f"WITH {m[1] or ''}{views}, {text[m.end():]}"
    return f"WITH {views} {text}"


class Town:
    """The fixture town of a folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)

    def __getattr__(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM fx_{name}")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(with_views(text))

    @property
    def features(self) -> DataFrame:
        """base_id, tags of the ways."""
        keys = ("highway", "barrier", "surface")
        tags = F.map_filter(F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k)))), lambda _, v: v.isNotNull())
        return self.ways.select(F.col("way_id").alias("base_id"), tags.alias("tags"))

    @property
    def tagged_nodes(self) -> DataFrame:
        tags = F.map_filter(F.create_map(F.lit("barrier"), F.col("barrier")), lambda _, v: v.isNotNull())
        return self.nodes.select("node_id", "x", "y", tags.alias("tags"))

    def rules(self, *pairs: tuple[str, str]) -> DataFrame:
        return self.spark.createDataFrame(list(pairs), "key string, value string")


def query(sql: str | None = None):
    """Registers a function of a Town under its name, with its SQL over tables and views."""

    def add(f: Callable[[Town], DataFrame]):
        name = f.__name__.rstrip("_")
        QUERIES[name] = lambda spark, sf_dir: f(Town(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add
