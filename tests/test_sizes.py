"""What Spark sizes too low isn't broadcast: tables after an explode, and compressed ones. What one row makes many of is dealt out first."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright import components
from tracewright.llm import pivots, similar, simhash
from tracewright.operators import joins as J
from tracewright.operators import raster as R
from tracewright.plans import catalogue, file_queries, fixtures
from tracewright.sources import files
from tracewright.streaming import telemetry as S

SF = "/root/testdata/sf0.001"


def broadcast_explodes(df) -> int:
    """Broadcast exchanges of df's final plan with an explode (or a Python function) below them."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    lines, found = df._jdf.queryExecution().executedPlan().toString().splitlines(), 0
    depth = lambda x: len(re.match(r"[\s:+\-|]*", x)[0])
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for x in lines[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            found += any(re.search(r"Generate|InArrow|InPandas", x) for x in below)
    return found


@pytest.mark.parametrize("name", ["burn_obstacles", "leg_collisions", "near_way_cloud", "nearest_way_cost", "nearest_within", "points_in_polygons", "obstacles_minus_paths", "cost_grid"])
def test_explodes_are_not_broadcast(spark, name):
    assert broadcast_explodes(catalogue.queries()[name](spark, SF)) == 0


def test_cells_are_made_by_many_tasks(spark):
    boxes = spark.createDataFrame([(i, 10.0 * i, 0.0, 10.0 * i + 8, 8.0) for i in range(40)], "area_id long, min_x double, min_y double, max_x double, max_y double").coalesce(1)
    made = R.make_cells(boxes, 0.5).groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 1 and sum(r["count"] for r in made) == 40 * 256


def test_burnt_cells_of_overlapping_areas_and_odd_positions(spark):
    square = lambda area, ring, x, y, r: [(area, ring, k, x + r * a, y + r * b) for k, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)))]
    rings = square(1, 0, 60.0, 5.0, 10.0) + square(1, 1, 60.0, 5.0, 4.0) + square(2, 0, 72.0, 5.0, 3.0) + square(3, 0, 58.0, 5.0, 1.0) + square(4, 0, 130.0, 5.0, 80.0)[:0]
    rings = spark.createDataFrame(rings, "area_id long, ring int, pos int, x double, y double")
    at = [(k, x / 2, y / 2) for k, (x, y) in enumerate((x, y) for x in range(80, 180) for y in range(-15, 36))]
    at += [(-1, float("nan"), 5.0), (-2, float("inf"), 5.0), (-3, 60.0, float("nan")), (-4, None, 5.0)]
    cells = spark.createDataFrame(at, "point_id long, x double, y double")
    held = lambda x, y, cx, cy, r: cx - r <= x < cx + r and cy - r <= y < cy + r
    want = {k: k >= 0 and (held(x, y, 60, 5, 10) and not held(x, y, 60, 5, 4) or held(x, y, 72, 5, 3) or held(x, y, 58, 5, 1)) for k, x, y in at}
    got = R.burn_obstacles(cells, rings).collect()
    assert len(got) == len(at) and {r.point_id: r.blocked for r in got} == want


def test_variants_are_not_broadcast(spark):
    prints = spark.createDataFrame([(i, i * 977 % 512) for i in range(300)], "doc_id long, fp long")
    assert broadcast_explodes(simhash.near_pairs(prints.select("fp").distinct())) == 0
    nodes = spark.createDataFrame([(i, i * 977 % 512, i * 31 % 64) for i in range(200)], "node long, f0 long, f1 long")
    keyed = similar.variants(nodes.withColumnRenamed("node", "cluster"))
    assert keyed.count() == 128 * 200
    plans = []
    kept, similar.cut = similar.cut, lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, name)
    try:
        similar.clusters(nodes).count()
    finally:
        similar.cut = kept
    assert plans and all("strategy=merge" in p for p in plans)


def test_tables_of_vectors_and_labels_are_not_broadcast(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)], "a long, b long")
    plans = []
    kept, components.cut = components.cut, lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or kept(df, name)
    try:
        assert components.components(links).count() == 40
    finally:
        components.cut = kept
    assert all("BroadcastHashJoin" not in p for _, p in plans)
    vectors = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    out = pivots.near_vectors(vectors, 0.95)
    out.collect()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_geojson_files_grow_in_number_and_not_with_areas(spark):
    town = fixtures.Town(spark, SF)
    folder = file_queries.geojson_folder(town)
    read = spark.read.text(folder, wholetext=True)
    areas = town.area_ring.select("area_id").distinct().count()
    assert read.count() == -(-areas // 1000) and files.read_geojson(spark, f"{folder}/*/*", 33).count() == areas


def test_projection_in_steps_is_the_same(spark):
    from tracewright.functions import projection as P

    rows = spark.createDataFrame([([(458000.0 + 10 * i, 5550500.0 + 7 * i) for i in range(9)],)], "p array<struct<x:double,y:double>>")
    lat, lon = P.to_latlon(F.col("q.x"), F.col("q.y"), F.lit(33))
    want = rows.select(F.explode("p").alias("q")).select(lat.alias("lat"), lon.alias("lon")).collect()
    assert rows.select(P.latlon_points(F.col("p"), F.lit(33)).alias("p")).first().p == want
    x, y = P.to_utm(F.col("lat"), F.col("lon"), F.lit(33))
    back = spark.createDataFrame([([tuple(r) for r in want],)], "p array<struct<lat:double,lon:double>>")
    planar = back.select(P.utm_points(F.col("p"), F.lit(33), lambda p: p["lat"], lambda p: p["lon"]).alias("p")).first().p
    assert planar == spark.createDataFrame(want).select(x.alias("x"), y.alias("y")).collect()
    # a lambda's values are worked out once: the text of the expression stays short
    assert len(str(P.latlon_points(F.col("p"), F.lit(33)))) < len(str(F.transform("p", lambda p: F.struct(*P.to_latlon(p["x"], p["y"], F.lit(33)))))) / 3


def test_latest_messages_of_a_stream_need_no_python(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "robot_id long, msg_id long, ts timestamp, topic string, num double, lat double, lon double"
    batches = [[(1, 1, 5, "gps", 1.0), (1, 2, 5, "gps", 2.0), (2, 3, 9, "gps", 3.0), (2, 4, None, "speed", 4.0)], [(1, 5, 4, "gps", 5.0), (2, 6, 10, "gps", None), (1, 7, 1, "speed", 7.0)]]
    for k, rows in enumerate(batches):
        rows = [(a, b, None if s is None else start + timedelta(seconds=s), t, n, 1.0, 2.0) for a, b, s, t, n in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out, plans = S.telemetry_latest_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")), []

    def put(batch, number):
        plans.append(batch._jdf.queryExecution().optimizedPlan().toString())
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
    got = S.latest_messages(spark.read.schema(out.schema).parquet(f"{tmp_path}/out").select(*out.columns)).collect()
    assert {(r.robot_id, r.topic): (r.msg_id, r.num) for r in got} == {(1, "gps"): (2, 2.0), (2, "gps"): (6, None), (1, "speed"): (7, 7.0)}
    assert "InPandas" not in "".join(plans)


def test_legs_on_one_line_meet_as_in_sql(spark, tmp_path):
    """Places of orders come again every 19,110 keys, so legs of a larger table may lie on each other."""
    import os

    import duckdb

    for t in fixtures.TABLES:
        os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet") if t != "orders" else None
    keys = [3, 10, 3 + 19_110, 10 + 19_110, 19_200]
    duckdb.execute(f"COPY (SELECT unnest({keys})::BIGINT AS o_orderkey, 0::BIGINT AS o_custkey, 'F' AS o_orderstatus, '5-LOW' AS o_orderpriority) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = c.execute(catalogue.oracle_sql()["segments_intersect"]).fetchall()
    got = [tuple(r) for r in catalogue.queries()["segments_intersect"](spark, str(tmp_path)).select("path_id", "one", "two", "meet").collect()]
    assert sorted(got) == sorted(want) and (0, 0, 2, False) in want
