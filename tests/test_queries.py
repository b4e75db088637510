"""Every registered query of the map library with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tracewright.plans import catalogue, fixtures

SF = "/root/testdata/sf0.001"
SLOW = {"live_edits", "telemetry_latest_stream"}


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in ("part", "orders", "lineitem", "customer", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_flagship(spark):
    df = catalogue.queries()[catalogue.FLAGSHIP](spark, SF)
    assert df.filter("cost > 0.9 and not blocked").count() == 0 and df.filter("blocked").count() > 0


def test_stream_equals_batch(spark, duck):
    for name in SLOW:
        df = catalogue.queries()[name](spark, SF)
        want = duck.execute(catalogue.oracle_sql()[name])
        assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_town_has_every_order_customer_and_path(spark):
    town = fixtures.Town(spark, SF)
    whole = {
        "way_nodes": ("way_id", "SELECT count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
        "area_ring": ("area_id", "SELECT count(DISTINCT c_custkey) FROM customer"),
        "paths": ("path_id", "SELECT count(DISTINCT o_custkey) FROM orders"),
    }
    for view, (key, text) in whole.items():
        assert getattr(town, view).select(key).distinct().count() == spark.sql(text).first()[0]


def test_points_in_polygons_meet_areas_in_one_box(spark):
    """The join's whole size on the sf0.01 tables, and none of its points or areas is moved away from the others."""
    folder = SF.replace("sf0.001", "sf0.01")
    c = duckdb.connect()
    for t in ("orders", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.execute(catalogue.oracle_sql()["points_in_polygons"]).fetchall()
    got = [tuple(r) for r in catalogue.queries()["points_in_polygons"](spark, folder).select("point_id", "area_id").collect()]
    assert len(want) == 3672 and sorted(got) == sorted(want)
    town = fixtures.Town(spark, SF)
    assert town.piled_ring.select("area_id").distinct().count() == spark.table("customer").count() and town.piled_paths.count() == spark.table("orders").count()
    assert town.piled_paths.filter("y > 5550500 + 392 or x > 458000 + 493").count() == 0 and town.piled_boxes.selectExpr("max(max_y) - min(min_y) as high").first().high > 360
