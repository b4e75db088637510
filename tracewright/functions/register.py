"""Functions for SQL text: expressions as SQL functions, and table functions for lateral joins, all of them SQL, so that they run in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Equal steps of at most `step` from the first point, which is left out, to the second.
DENSIFY = """densify(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, step DOUBLE) RETURNS TABLE (k INT, x DOUBLE, y DOUBLE) RETURN
SELECT k, x1 + (x2 - x1) * k / n, y1 + (y2 - y1) * k / n
FROM (SELECT CASE WHEN l > 0.001 THEN greatest(1, CAST(ceil(l / step) AS INT)) ELSE 1 END AS n FROM (SELECT sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l)),
LATERAL explode(sequence(1, n)) AS e(k)"""
#: The cells of a straight line between two cells.
GRID_LINE = """grid_line(x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT) RETURNS TABLE (k BIGINT, ix BIGINT, iy BIGINT) RETURN
SELECT k, x0 + sx * CASE WHEN flat THEN k ELSE m END, y0 + sy * CASE WHEN flat THEN m ELSE k END
FROM (SELECT k, flat, sx, sy, CASE WHEN major = 0 THEN 0 ELSE greatest(0, CAST(ceil((2 * k * minor - major) / (2 * major)) AS BIGINT)) END AS m
  FROM (SELECT greatest(abs(x1 - x0), abs(y1 - y0)) AS major, least(abs(x1 - x0), abs(y1 - y0)) AS minor, abs(x1 - x0) > abs(y1 - y0) AS flat,
    CASE WHEN x1 > x0 THEN 1 ELSE -1 END AS sx, CASE WHEN y1 > y0 THEN 1 ELSE -1 END AS sy),
  LATERAL explode(sequence(0L, major)) AS e(k))"""


def register(spark: SparkSession) -> None:
    """Makes densify, grid_line, haversine_m, render_feature_id and seg_len known to spark.sql."""
    make = "CREATE OR REPLACE TEMPORARY FUNCTION "
    spark.sql(make + DENSIFY)
    spark.sql(make + GRID_LINE)
    spark.sql(make + "seg_len(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE RETURN sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))")
    spark.sql(make + "haversine_m(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))")
    spark.sql(make + "render_feature_id(base BIGINT, seg INT) RETURNS STRING RETURN CASE WHEN seg IS NULL THEN CAST(base AS STRING) ELSE concat(base, ':', seg) END")
