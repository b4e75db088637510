"""Flags that fall by timers, rates that lose late rows by rule, and edits kept in folders, over streams of several batches."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest

from tracewright.streaming import telemetry as S

START = datetime(2024, 1, 1)
SCHEMA = "robot_id long, msg_id long, ts timestamp, topic string, num double"


def at(s):
    return START + timedelta(seconds=s)


class Feed:
    """A folder that a stream reads one file a batch, and what came out."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.folder, self.schema, self.n = spark, tmp_path / "in", schema, 0
        self.folder.mkdir()
        self.marks, self.sink = str(tmp_path / "marks"), str(tmp_path / "out")

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/{self.n:03}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/*")

    def run(self, out, mode="append"):
        """Reads what is there, and returns all rows that came out so far."""

        def put(batch, number):
            batch.write.mode("overwrite").parquet(f"{self.sink}/batch={number}")

        query = out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", self.marks).trigger(availableNow=True).start()
        query.awaitTermination()
        return query, self.spark.read.schema(out.schema).parquet(self.sink).select(*out.columns)


def test_flags_fall_without_a_message(spark, tmp_path):
    feed = Feed(spark, tmp_path, SCHEMA)
    message = lambda robot, s, topic="teleop", num=1.0: (robot, s, at(s), topic, num)
    flags = lambda: {(r.robot_id, (r.ts - START).total_seconds(), r.active) for r in feed.run(S.activity_stream(feed.stream(), "teleop", 2.0, "10 seconds"))[1].collect()}
    feed.put([message(1, 0), message(1, 1), message(2, 1, num=0.0), message(2, 2, topic="speed"), message(3, 1)])
    assert flags() == {(1, 0.0, True), (3, 1.0, True)}
    feed.put([message(2, 30, topic="speed")])  # the watermark passes 3 s: robot 1's flag and robot 3's fall
    up = {(1, 0.0, True), (3, 1.0, True), (1, 3.0, False), (3, 3.0, False)}
    assert flags() == up
    feed.put([message(1, 5), message(1, 25), message(1, 28)])  # 5 s is later than the watermark and dropped
    assert flags() == up | {(1, 25.0, True), (1, 27.0, False), (1, 28.0, True)}
    feed.put([message(1, 29), message(2, 60, topic="speed")])  # goes on from 28 s, and falls by a timer
    assert flags() == up | {(1, 25.0, True), (1, 27.0, False), (1, 28.0, True), (1, 31.0, False)}


def test_rates_lose_late_rows_by_rule(spark, tmp_path):
    feed = Feed(spark, tmp_path, SCHEMA)
    message = lambda s: (1, s, at(s), "gps", 0.0)
    feed.put([message(0), message(30), message(1000)])  # the watermark comes to 400 s
    feed.put([message(1010)])  # a batch later that is what late rows are told by
    feed.put([message(200), message(999), message(2000)])  # 200 s is late: its minute is closed
    query, rates = feed.run(S.telemetry_rates(feed.stream()))
    assert {((r.start - START).total_seconds(), r.n) for r in rates.collect()} == {(0.0, 2), (960.0, 3)}
    assert S.dropped_late(query) == 1


LOG = "map_id long, event_id long, ts timestamp, op string, target long, is_undo boolean"


def test_live_edits_write_what_a_batch_touches(spark, tmp_path):
    feed, store = Feed(spark, tmp_path, LOG), str(tmp_path / "store")
    row = lambda event, target, s: (1, event, at(s), "move", target, False)
    state = lambda: {(r.target, r.event_id) for r in S.read_live_edits(spark, store, feed.stream().schema).collect()}
    go = lambda marks=feed.marks: S.live_edits(feed.stream(), store, marks, parts=32).awaitTermination()
    assert state() == set()
    feed.put([row(i, i, 0) for i in range(400)])
    go()
    assert state() == {(i, i) for i in range(400)}
    before = {p: p.stat().st_mtime_ns for p in Path(store).glob("part=*/*.parquet")}
    assert len(before) == 32
    feed.put([row(1000, 7, 5), row(1001, 8, -5)])  # a newer edit and an older one
    go()
    assert state() == {(i, 1000 if i == 7 else i) for i in range(400)}
    after = {p: p.stat().st_mtime_ns for p in Path(store).glob("part=*/*.parquet")}
    assert len(after) == 32 and len(set(after.items()) - set(before.items())) <= 2  # the folders of two keys
    went_on = S.read_live_edits(spark, store, feed.stream().schema).select("target", "event_id", "batch").collect()
    go(str(tmp_path / "again"))  # all batches once more, from the first
    assert {tuple(r) for r in went_on} >= {(7, 1000, 1)} and state() == {(i, 1000 if i == 7 else i) for i in range(400)}


def test_table_functions_run_in_the_jvm(spark):
    from tracewright.functions.register import register

    register(spark)
    spark.createDataFrame([(1, 0, 0, 5, -3), (2, 4, 4, 4, 4)], "i int, x0 long, y0 long, x1 long, y1 long").createOrReplaceTempView("some_lines")
    cells = spark.sql("SELECT i, d.* FROM some_lines, LATERAL grid_line(x0, y0, x1, y1) AS d")
    steps = spark.sql("SELECT i, d.* FROM some_lines, LATERAL densify(x0, y0, x1, y1, 2.0D) AS d")
    for df in (cells, steps):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "UDTF" not in df._jdf.queryExecution().executedPlan().toString()
    from test_operators import plain_line

    assert [(r.ix, r.iy) for r in cells.filter("i = 1").orderBy("k").collect()] == plain_line(0, 0, 5, -3)
    assert [(r.k, r.x, r.y) for r in steps.filter("i = 1").orderBy("k").collect()] == [(k, pytest.approx(5 * k / 3), pytest.approx(-k)) for k in (1, 2, 3)] and steps.filter("i = 2").count() == 1
