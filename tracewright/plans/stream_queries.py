"""Telemetry, in batch and through streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import telemetry as S
from ..tables import cut, new_path
from .fixtures import Town, query

LAST = "SELECT robot_id, topic, arg_max(num, (ts, msg_id)) AS num, arg_max(lat, (ts, msg_id)) AS lat, arg_max(lon, (ts, msg_id)) AS lon FROM fx_telemetry GROUP BY robot_id, topic"


@query(f"SELECT robot_id, max(lat) FILTER (topic = 'gps') AS gps_lat, max(lon) FILTER (topic = 'gps') AS gps_lon, round(max(num) FILTER (topic = 'speed'), 2) AS speed, round(max(num) FILTER (topic = 'voltage'), 2) AS voltage, max(num) FILTER (topic = 'motor_error') AS error FROM ({LAST}) AS l GROUP BY robot_id")
def telemetry_latest(t: Town):
    return S.telemetry_latest(t.telemetry).select("robot_id", "gps_lat", "gps_lon", "speed", "voltage", "error")


def as_stream(t: Town, df, name: str, files: int = 4):
    """df, written to the shared folder, as a stream of its files, so many a batch."""
    written = cut(df, name)
    return t.spark.readStream.schema(written.schema).option("maxFilesPerTrigger", files).parquet(written.inputFiles()[0].rpartition("/")[0])


def drained(t: Town, out, name: str, mode: str):
    """The rows that a stream puts out until its input ends, as a table in the shared folder."""
    sink, log = new_path(t.spark, name), new_path(t.spark, name + "-log")

    def put(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).parquet(sink).select(*out.columns)


@query(f"SELECT robot_id, topic, round(num, 6) AS num, lat, lon FROM ({LAST}) AS l")
def telemetry_latest_stream(t: Town):
    """The stateful processor's last word on every robot and topic."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = drained(t, S.telemetry_latest_stream(as_stream(t, t.telemetry, "messages")), "latest", "update")
    return S.latest_messages(out).select("robot_id", "topic", F.round("num", 6).alias("num"), "lat", "lon")


@query("SELECT robot_id, date_trunc('minute', ts) AS start, count(*) AS n FROM fx_telemetry GROUP BY ALL")
def telemetry_rates(t: Town):
    return S.telemetry_rates(t.telemetry)


@query("SELECT DISTINCT robot_id, to_timestamp(floor(epoch(ts) / 10) * 10 + 10)::TIMESTAMP AS tick FROM fx_telemetry")
def emit_on_change(t: Town):
    return S.emit_on_change(t.telemetry)


@query("""WITH l AS (SELECT robot_id, msg_id, ts, last_value(CASE WHEN topic = 'teleop' AND num <> 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY robot_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS seen FROM fx_telemetry)
SELECT msg_id, coalesce(epoch_us(ts) - epoch_us(seen) < 3600000000, false) AS active FROM l""")
def activity_flags(t: Town):
    return S.activity_flags(t.telemetry, "teleop", 3600.0).select("msg_id", "active")


@query("""WITH l AS (SELECT msg_id, topic, last_value(CASE WHEN topic = 'speed' THEN num END IGNORE NULLS) OVER (PARTITION BY robot_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS heading FROM fx_telemetry)
SELECT msg_id, heading FROM l WHERE topic = 'gps'""")
def heading_carry(t: Town):
    return S.heading_carry(t.telemetry).select("msg_id", "heading")


@query("""WITH e AS (SELECT robot_id, max_by(topic, msg_id) FILTER (msg_id % 3 = 0) AS nav FROM fx_telemetry GROUP BY robot_id) SELECT robot_id, nav FROM e""")
def nav_state(t: Town):
    """A robot's topics as a navigation log, every third of which was running."""
    status = F.when(F.col("msg_id") % 3 == 0, "RUNNING").otherwise("DONE")
    return S.last_running(t.telemetry.select("robot_id", "msg_id", F.col("topic").alias("name"), status.alias("status")))


@query("SELECT msg_id, CASE WHEN topic = 'gps' THEN 1000 - msg_id % 1000 ELSE msg_id % 7 END AS progress FROM fx_telemetry")
def mission_progress(t: Town):
    kind = F.when(F.col("topic") == "gps", "remaining").otherwise("index")
    return t.telemetry.select("msg_id", S.mission_progress(kind, F.lit(1000), F.col("msg_id") % 1000, F.col("msg_id") % 7).alias("progress"))


@query("SELECT op, way_id AS target, arg_max(event_id, (ts, event_id)) AS event_id FROM fx_edit_log GROUP BY op, way_id")
def live_edits(t: Town):
    """The store that a stream of edits leaves."""
    from .edit_queries import log

    store, marks = new_path(t.spark, "store"), new_path(t.spark, "store-log")
    rows = as_stream(t, log(t), "edits")
    S.live_edits(rows, store, marks).awaitTermination()
    return S.read_live_edits(t.spark, store, rows.schema).select("op", "target", "event_id")


#: The flag goes up with the first message of its topic in an hour and falls an hour after the last.
UPS = "SELECT robot_id, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM (SELECT DISTINCT robot_id, date_trunc('millisecond', ts) AS ts FROM fx_telemetry WHERE topic = 'teleop' AND num <> 0) AS u WINDOW w AS (PARTITION BY robot_id ORDER BY ts)"


@query(f"SELECT robot_id, ts, true AS active FROM ({UPS}) AS u WHERE before IS NULL OR ts >= before + INTERVAL 1 HOUR UNION ALL SELECT robot_id, ts + INTERVAL 1 HOUR, false FROM ({UPS}) AS u WHERE after >= ts + INTERVAL 1 HOUR OR after IS NULL AND ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM fx_telemetry)")
def activity_stream(t: Town):
    """The messages as one batch of a stream: flags that fall by timers at its end are those that the watermark has passed."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return drained(t, S.activity_stream(as_stream(t, t.telemetry, "messages", 1 << 30), "teleop", 3600.0), "flags", "append")


@query("SELECT robot_id, date_trunc('minute', ts) AS start, count(*) AS n FROM fx_telemetry GROUP BY ALL HAVING date_trunc('minute', min(ts)) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM fx_telemetry)")
def telemetry_rates_stream(t: Town):
    """Minutes that the watermark has closed, as a stream puts them out once each."""
    return drained(t, S.telemetry_rates(as_stream(t, t.telemetry, "messages", 1 << 30)), "rates", "append")
