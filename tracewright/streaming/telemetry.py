"""Latest robot state from telemetry, in batch and as a stream. Messages: robot_id, msg_id, ts, topic, num, lat, lon."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..tables import cut

#: Decimals of each scalar topic, seconds for which a flag stays up.
DECIMALS = {"voltage": 2, "current": 2, "temperature": 1, "speed": 2}
RECOVERY_S, TELEOP_S = 5.0, 2.0
WATERMARK = "10 minutes"


def latest_messages(msgs: DataFrame) -> DataFrame:
    """The last message (by ts, then msg_id) of every robot and topic; null times go."""
    last = msgs.filter("ts is not null").groupBy("robot_id", "topic").agg(F.max(F.struct("ts", "msg_id", "num", "lat", "lon")).alias("m"))
    return last.select("robot_id", "topic", "m.*")


#: Topics whose last message gives a position, a number and (in a column text, where messages have one) a word, and the columns that take them.
POSITIONS = ("gps", "ekf")
NUMBERS = {"speed": "speed", "voltage": "voltage", "current": "current", "temperature": "temperature", "speed_limit": "speed_limit", "motor_error": "error"}
WORDS = {"motors": "motors", "collision_action": "collision_action", "speech": "speech", "navigation": "nav_state", "localization": "localization"}


def telemetry_latest(msgs: DataFrame) -> DataFrame:
    """One row a robot: positions, the last value of each scalar topic, rounded, and the last word of each topic that has words; null where a robot has none."""
    has_text = "text" in msgs.columns
    values = ["num", "lat", "lon", *(["text"] if has_text else [])]
    last = msgs.filter("ts is not null").groupBy("robot_id", "topic").agg(F.max(F.struct("ts", "msg_id", *values)).alias("m")).select("robot_id", "topic", "m.*")

    def of(topic: str, value: str, name: str) -> Column:
        c = F.max(F.when(F.col("topic") == topic, F.col(value)))
        return (F.round(c, DECIMALS[topic]) if topic in DECIMALS else c).alias(name)

    columns = [of(topic, v, f"{topic}_{v}") for topic in POSITIONS for v in ("lat", "lon")] + [of(topic, "num", name) for topic, name in NUMBERS.items()]
    columns += [of(topic, "text", name) for topic, name in WORDS.items()] if has_text else []
    return last.groupBy("robot_id").agg(*columns, F.max("ts").alias("last_ts"))


def telemetry_latest_stream(msgs: DataFrame) -> DataFrame:
    """latest_messages() over a stream in update mode: a row for each robot and topic that a batch has messages of, the held one if they are late. The state is an aggregate's, so no key goes through Python."""
    return latest_messages(msgs)


def emit_on_change(msgs: DataFrame, every_s: int = 10) -> DataFrame:
    """robot_id, tick of the ticks of every_s seconds in which a robot's message arrived: when a snapshot goes out."""
    return msgs.select("robot_id", F.window("ts", f"{every_s} seconds")["end"].alias("tick")).distinct()


def activity_flags(msgs: DataFrame, topic: str = "teleop", within_s: float = TELEOP_S) -> DataFrame:
    """msgs with active: whether the robot's last non-zero message of the topic, up to this one, is under within_s seconds old."""
    seen = F.when((F.col("topic") == topic) & (F.col("num") != 0), F.col("ts"))
    last = F.last(seen, ignorenulls=True).over(W.partitionBy("robot_id").orderBy("ts", "msg_id").rowsBetween(W.unboundedPreceding, 0))
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return msgs.withColumn("active", F.coalesce(age < within_s * 1_000_000, F.lit(False)))


def heading_carry(msgs: DataFrame, topic: str = "speed") -> DataFrame:
    """gps messages with the latest value of the heading topic before them."""
    seen = F.when(F.col("topic") == topic, F.col("num"))
    last = F.last(seen, ignorenulls=True).over(W.partitionBy("robot_id").orderBy("ts", "msg_id").rowsBetween(W.unboundedPreceding, 0))
    return msgs.withColumn("heading", last).filter("topic = 'gps'").select("robot_id", "msg_id", "ts", "lat", "lon", "heading")


def nav_state(entries: Column) -> Column:
    """The name of the last RUNNING entry of an array of (name, status), else null."""
    return F.try_element_at(F.filter(entries, lambda e: e["status"] == "RUNNING"), F.lit(-1))["name"]


def last_running(log: DataFrame, by: str = "robot_id") -> DataFrame:
    """by, nav: the name of the last RUNNING entry of each log (by, msg_id, name, status), null if none ran; the log is aggregated, not gathered."""
    return log.groupBy(by).agg(F.max_by(F.when(F.col("status") == "RUNNING", F.col("name")), F.when(F.col("status") == "RUNNING", F.col("msg_id"))).alias("nav"))


def mission_progress(kind: Column, total: Column, remaining: Column, index: Column) -> Column:
    """total - remaining, or the index that the message gives."""
    return F.when(kind == "remaining", total - remaining).otherwise(index)


def telemetry_rates(msgs: DataFrame) -> DataFrame:
    """robot_id, start, n: messages per minute; late ones count up to the watermark."""
    if msgs.isStreaming:  # event time needs a zone
        msgs = msgs.withColumn("ts", F.col("ts").cast("timestamp"))
    return msgs.withWatermark("ts", WATERMARK).groupBy("robot_id", F.window("ts", "1 minute")).agg(F.count("*").alias("n")).select("robot_id", F.col("window.start").alias("start"), "n")


def dropped_late(query) -> int:
    """Rows that a started query's stateful operators have dropped as later than the watermark, over its batches so far."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in (p["stateOperators"] if isinstance(p, dict) else [o.jsonValue for o in p.stateOperators]))


FLAGS = "robot_id long, ts timestamp, active boolean"


def flag_timers(topic: str, within_s: float) -> StatefulProcessor:
    """The processor of activity_stream(). Its class is made here, so that it travels whole to the workers."""

    class FlagTimers(StatefulProcessor):
        """Keeps a robot's last time of the topic with a number other than 0, and a timer for when the flag falls."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "ms long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            held = self.seen.get()
            until = None if held is None else held[0] + int(within_s * 1000)
            out, times = [], []
            for part in rows:
                part = part[(part["topic"] == topic) & part["num"].notna() & (part["num"] != 0) & part["ts"].notna()]
                times += [int(t.value // 1_000_000) for t in part["ts"]]
            if held is not None:
                self.handle.deleteTimer(until)
            for ts in sorted(times):
                if until is not None and ts + int(within_s * 1000) <= until:
                    continue  # not the last one
                if until is None or ts >= until:
                    if until is not None:
                        out.append((until, False))
                    out.append((ts, True))
                until = ts + int(within_s * 1000)
            if until is not None:
                self.handle.registerTimer(until)
            if until is not None and (held is None or until != held[0] + int(within_s * 1000)):
                self.seen.update((until - int(within_s * 1000),))
            if out:
                yield self.rows(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            held = self.seen.get()
            if held is not None and held[0] + int(within_s * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
                self.seen.clear()  # a robot that is silent keeps no state
                yield self.rows(key, [(expiredTimerInfo.getExpiryTimeInMs(), False)])

        @staticmethod
        def rows(key, out: list[tuple[int, bool]]) -> pd.DataFrame:
            return pd.DataFrame({"robot_id": [key[0]] * len(out), "ts": pd.to_datetime([ms for ms, _ in out], unit="ms"), "active": [up for _, up in out]})

        def close(self) -> None:
            pass

    return FlagTimers()


def activity_stream(msgs: DataFrame, topic: str = "teleop", within_s: float = TELEOP_S, late: str = WATERMARK) -> DataFrame:
    """robot_id, ts, active of a stream of messages: a row when a robot's flag goes up, and one when it falls.

    The flag goes up with a non-zero message of the topic and falls within_s seconds after the last one, by an event-time timer, so
    without a message: as soon as the watermark (`late` behind the newest message of any robot) has passed it. Messages later than
    the watermark are dropped, and one older than the flag's last changes nothing. A robot whose flag is down keeps no state. Needs the RocksDB state store.
    """
    stamped = msgs.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy("robot_id").transformWithStateInPandas(flag_timers(topic, within_s), FLAGS, "Append", "EventTime")


def live_edits(log: DataFrame, store: str, checkpoint: str, until_end: bool = True, parts: int = 64):
    """Starts a query that keeps the current edits of a stream of log rows as a table at `store`. until_end: stop when the input that is there has been read.

    The table lies in `parts` folders by a hash of the edit's key (choose as many as keep a folder's rows to a task). A batch reads and
    writes only the folders that its keys lie in, which take the place of the old ones; batch is the number of the batch that changed a
    row last. A batch that comes again leaves the table as it is: the same rows win.
    """
    key = ("map_id", "op", "target")

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cut(batch.withColumns({"batch": F.lit(number).cast("long"), "part": F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")}), "batch")
        touched = [r.part for r in new.select("part").distinct().toLocalIterator()]  # `parts` at most
        if not touched:
            return
        both = new
        if number:
            both = new.unionByName(read_live_edits(spark, store, log.schema).filter(F.col("part").isin(touched)))
        last = W.partitionBy("part", *key).orderBy(F.col("ts").desc(), F.col("event_id").desc(), F.col("batch"))
        kept = cut(both.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn"), "kept")  # read before its folders go
        kept.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(store)

    query = log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if until_end else query).start()


def read_live_edits(spark: SparkSession, store: str, schema) -> DataFrame:
    """The table of live_edits(): the log's columns, batch and part."""
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    try:
        return spark.read.schema(f"{whole}, batch long, part int").parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{whole}, batch long, part int")
