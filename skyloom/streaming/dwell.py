"""Streams: dwell detection by keyed state, freshness by watermark, slot completeness by windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Columns a camera stream has, and those the dwell stream adds.
TRACK = "session long, ts timestamp, id long, yaw double, pitch double"
OUT = "session long, ts timestamp, id long, still_for double, pull boolean"
STATE = "at double, yaw double, pitch double, since double"


def dwell_stream(track: DataFrame, slow: float = 0.7, seconds: float = 0.2, lateness: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """The batch dwell operator on a stream: how long each session's camera has been still, and whether to pull.

    A batch's states are taken in event-time order; states older than the last one seen are late and left out. A
    session that the watermark passes by `idle` is forgotten.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        last = state.get if state.exists else None
        out = []
        for r in rows.itertuples():
            now = r.ts.timestamp()
            if last is None:
                last = (now, r.yaw, r.pitch, now)
            elif now < last[0]:
                continue
            else:
                at, yaw, pitch, since = last
                if now > at:
                    turn = r.yaw - yaw
                    turn = turn - 360 if turn > 180 else turn + 360 if turn < -180 else turn
                    speed = ((turn / (now - at)) ** 2 + ((r.pitch - pitch) / (now - at)) ** 2) ** 0.5
                    since = now if speed > slow else since
                last = (now, r.yaw, r.pitch, since)
            out.append((key[0], r.ts, r.id, round(now - last[3], 6), now - last[3] > seconds))
        if last is not None:
            state.update(last)
            state.setTimeoutTimestamp(max(int(last[0] * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "ts", "id", "still_for", "pull"])

    keyed = track.withWatermark("ts", lateness).groupBy("session")
    return keyed.applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def fresh_stream(files: DataFrame, key: str = "name", time: str = "last_modified", within: str = "1 day") -> DataFrame:
    """Each file name once within a day."""
    return files.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def complete_stream(parts: DataFrame, number: int, time: str = "ts", slot: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(slot, n, parts): slots in which `number` different parts came, once the watermark has passed them; n counts files,
    a part that comes again included. A slot's state is as large as its parts are many."""
    w = parts.withWatermark(time, lateness).groupBy(F.window(time, slot).alias("w")).agg(F.count("*").alias("n"), F.size(F.collect_set("part")).cast("long").alias("parts"))
    return w.where(F.col("parts") >= number).select(F.col("w.start").alias("slot"), "n", "parts")


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Camera states from a folder of events files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = spark.readStream.schema(schema).parquet(folder)
    return e.selectExpr("user_id session", "cast(ts as timestamp) ts", "event_id id", "round(value * 7 - 360 * floor(value * 7 / 360), 6) yaw", "round(value - 178 * floor(value / 178) - 89, 6) pitch")


def drained(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and give its rows."""
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
