"""Camera tracks: velocities, dwell, smoothing, visible tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unwrap(d: Column) -> Column:
    """An angle difference moved into -180..180."""
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def micros(c: str | Column) -> Column:
    """A time as microseconds, whatever its kind."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def velocities(df: DataFrame, key: str = "session", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """dt in seconds, yaw and pitch speeds in degrees a second; null on a session's first state and where dt is 0."""
    w = Window.partitionBy(key).orderBy(*order)
    dt = (micros("ts") - micros(F.lag("ts").over(w))) / 1e6
    d = df.withColumn("dt", dt)
    for c, step in (("yaw", unwrap(F.col("yaw") - F.lag("yaw").over(w))), ("pitch", F.col("pitch") - F.lag("pitch").over(w))):
        d = d.withColumn(f"{c}_speed", F.when(F.col("dt") > 0, step / F.col("dt")))
    return d.withColumn("speed", F.sqrt(F.col("yaw_speed") * F.col("yaw_speed") + F.col("pitch_speed") * F.col("pitch_speed")))


def dwell(df: DataFrame, slow: float, seconds: float, key: str = "session", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """still_for: seconds since the state last moved faster than `slow`, or since the session's start; pull: longer than
    `seconds`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    since = F.coalesce(F.last(F.when(F.col("speed") > slow, micros("ts")), ignorenulls=True).over(w), F.first(micros("ts")).over(w))
    d = df.withColumn("still_for", (micros("ts") - since) / 1e6)
    return d.withColumn("pull", F.col("still_for") > seconds)


def smooth(df: DataFrame, key: str, order: list[str], value: str, rate: float = 0.1) -> DataFrame:
    """(key, value): each session's exponentially smoothed value after its last state."""
    run = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    fold = F.aggregate("run", F.get("run", 0)["_v"], lambda r, s: r + (s["_v"] - r) * rate)
    return df.groupBy(key).agg(run.alias("run")).select(key, fold.alias(value))


def visible_tiles(lat: Column, lon: Column, half_lat: Column, half_lon: Column) -> tuple[Column, Column]:
    """South-west corners of the whole-degree tiles in view, kept on the globe."""

    def span(c: Column, h: Column, limit: int) -> Column:
        low, high = F.greatest(F.floor(c - h), F.lit(-limit)), F.least(F.ceil(c + h) - 1, F.lit(limit - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    return span(lat, half_lat, 90), span(lon, half_lon, 180)
