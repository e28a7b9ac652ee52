"""Camera queries over the event tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import camera as op
from ..registry import query
from ..sources.views import camera

_SPEED = """d AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt, yaw - lag(yaw) OVER w AS dy, pitch - lag(pitch) OVER w AS dp FROM camera WINDOW w AS (PARTITION BY session ORDER BY ts, id)),
  s AS (SELECT *, CASE WHEN dt > 0 THEN CASE WHEN dy > 180 THEN dy - 360 WHEN dy < -180 THEN dy + 360 ELSE dy END / dt END AS yaw_speed, CASE WHEN dt > 0 THEN dp / dt END AS pitch_speed FROM d),
  v AS (SELECT *, sqrt(yaw_speed * yaw_speed + pitch_speed * pitch_speed) AS speed FROM s)"""


@query("camera_velocity", f"WITH {_SPEED} SELECT session, id, round(dt, 6) AS dt, round(yaw_speed, 6) AS yaw_speed, round(pitch_speed, 6) AS pitch_speed, round(speed, 6) AS speed FROM v", "camera")
def camera_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.velocities(camera(spark, sf_dir)).select("session", "id", *[F.round(c, 6).alias(c) for c in ("dt", "yaw_speed", "pitch_speed", "speed")])


@query("dwell", f"""WITH {_SPEED}, l AS (SELECT *, coalesce(max(CASE WHEN speed > 0.02 THEN epoch_us(ts) END) OVER p, min(epoch_us(ts)) OVER p) AS since FROM v WINDOW p AS (PARTITION BY session ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
  SELECT session, id, round((epoch_us(ts) - since) / 1e6, 6) AS still_for, (epoch_us(ts) - since) / 1e6 > 7200 AS pull FROM l""", "camera")
def dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the camera has been still, with limits that suit the derived track."""
    return op.dwell(op.velocities(camera(spark, sf_dir)), 0.02, 7200).select("session", "id", F.round("still_for", 6).alias("still_for"), "pull")


@query("zoom_smooth", """SELECT session, round(list_reduce(list(radius ORDER BY ts, id), lambda r, t: r + (t - r) * 0.1), 6) AS radius FROM camera GROUP BY 1""", "camera")
def zoom_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.smooth(camera(spark, sf_dir), "session", ["ts", "id"], "radius").select("session", F.round("radius", 6).alias("radius"))


_TILES = """SELECT id, unnest(range(greatest(floor(pitch - h), -90)::INT, least(ceil(pitch + h), 90)::INT)) AS lat, w, yaw FROM (SELECT id, pitch, yaw - 180 AS yaw, round((radius - 5) / 10, 6) AS h, round((radius - 5) / 8, 6) AS w FROM camera)"""


@query("visible_tiles", f"SELECT id, lat, lon, concat('N', lat, 'E', lon) AS key FROM (SELECT id, lat, unnest(range(greatest(floor(yaw - w), -180)::INT, least(ceil(yaw + w), 180)::INT)) AS lon FROM ({_TILES}))", "camera")
def visible_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = op.visible_tiles(F.col("pitch"), F.col("yaw") - 180, F.round((F.col("radius") - 5) / 10, 6), F.round((F.col("radius") - 5) / 8, 6))
    d = camera(spark, sf_dir).select("id", F.explode(lat).alias("lat"), lon.alias("lons")).select("id", "lat", F.explode("lons").alias("lon"))
    return d.select("id", "lat", "lon", F.concat(F.lit("N"), "lat", F.lit("E"), "lon").alias("key"))


@query("tile_requests", f"SELECT lat, lon, count(*) AS views FROM (SELECT id, lat, unnest(range(greatest(floor(yaw - w), -180)::INT, least(ceil(yaw + w), 180)::INT)) AS lon FROM ({_TILES})) GROUP BY 1, 2", "camera")
def tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_tiles(spark, sf_dir).groupBy("lat", "lon").agg(F.count("*").alias("views"))
