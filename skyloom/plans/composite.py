"""Composite queries over the image stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composite as op
from ..registry import query
from ..sources.views import frames_px

# 8-bit gates that reject a share of the derived frames
GATES = {"cloud_mean": 110, "cloud_var": 3000, "cloud_tint": 40, "mist_mean": 125, "mist_sat": 60}
_CLOUD = "mean > 110 AND var < 3000 AND abs(mean_red - mean_green) < 40 AND abs(mean_red - mean_blue) < 40"
_MIST = "mean > 125 AND sat < 60"

_NULLED = """nulled AS (SELECT tile_r, tile_c, frame, y, x, CASE WHEN NOT (red = 0 AND green = 0 AND blue = 0) THEN red END AS red,
  CASE WHEN NOT (red = 0 AND green = 0 AND blue = 0) THEN green END AS green, CASE WHEN NOT (red = 0 AND green = 0 AND blue = 0) THEN blue END AS blue FROM frames_px)"""
_FILLED = f"""{_NULLED}, filled AS (SELECT tile_r, tile_c, frame, y, x, coalesce(red, median(red) OVER p, 0) AS red,
  coalesce(green, median(green) OVER p, 0) AS green, coalesce(blue, median(blue) OVER p, 0) AS blue FROM nulled WINDOW p AS (PARTITION BY tile_r, tile_c, y, x))"""
_STATS = f"""{_FILLED}, stats AS (SELECT tile_r, tile_c, frame, round(sum(red + green + blue) / (3 * count(*)), 6) AS mean,
  round(sum(red * red + green * green + blue * blue) / (3 * count(*)) - (sum(red + green + blue) / (3 * count(*))) * (sum(red + green + blue) / (3 * count(*))), 6) AS var,
  round(avg(red), 6) AS mean_red, round(avg(green), 6) AS mean_green, round(avg(blue), 6) AS mean_blue,
  round(greatest(avg(red), avg(green), avg(blue)) - least(avg(red), avg(green), avg(blue)), 6) AS sat FROM filled GROUP BY 1, 2, 3)"""
_KEPT = f"""{_STATS}, gated AS (SELECT *, ({_CLOUD}) OR ({_MIST}) AS reject FROM stats),
  counted AS (SELECT *, count(*) OVER t AS n, count(*) FILTER (NOT reject) OVER t AS good FROM gated WINDOW t AS (PARTITION BY tile_r, tile_c)),
  kept AS (SELECT tile_r, tile_c, frame, CASE WHEN good < floor(0.85 * n) THEN n ELSE good END AS kept FROM counted WHERE good < floor(0.85 * n) OR NOT reject)"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.median_fill(op.missing_to_null(frames_px(spark, sf_dir)))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud, mist = op.is_cloud(110, 3000, 40), op.is_mist(125, 60)
    return op.frame_stats(_filled(spark, sf_dir)).withColumn("reject", cloud | mist)


@query("composite_best_k", f"""WITH {_KEPT}, scored AS (SELECT f.*, kept, round((red + green + blue) / 3 - 2 * (greatest(red, green, blue) - least(red, green, blue)) - 1.5 * (blue - red), 6) AS score
    FROM filled f JOIN kept USING (tile_r, tile_c, frame)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY tile_r, tile_c, y, x ORDER BY score, frame) AS k FROM scored)
  SELECT tile_r, tile_c, y, x, floor(least(greatest(round(quantile_cont(red, 0.1), 6), 0), 255))::BIGINT AS red, floor(least(greatest(round(quantile_cont(green, 0.1), 6), 0), 255))::BIGINT AS green,
    floor(least(greatest(round(quantile_cont(blue, 0.1), 6), 0), 255))::BIGINT AS blue FROM ranked WHERE k <= least(greatest(8, floor(0.25 * kept)), 20) GROUP BY 1, 2, 3, 4""", "frames_px")
def composite_best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.best_pixel(frames_px(spark, sf_dir), **GATES)


@query("composite_median", f"WITH {_NULLED} SELECT tile_r, tile_c, y, x, median(red) AS red, median(green) AS green, median(blue) AS blue FROM nulled GROUP BY 1, 2, 3, 4", "frames_px")
def composite_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.median_composite(op.missing_to_null(frames_px(spark, sf_dir)))


@query("frame_stats", f"WITH {_STATS} SELECT * FROM stats", "frames_px")
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.frame_stats(_filled(spark, sf_dir))


@query("cloud_gate", f"WITH {_STATS} SELECT tile_r, tile_c, frame FROM stats WHERE {_CLOUD}", "frames_px")
def cloud_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.frame_stats(_filled(spark, sf_dir)).where(op.is_cloud(110, 3000, 40)).select(*op.TILE, "frame")


@query("mist_gate", f"WITH {_STATS} SELECT tile_r, tile_c, frame FROM stats WHERE {_MIST}", "frames_px")
def mist_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.frame_stats(_filled(spark, sf_dir)).where(op.is_mist(125, 60)).select(*op.TILE, "frame")


@query("gate_fallback", f"WITH {_KEPT} SELECT tile_r, tile_c, frame, kept FROM kept", "frames_px")
def gate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep_frames(_gated(spark, sf_dir)).select(*op.TILE, "frame", "kept")


@query("ice_exception", f"""WITH {_STATS}, edges AS (SELECT tile_r, tile_c, frame, round(stddev_pop((red + green + blue) / 3), 6) AS spread FROM filled GROUP BY 1, 2, 3)
  SELECT tile_r, tile_c, frame, ({_CLOUD}) AS cloud, (tile_r IN (0, 1, 8, 9) OR (tile_r = 4 AND tile_c IN (13, 14))) AND spread < 20 AND mean_blue >= mean_red AND NOT (mean_blue < mean_green) AS ice
  FROM stats JOIN edges USING (tile_r, tile_c, frame)""", "frames_px")
def ice_exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat, blue-dominant frames of polar rows and listed high tiles are ice, not cloud."""
    filled = _filled(spark, sf_dir)
    spread = filled.groupBy(*op.TILE, "frame").agg(F.round(F.stddev_pop((F.col("red") + F.col("green") + F.col("blue")) / 3), 6).alias("spread"))
    polar = spark.createDataFrame([(r, c) for r in (0, 1, 8, 9) for c in range(20)] + [(4, 13), (4, 14)], "tile_r int, tile_c int").withColumn("listed", F.lit(True))
    s = op.frame_stats(filled).join(spread, [*op.TILE, "frame"]).join(F.broadcast(polar), list(op.TILE), "left")  # 82 rows
    ice = F.coalesce(F.col("listed"), F.lit(False)) & (F.col("spread") < 20) & (F.col("mean_blue") >= F.col("mean_red")) & (F.col("mean_blue") >= F.col("mean_green"))
    return s.select(*op.TILE, "frame", op.is_cloud(110, 3000, 40).alias("cloud"), ice.alias("ice"))


@query("rgb_missing_null", f"WITH {_NULLED} SELECT * FROM nulled", "frames_px")
def rgb_missing_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.missing_to_null(frames_px(spark, sf_dir))


@query("artifact_strip", """SELECT tile_r, tile_c, frame, y, x, CASE WHEN bad THEN NULL ELSE red END AS red, CASE WHEN bad THEN NULL ELSE green END AS green, CASE WHEN bad THEN NULL ELSE blue END AS blue
  FROM (SELECT *, (red < 30 AND green < 30 AND blue < 30) OR (red > 150 AND green > 150 AND blue > 150) AS bad FROM frames_px)""", "frames_px")
def artifact_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.strip_artifacts(frames_px(spark, sf_dir), 30, 150)


@query("median_fill", f"WITH {_FILLED} SELECT * FROM filled", "frames_px")
def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir)


@query("pixel_score", f"WITH {_FILLED} SELECT tile_r, tile_c, frame, y, x, round((red + green + blue) / 3 - 2 * (greatest(red, green, blue) - least(red, green, blue)) - 1.5 * (blue - red), 6) AS score FROM filled", "frames_px")
def pixel_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = op.pixel_score(F.col("red"), F.col("green"), F.col("blue"))
    return _filled(spark, sf_dir).select(*op.TILE, "frame", "y", "x", F.round(score, 6).alias("score"))


@query("scene_composite", """WITH mid AS (SELECT tile_r, tile_c, y, x, median(CASE WHEN NOT bad THEN red END) AS red, median(CASE WHEN NOT bad THEN green END) AS green, median(CASE WHEN NOT bad THEN blue END) AS blue
    FROM (SELECT *, (red < 1 AND green < 1 AND blue < 1) OR (red > 250 AND green > 250 AND blue > 250) AS bad FROM frames_px) GROUP BY 1, 2, 3, 4),
  filled AS (SELECT m.tile_r, m.tile_c, m.y, m.x, coalesce(CASE WHEN m.red IS NULL AND m.green IS NULL AND m.blue IS NULL THEN r.red ELSE m.red END, 0) AS red,
    coalesce(CASE WHEN m.red IS NULL AND m.green IS NULL AND m.blue IS NULL THEN r.green ELSE m.green END, 0) AS green,
    coalesce(CASE WHEN m.red IS NULL AND m.green IS NULL AND m.blue IS NULL THEN r.blue ELSE m.blue END, 0) AS blue, r.red AS rr, r.green AS rg, r.blue AS rb
    FROM mid m LEFT JOIN (SELECT tile_r, tile_c, y, x, red, green, blue FROM frames_px WHERE frame = 80) r USING (tile_r, tile_c, y, x)),
  ratios AS (SELECT tile_r, tile_c, CASE WHEN avg(red + green + blue) > 0 THEN coalesce(least(greatest(CASE WHEN avg(rr + rg + rb) IS NULL THEN 1.0 ELSE avg(rr + rg + rb) / avg(red + green + blue) END, 0.1), 1.0), 1.0) ELSE 1.0 END AS ratio FROM filled GROUP BY 1, 2)
  SELECT tile_r, tile_c, y, x, round(ratio, 6) AS ratio, floor(least(greatest(round(red * ratio, 6), 0), 230))::BIGINT AS red, floor(least(greatest(round(green * ratio, 6), 0), 230))::BIGINT AS green,
    floor(least(greatest(round(blue * ratio, 6), 0), 230))::BIGINT AS blue FROM filled JOIN ratios USING (tile_r, tile_c)""", "frames_px")
def scene_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = frames_px(spark, sf_dir)
    return op.scene_composite(px, px.where("frame = 80"))


@query("pixel_cdf", "WITH c AS (SELECT tile_r, red, count(*) AS n FROM frames_px GROUP BY 1, 2) SELECT tile_r, red, n, round(sum(n) OVER (PARTITION BY tile_r ORDER BY red) / sum(n) OVER (PARTITION BY tile_r), 6) AS cdf FROM c", "frames_px")
def pixel_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cumulative(frames_px(spark, sf_dir), ["tile_r"], "red").withColumn("cdf", F.round("cdf", 6))


_CDF = "(SELECT tile_r, red, sum(n) OVER (PARTITION BY tile_r ORDER BY red) / sum(n) OVER (PARTITION BY tile_r) AS cdf FROM (SELECT tile_r, red, count(*) AS n FROM frames_px WHERE frame % 2 = {} GROUP BY 1, 2))"


@query("hist_match", f"""WITH s AS {_CDF.format(0)}, r AS {_CDF.format(1)},
  lo AS (SELECT s.tile_r, s.red, max(r.cdf) AS c FROM s JOIN r ON s.tile_r = r.tile_r AND r.cdf < s.cdf GROUP BY 1, 2),
  hi AS (SELECT s.tile_r, s.red, min(r.cdf) AS c FROM s JOIN r ON s.tile_r = r.tile_r AND r.cdf >= s.cdf GROUP BY 1, 2)
  SELECT s.tile_r, s.red, round(CASE WHEN lo.c IS NULL THEN h.red WHEN hi.c IS NULL THEN l.red WHEN hi.c = s.cdf THEN h.red ELSE l.red + (h.red - l.red) * (s.cdf - lo.c) / (hi.c - lo.c) END, 6) AS matched
  FROM s LEFT JOIN lo USING (tile_r, red) LEFT JOIN hi USING (tile_r, red) LEFT JOIN r l ON l.tile_r = s.tile_r AND l.cdf = lo.c LEFT JOIN r h ON h.tile_r = s.tile_r AND h.cdf = hi.c""", "frames_px")
def hist_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = frames_px(spark, sf_dir)
    return op.match_histogram(px.where("frame % 2 = 0"), px.where("frame % 2 = 1"), ["tile_r"], "red")


@query("exposure_match", """SELECT tile_r, tile_c, round(CASE WHEN avg(red + green + blue) FILTER (frame % 2 = 0) > 0 THEN least(greatest(avg(red + green + blue) FILTER (frame % 2 = 1) / avg(red + green + blue) FILTER (frame % 2 = 0), 0.1), 1.0) ELSE 1.0 END, 6) AS ratio
  FROM frames_px GROUP BY 1, 2 HAVING count(*) FILTER (frame % 2 = 0) > 0 AND count(*) FILTER (frame % 2 = 1) > 0""", "frames_px")
def exposure_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Darkening factor of even frames towards odd ones, in one pass."""
    light = F.col("red") + F.col("green") + F.col("blue")
    s = frames_px(spark, sf_dir).groupBy(*op.TILE).agg(F.avg(F.when(F.col("frame") % 2 == 0, light)).alias("src"), F.avg(F.when(F.col("frame") % 2 == 1, light)).alias("ref"))
    ratio = F.when(F.col("src") > 0, F.least(F.greatest(F.try_divide("ref", "src"), F.lit(0.1)), F.lit(1.0))).otherwise(F.lit(1.0))
    return s.where("src is not null and ref is not null").select(*op.TILE, F.round(ratio, 6).alias("ratio"))


@query("placeholder_frames", "SELECT tile_r, tile_c, frame FROM frames_px GROUP BY 1, 2, 3 HAVING avg(blue) > 130 AND avg(red) < 45", "frames_px")
def placeholder_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blue no-data placeholder frames."""
    return frames_px(spark, sf_dir).groupBy(*op.TILE, "frame").agg(F.avg("blue").alias("b"), F.avg("red").alias("r")).where("b > 130 and r < 45").select(*op.TILE, "frame")


@query("mosaic_assemble", """SELECT gy, gx, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue FROM (SELECT i // 40 AS gy, i % 40 AS gx FROM range(800) r(i))
  LEFT JOIN (SELECT tile_r * 2 + y AS gy, tile_c * 2 + x AS gx, median(red) AS red, median(green) AS green, median(blue) AS blue FROM frames_px WHERE tile_r < 9 GROUP BY 1, 2) USING (gy, gx)""", "frames_px")
def mosaic_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below the ninth were never fetched and are black."""
    return op.mosaic(op.median_composite(frames_px(spark, sf_dir).where("tile_r < 9")), 10, 20, 2)
