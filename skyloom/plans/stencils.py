"""Stencil queries over the 8 x 8 patches and the sparse raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stencils as op
from ..registry import query
from ..sources.views import grid_gap, patch_px

_XY = "WINDOW h AS (PARTITION BY tile, y ORDER BY x), w AS (PARTITION BY tile, x ORDER BY y)"
_LAP = "coalesce(lead(v) OVER h, lag(v) OVER h) + coalesce(lag(v) OVER h, lead(v) OVER h) + coalesce(lead(v) OVER w, lag(v) OVER w) + coalesce(lag(v) OVER w, lead(v) OVER w) - 4 * v"
# neighbours by self-join with reflected indices, unlike the windows of the Spark side
_AROUND = "SELECT a.tile, a.y, a.x, d.dy, d.dx, b.v FROM patch_px a CROSS JOIN (SELECT dy, dx FROM range(-1, 2) r(dy), range(-1, 2) q(dx)) d JOIN patch_px b ON b.tile = a.tile AND b.y = 7 - abs(7 - abs(a.y + d.dy)) AND b.x = 7 - abs(7 - abs(a.x + d.dx))"


def _gauss_sql(sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    k = f"(SELECT d, exp(-(d * d) / (2.0 * {sigma} * {sigma})) / (SELECT sum(exp(-(i * i) / (2.0 * {sigma} * {sigma}))) FROM range({-r}, {r + 1}) z(i)) AS k FROM range({-r}, {r + 1}) t(d))"
    fold = "CASE WHEN ((a.{0} + d) % 16 + 16) % 16 < 8 THEN ((a.{0} + d) % 16 + 16) % 16 ELSE 15 - ((a.{0} + d) % 16 + 16) % 16 END"
    one = f"SELECT a.tile, a.y, a.x, sum(k * b.v) AS v FROM patch_px a CROSS JOIN {k} JOIN patch_px b ON b.tile = a.tile AND b.x = a.x AND b.y = {fold.format('y')} GROUP BY 1, 2, 3"
    return f"g1 AS ({one}), g2 AS (SELECT a.tile, a.y, a.x, sum(k * b.v) AS blur FROM g1 a CROSS JOIN {k} JOIN g1 b ON b.tile = a.tile AND b.y = a.y AND b.x = {fold.format('x')} GROUP BY 1, 2, 3)"


_SOBEL = f"SELECT tile, y, x, sum(v * dx * (2 - abs(dy))) AS sx, sum(v * dy * (2 - abs(dx))) AS sy FROM ({_AROUND}) GROUP BY 1, 2, 3"


@query("laplacian", f"SELECT tile, y, x, round({_LAP}, 6) AS lap FROM patch_px {_XY}", "patch_px")
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.laplacian(patch_px(spark, sf_dir), ["tile"]).select("tile", "y", "x", F.round("lap", 6).alias("lap"))


@query("sharpness_gate", f"SELECT tile, round(max(v), 6) AS most, round(var_pop(lap), 5) AS var_lap, max(v) > 0.3 AND var_pop(lap) < 0.5 AS reject FROM (SELECT tile, v, {_LAP} AS lap FROM patch_px {_XY}) GROUP BY 1", "patch_px")
def sharpness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright frames whose Laplacian hardly varies are blurred."""
    s = op.laplacian(patch_px(spark, sf_dir), ["tile"]).groupBy("tile").agg(F.round(F.max("v"), 6).alias("most"), F.var_pop("lap").alias("var"))
    return s.select("tile", "most", F.round("var", 5).alias("var_lap"), ((F.col("most") > 0.3) & (F.col("var") < 0.5)).alias("reject"))


@query("sobel", f"SELECT tile, y, x, round(sx, 6) AS sx, round(sy, 6) AS sy FROM ({_SOBEL})", "patch_px")
def sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sobel(patch_px(spark, sf_dir), ["tile"]).select("tile", "y", "x", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


@query("gaussian_sep", f"WITH {_gauss_sql(1.0)} SELECT tile, y, x, round(blur, 5) AS blur FROM g2", "patch_px")
def gaussian_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.gaussian(patch_px(spark, sf_dir), ["tile"], 1.0, 1.0).select("tile", "y", "x", F.round("blur", 5).alias("blur"))


@query("closing", """WITH grown AS (SELECT a.tile, a.y, a.x, max(b.v) AS v FROM patch_px a JOIN patch_px b ON a.tile = b.tile AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3)
  SELECT a.tile, a.y, a.x, min(b.v) AS closed FROM grown a JOIN grown b ON a.tile = b.tile AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3""", "patch_px")
def closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.closing(patch_px(spark, sf_dir), ["tile"], 2).select("tile", "y", "x", "closed")


@query("erosion_l1", """SELECT a.tile, a.y, a.x, count(*) FILTER (b.v > -0.2) = 13 AS eroded FROM patch_px a JOIN patch_px b ON a.tile = b.tile AND abs(a.y - b.y) + abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3""", "patch_px")
def erosion_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.erode(patch_px(spark, sf_dir), ["tile"], 2, F.col("v") > -0.2).select("tile", "y", "x", "eroded")


@query("dilate_ellipse", """SELECT a.tile, a.y, a.x, bool_or(b.v > 0.25) AS dilated FROM patch_px a JOIN patch_px b ON a.tile = b.tile AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND (abs(a.y - b.y) < 2 OR a.x = b.x) GROUP BY 1, 2, 3""", "patch_px")
def dilate_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dilate(patch_px(spark, sf_dir), ["tile"], op.ellipse5(), F.col("v") > 0.25).select("tile", "y", "x", "dilated")


@query("feather", """WITH d AS (SELECT a.tile, a.y, a.x, min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS d
    FROM patch_px a LEFT JOIN patch_px b ON a.tile = b.tile AND b.v <= 0.1 AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 16 GROUP BY 1, 2, 3)
  SELECT tile, y, x, round(d, 5) AS distance, round(pow(least(greatest(coalesce(d, 4.0) / 4.0, 0), 1), 2), 5) AS alpha FROM d""", "patch_px")
def feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op.distance(patch_px(spark, sf_dir), ["tile"], F.col("v") > 0.1, 4)
    return d.select("tile", "y", "x", F.round("distance", 5).alias("distance"), F.round(op.feather("distance", 4, 2.0), 5).alias("alpha"))


@query("edge_smooth", f"""WITH {_gauss_sql(1.0)}, g AS (SELECT tile, y, x, sqrt(sx * sx + sy * sy) AS g FROM ({_SOBEL})), m AS (SELECT tile, max(g) AS most FROM g GROUP BY 1)
  SELECT p.tile, p.y, p.x, round(p.v * (1 - least(greatest(g / most / 0.2, 0), 1)) + blur * least(greatest(g / most / 0.2, 0), 1), 6) AS smooth FROM patch_px p JOIN g2 USING (tile, y, x) JOIN g USING (tile, y, x) JOIN m USING (tile)""", "patch_px")
def edge_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.edge_smooth(patch_px(spark, sf_dir), ["tile"], 1.0).select("tile", "y", "x", F.round("smooth", 6).alias("smooth"))


@query("gap_fill", """WITH known AS (SELECT y, x + s AS p, v FROM grid_gap CROSS JOIN (VALUES (-64), (0), (64)) t(s) WHERE v IS NOT NULL),
  lo AS (SELECT g.y, g.x, max(p) AS p FROM grid_gap g JOIN known k ON k.y = g.y AND k.p <= g.x GROUP BY 1, 2), hi AS (SELECT g.y, g.x, min(p) AS p FROM grid_gap g JOIN known k ON k.y = g.y AND k.p >= g.x GROUP BY 1, 2)
  SELECT g.y, g.x, round(CASE WHEN g.v IS NOT NULL THEN g.v ELSE a.v + (b.v - a.v) * (g.x - lo.p) / (hi.p - lo.p) END, 7) AS filled
  FROM grid_gap g LEFT JOIN lo USING (y, x) LEFT JOIN hi USING (y, x) LEFT JOIN known a ON a.y = g.y AND a.p = lo.p LEFT JOIN known b ON b.y = g.y AND b.p = hi.p""", "grid_gap")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fill_gaps(grid_gap(spark, sf_dir), 64).select("y", "x", F.round("filled", 7).alias("filled"))


@query("polar_blur", f"WITH {_gauss_sql(1.0)} SELECT tile, y, x, round(CASE WHEN y < 1 OR y >= 7 THEN blur ELSE v END, 6) AS v FROM patch_px JOIN g2 USING (tile, y, x)", "patch_px")
def polar_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur in the top and bottom 15 % of rows alone."""
    d = op.gaussian(patch_px(spark, sf_dir), ["tile"], 1.0, 1.0)
    return d.select("tile", "y", "x", F.round(F.when((F.col("y") < int(8 * 0.15)) | (F.col("y") >= 8 - int(8 * 0.15)), F.col("blur")).otherwise(F.col("v")), 6).alias("v"))


@query("wrap_pad", "SELECT tile, y, x + s AS x, v FROM patch_px CROSS JOIN (VALUES (-8), (0), (8)) t(s) WHERE x + s BETWEEN -3 AND 10", "patch_px")
def wrap_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.wrap_pad(patch_px(spark, sf_dir), 8, 3).select("tile", "y", "x", "v")
