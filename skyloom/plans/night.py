"""Night-light queries over the patches; histogram ranges are those of the derived rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import night as op
from ..operators import stencils
from ..registry import query
from ..sources.views import patch_px
from .stencils import _LAP, _SOBEL, _XY

_BIN = "least(floor((v - ({lo})) / (({hi}) - ({lo})) * {n}) + 1, {n})::BIGINT"


def _hist_sql(lo: float, hi: float, n: int, key: str = "tile", where: str = "true") -> str:
    return f"SELECT {key}, bin, ({lo}) + (bin - 1) * (({hi}) - ({lo})) / {n} AS edge, n FROM (SELECT {key}, {_BIN.format(lo=lo, hi=hi, n=n)} AS bin, count(*) AS n FROM patch_px WHERE v BETWEEN {lo} AND {hi} AND {where} GROUP BY 1, 2)"


@query("log_stack", "SELECT biome, y, x, round(median(ln(1 + greatest(v, 0) * 1e9)), 5) AS median_log FROM patch_px GROUP BY 1, 2, 3", "patch_px")
def log_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-pixel median over a biome's frames of log radiance."""
    return patch_px(spark, sf_dir).groupBy("biome", "y", "x").agg(F.round(F.median(op.log_radiance(F.col("v"))), 5).alias("median_log"))


@query("persistence", "SELECT biome, y, x, round(avg((v > 0.05)::INT), 6) AS fraction, avg((v > 0.05)::INT) > 0.3 AS lasting FROM patch_px GROUP BY 1, 2, 3", "patch_px")
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.avg((F.col("v") > 0.05).cast("int"))
    return patch_px(spark, sf_dir).groupBy("biome", "y", "x").agg(F.round(f, 6).alias("fraction"), (f > 0.3).alias("lasting"))


@query("histogram", _hist_sql(-0.5, 0.5, 100, "biome"), "patch_px")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.histogram(patch_px(spark, sf_dir), ["biome"], "v", -0.5, 0.5, 100)


@query("hist_peak_floor", f"""WITH h AS ({_hist_sql(-0.5, 0.5, 20)}) SELECT tile, round(arg_max(edge, n * 1000 - bin), 6) AS peak,
  round(sqrt(greatest(sum(edge * edge * n) / sum(n) - (sum(edge * n) / sum(n)) * (sum(edge * n) / sum(n)), 0)), 5) AS sigma,
  round(arg_max(edge, n * 1000 - bin) + 0.5 * sqrt(greatest(sum(edge * edge * n) / sum(n) - (sum(edge * n) / sum(n)) * (sum(edge * n) / sum(n)), 0)), 5) AS floor FROM h GROUP BY 1""", "patch_px")
def hist_peak_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = op.noise_floor(op.histogram(patch_px(spark, sf_dir), ["tile"], "v", -0.5, 0.5, 20), ["tile"], 0.5)
    return f.select("tile", F.round("peak", 6).alias("peak"), F.round("sigma", 5).alias("sigma"), F.round("floor", 5).alias("floor"))


@query("tundra_floor", f"""WITH h AS ({_hist_sql(-0.5, 0.5, 128, "biome", "biome = 2 AND v > 0")}), c AS (SELECT count(*) AS n FROM patch_px WHERE biome = 2 AND v > 0)
  SELECT biome, round(arg_max(edge, n * 1000 - bin) + 1.5 * sqrt(greatest(sum(edge * edge * n) / sum(n) - (sum(edge * n) / sum(n)) * (sum(edge * n) / sum(n)), 0)) + 0.2, 5) AS floor FROM h WHERE (SELECT n FROM c) > 500 GROUP BY 1""", "patch_px")
def tundra_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = patch_px(spark, sf_dir).where("biome = 2 and v > 0")
    enough = px.groupBy("biome").count().where("count > 500").select("biome")
    f = op.noise_floor(op.histogram(px, ["biome"], "v", -0.5, 0.5, 128), ["biome"], 1.5, 0.2)
    return f.join(enough, "biome", "left_semi").select("biome", F.round("floor", 5).alias("floor"))


@query("pctl_stretch_gamma", """WITH p AS (SELECT tile, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.99) AS hi FROM patch_px WHERE v > 0 GROUP BY 1)
  SELECT tile, y, x, CASE WHEN v > 0 AND hi - lo >= 1e-4 THEN floor(round(255 * pow(least(greatest((v - lo) / (hi - lo), 0), 1), 1 / 2.2::DOUBLE), 6))::BIGINT ELSE 0 END AS byte FROM patch_px LEFT JOIN p USING (tile)""", "patch_px")
def pctl_stretch_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stretch(patch_px(spark, sf_dir), ["tile"]).select("tile", "y", "x", "byte")


@query("sigmoid_stretch", """SELECT tile, y, x, round(CASE WHEN max(v) OVER t - min(v) OVER t >= 1e-4 THEN 1 / (1 + exp(-25 * ((v - min(v) OVER t) / (max(v) OVER t - min(v) OVER t) - 0.4))) ELSE 0 END, 6) AS sigmoid FROM patch_px WINDOW t AS (PARTITION BY tile)""", "patch_px")
def sigmoid_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sigmoid(patch_px(spark, sf_dir), ["tile"]).select("tile", "y", "x", F.round("sigmoid", 6).alias("sigmoid"))


@query("entropy", f"WITH h AS ({_hist_sql(-0.5, 0.5, 10)}), t AS (SELECT tile, sum(n) AS s FROM h GROUP BY 1) SELECT tile, round(-sum(n / (s + 1e-6) * log2(n / (s + 1e-6) + 1e-6)), 6) AS entropy FROM h JOIN t USING (tile) GROUP BY 1", "patch_px")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.entropy(patch_px(spark, sf_dir), ["tile"], "v", -0.5, 0.5).select("tile", F.round("entropy", 6).alias("entropy"))


_TRUTH = "SELECT a.tile, a.y, a.x, a.biome, a.v, bool_or(b.v > 0.15 AND b.v / (m.most + 1e-6) > 0.35) AS truth FROM patch_px a JOIN patch_px b ON a.tile = b.tile AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND (abs(a.y - b.y) < 2 OR a.x = b.x) JOIN (SELECT tile, max(v) AS most FROM patch_px GROUP BY 1) m ON m.tile = a.tile GROUP BY 1, 2, 3, 4, 5"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = patch_px(spark, sf_dir).withColumn("most", F.max("v").over(Window.partitionBy("tile")))
    return stencils.dilate(px, ["tile"], stencils.ellipse5(), (F.col("v") > 0.15) & (F.col("v") / (F.col("most") + 1e-6) > 0.35)).withColumnRenamed("dilated", "truth")


@query("truth_mask", f"SELECT tile, y, x, truth FROM ({_TRUTH})", "patch_px")
def truth_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir).select("tile", "y", "x", "truth")


@query("wipe_masks", f"SELECT tile, y, x, CASE WHEN (biome = 3 AND NOT truth) OR biome = 0 OR tile IN (7, 11, 19) THEN 0 ELSE v END AS v FROM ({_TRUTH})", "patch_px")
def wipe_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desert without truth, ocean and black-listed tiles go dark."""
    gone = ((F.col("biome") == 3) & ~F.col("truth")) | (F.col("biome") == 0) | F.col("tile").isin(7, 11, 19)
    return _truth(spark, sf_dir).select("tile", "y", "x", F.when(gone, 0.0).otherwise(F.col("v")).alias("v"))


@query("floor_wipe", "SELECT tile, y, x, CASE WHEN v > 0 AND v < 0.08 THEN 0 ELSE v END AS v FROM patch_px", "patch_px")
def floor_wipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch_px(spark, sf_dir).select("tile", "y", "x", F.when((F.col("v") > 0) & (F.col("v") < 0.08), 0.0).otherwise(F.col("v")).alias("v"))


@query("biome_thresholds", """SELECT tile, CASE WHEN bool_or(biome = 2) THEN 2.8 ELSE 4.5 END::DOUBLE AS stripe, CASE WHEN bool_or(biome = 2) THEN 2.2 ELSE 3.0 END::DOUBLE AS grain,
  CASE WHEN bool_or(biome = 2) THEN 0.15 ELSE 0.05 END::DOUBLE AS fog, CASE WHEN bool_or(biome = 2) THEN 99.5 ELSE 99.0 END::DOUBLE AS p_safe FROM patch_px GROUP BY 1""", "patch_px")
def biome_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = patch_px(spark, sf_dir).groupBy("tile").agg(F.bool_or(F.col("biome") == 2).alias("tundra"))
    return t.select("tile", *op.thresholds(F.col("tundra")))


@query("snipers", f"""WITH l AS (SELECT tile, y, x, biome, v, {_LAP} AS lap FROM patch_px {_XY}), s AS ({_SOBEL}),
  p AS (SELECT tile, quantile_cont(v, 0.99) AS limit_v, bool_or(biome = 2) AS tundra FROM patch_px GROUP BY 1)
  SELECT tile, y, x, abs(round(sx, 6)) / (abs(round(sy, 6)) + 1e-6) > CASE WHEN tundra THEN 2.8 ELSE 4.5 END AND abs(round(sx, 6)) > 0.2 AND NOT v > limit_v AS stripe_mask,
    abs(round(lap, 6)) > CASE WHEN tundra THEN 0.5 ELSE 0.8 END AND v < limit_v AND NOT v > limit_v AS grain_mask, abs(round(lap, 6)) < CASE WHEN tundra THEN 0.15 ELSE 0.05 END AND v > 0 AND NOT v > limit_v AS fog_mask
  FROM l JOIN s USING (tile, y, x) JOIN p USING (tile)""", "patch_px")
def snipers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripe, grain and fog pixels that the safe percentile does not protect."""
    d = stencils.sobel(stencils.laplacian(patch_px(spark, sf_dir), ["tile"]), ["tile"])
    per = patch_px(spark, sf_dir).groupBy("tile").agg(F.percentile("v", F.lit(0.99)).alias("limit_v"), F.bool_or(F.col("biome") == 2).alias("tundra"))
    d = d.join(per, "tile")
    pick = lambda a, b: F.when(F.col("tundra"), F.lit(a)).otherwise(F.lit(b))
    masks = op.noise_masks(F.round("sx", 6), F.round("sy", 6), F.round("lap", 6), F.col("v"), pick(2.8, 4.5), pick(0.5, 0.8), pick(0.15, 0.05), F.col("limit_v"))
    return d.select("tile", "y", "x", *[(m & ~(F.col("v") > F.col("limit_v"))).alias(k) for k, m in masks.items()])


_CLUSTER = "SELECT biome, tile % 7 AS label, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) - min(y) + 1 AS height, max(x) - min(x) + 1 AS width, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS most, max(v) / (avg(v) + 1e-6) AS peak FROM patch_px WHERE v > 0.2 GROUP BY 1, 2"


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cluster_stats(patch_px(spark, sf_dir).where("v > 0.2").withColumn("label", F.col("tile") % 7), ["biome", "label"])


@query("cluster_stats", f"SELECT biome, label, area, y0, x0, height, width, round(mean, 6) AS mean, round(std, 6) AS std, most, round(peak, 6) AS peak FROM ({_CLUSTER})", "patch_px")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select("biome", "label", "area", "y0", "x0", "height", "width", *[F.round(c, 6).alias(c) for c in ("mean", "std", "most", "peak")])


@query("cluster_rules", f"""WITH c AS ({_CLUSTER}), h AS (SELECT biome, label, bin, count(*) AS n FROM (SELECT biome, tile % 7 AS label, least(floor((v - 0.2) / 0.3 * 10) + 1, 10) AS bin FROM patch_px WHERE v > 0.2 AND v <= 0.5) GROUP BY 1, 2, 3),
  e AS (SELECT biome, label, -sum(n / (s + 1e-6) * log2(n / (s + 1e-6) + 1e-6)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY biome, label) AS s FROM h) GROUP BY 1, 2)
  SELECT biome, label, ((std < 0.03 AND area > 20) OR (biome = 2 AND (round(entropy, 6) < 0.8 OR round(peak, 6) < 1.4)) OR (biome = 4 AND round(peak, 6) < 1.3)) AND NOT label / 50.0 > 0.1 AS kill FROM c JOIN e USING (biome, label)""", "patch_px")
def cluster_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = patch_px(spark, sf_dir).where("v > 0.2").withColumn("label", F.col("tile") % 7)
    e = op.entropy(px, ["biome", "label"], "v", 0.2, 0.5)
    d = _clusters(spark, sf_dir).join(e, ["biome", "label"])
    return d.select("biome", "label", op.kill(F.col("biome"), F.col("area"), F.col("std"), F.round("peak", 6), F.round("entropy", 6), F.col("label") / 50.0, 0.03, 20).alias("kill"))


@query("flat_tiles", "SELECT tile FROM patch_px GROUP BY 1 HAVING max(v) - min(v) >= 0.5", "patch_px")
def flat_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with range enough to stretch."""
    return patch_px(spark, sf_dir).groupBy("tile").agg((F.max("v") - F.min("v")).alias("span")).where("span >= 0.5").select("tile")
