"""Queries of the array kernels; where SQL cannot express them, the tests hold goldens."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import kernels as op
from ..operators import night, procedural, stencils
from ..registry import query
from ..sources.views import patch_px


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch_px(spark, sf_dir).withColumn("v", F.floor((F.col("v") + 0.6) * 200).cast("double"))


# the transform as a direct sum over the 64 pixels
@query("fft_gate", """WITH f AS (SELECT tile, u, w, ln(1 + sqrt(pow(sum(v * cos(2 * pi() * (u * y + w * x) / 8)), 2) + pow(sum(v * sin(2 * pi() * (u * y + w * x) / 8)), 2))) AS m FROM patch_px CROSS JOIN range(8) a(u) CROSS JOIN range(8) b(w) GROUP BY 1, 2, 3),
  s AS (SELECT tile, sum(m) AS m, sum(m) FILTER (u IN (0, 1, 6, 7) AND w IN (0, 1, 6, 7)) AS low FROM f GROUP BY 1) SELECT tile, round((m - low) / (m + 1e-6), 6) AS hf_ratio, (m - low) / (m + 1e-6) < 0.15 AS reject FROM s""", "patch_px")
def fft_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op.per_tile_value(patch_px(spark, sf_dir), "tile", lambda a: op.high_frequency_share(a, 4))
    return d.select("tile", F.round("out", 6).alias("hf_ratio"), (F.col("out") < 0.15).alias("reject"))


@query("edt", """SELECT a.tile, a.y, a.x, CASE WHEN a.v <= 0 THEN 0 ELSE round(min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))), 6) END AS distance FROM patch_px a JOIN patch_px b ON a.tile = b.tile AND b.v <= 0 GROUP BY 1, 2, 3, a.v""", "patch_px")
def edt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbounded distance transform of the positive pixels."""
    d = op.per_tile(patch_px(spark, sf_dir), "tile", lambda a: op.distance_transform(a > 0))
    return d.where("out < double('Infinity')").select("tile", "y", "x", F.round("out", 6).alias("distance"))


@query("components", """WITH RECURSIVE m AS (SELECT vec_id AS tile, pos // 8 AS y, pos % 8 AS x, pos + 1 AS i FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS v0 FROM embeddings) WHERE round(v0::DOUBLE, 6) > 0.15),
  r AS (SELECT tile, i AS root, y, x FROM m UNION SELECT r.tile, r.root, m.y, m.x FROM r JOIN m ON m.tile = r.tile AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1)
  SELECT tile, y, x, min(root) AS label FROM r GROUP BY 1, 2, 3""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-connected clusters of bright pixels, named by their first pixel."""
    d = op.per_tile(patch_px(spark, sf_dir), "tile", lambda a: op.connected(a > 0.15).astype(float))
    return d.where("out > 0").select("tile", "y", "x", F.col("out").cast("long").alias("label"))


@query("clahe")
def clahe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.per_tile(_bytes(spark, sf_dir), "tile", lambda a: op.clahe(a, 2.0, 4)).select("tile", "y", "x", F.round("out", 4).alias("v"))


@query("canny")
def canny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.per_tile(_bytes(spark, sf_dir), "tile", lambda a: op.canny(a, 50, 150)).select("tile", "y", "x", F.col("out").alias("edge"))


@query("bicubic", """WITH t AS (SELECT m, least(greatest(floor((m + 0.5) / 2 - 0.5)::INT - 1 + i, 0), 7) AS p, abs((m + 0.5) / 2 - 0.5 - (floor((m + 0.5) / 2 - 0.5) - 1 + i))::DOUBLE AS d FROM range(16) a(m) CROSS JOIN range(4) b(i)),
  w AS (SELECT m, p, CASE WHEN d <= 1 THEN 1.25 * d * d * d - 2.25 * d * d + 1 ELSE -0.75 * d * d * d + 3.75 * d * d - 6 * d + 3 END AS k FROM t)
  SELECT tile, a.m::INT AS y, b.m::INT AS x, round(sum(a.k * b.k * v), 6) AS v FROM patch_px p JOIN w a ON a.p = p.y JOIN w b ON b.p = p.x GROUP BY 1, 2, 3""", "patch_px")
def bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((8, 8))
        a[p["y"], p["x"]] = p["v"]
        out = op.bicubic(a, 16, 16)
        y, x = np.indices(out.shape)
        return pd.DataFrame({"tile": p["tile"].iloc[0], "y": y.ravel(), "x": x.ravel(), "v": out.ravel().round(6)})

    return patch_px(spark, sf_dir).select("tile", "y", "x", "v").groupBy("tile").applyInPandas(run, "tile long, y int, x int, v double")


_NOISE = "('0x' || substr(md5('{}' || ',' || tile || ',' || y || ',' || x), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("dither", f"SELECT tile, y, x, round(v + ({_NOISE.format(3)} - {_NOISE.format(4)}) / 255, 6) AS v FROM patch_px", "patch_px")
def dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = procedural.dither(F.col("v"), F.col("tile"), F.col("y"), F.col("x"))
    return patch_px(spark, sf_dir).select("tile", "y", "x", F.round(v, 6).alias("v"))


@query("night_composite")
def night_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The night mosaic layer by layer: truth mask, wiped tiles and biomes, noise pixels, floor, stretch, equalisation,
    clusters, and the last snap. Truth protects pixels from the noise masks and clusters from the rules."""
    px = patch_px(spark, sf_dir).withColumn("most", F.max("v").over(Window.partitionBy("tile")))
    bright = (F.col("v") > 0.15) & (F.col("v") / (F.col("most") + 1e-6) > 0.35)
    d = stencils.dilate(px, ["tile"], stencils.ellipse5(), bright).withColumnRenamed("dilated", "truth").drop("hits", "most")
    d = stencils.sobel(stencils.laplacian(d, ["tile"]), ["tile"])
    per = px.groupBy("tile").agg(F.percentile("v", F.lit(0.99)).alias("safe"), F.bool_or(F.col("biome") == 2).alias("tundra"))
    d = d.join(per, "tile")
    limits = {c: F.when(F.col("tundra"), a).otherwise(b) for c, a, b in (("stripe", 2.8, 4.5), ("grain", 0.5, 0.8), ("fog", 0.15, 0.05))}
    noise = night.noise_masks(F.col("sx"), F.col("sy"), F.col("lap"), F.col("v"), limits["stripe"], limits["grain"], limits["fog"], F.col("safe"))
    noisy = reduce(Column.__or__, noise.values()) & (F.col("v") <= F.col("safe")) & ~F.col("truth")
    gone = ((F.col("biome") == 3) & ~F.col("truth")) | (F.col("biome") == 0) | F.col("tile").isin(7, 11, 19)
    dark = gone | noisy | ((F.col("v") > 0) & (F.col("v") < 0.08))
    clean = d.select("tile", "biome", "truth", "y", "x", F.when(dark, 0.0).otherwise(F.col("v")).alias("v"))
    stretched = night.stretch(clean, ["tile"]).withColumn("v", F.col("byte").cast("double"))

    def labelled(p: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(p["y"].max()) + 1, int(p["x"].max()) + 1))
        a[p["y"], p["x"]] = p["v"]
        even = op.clahe(a, 2.0, 4)
        label = op.connected(even > 20)
        return p.assign(v=even[p["y"], p["x"]], label=label[p["y"], p["x"]].astype("int64"))

    schema = "tile long, biome int, truth boolean, y int, x int, v double, label long"
    even = stretched.select("tile", "biome", "truth", "y", "x", "v").groupBy("tile").applyInPandas(labelled, schema)
    lit, keys = even.where("label > 0"), ["tile", "biome", "label"]
    known = lit.groupBy("tile", "label").agg(F.avg(F.col("truth").cast("double")).alias("known"))
    stats = night.cluster_stats(lit, keys).join(night.entropy(lit, ["tile", "label"], "v", 0.0, 255.0), ["tile", "label"]).join(known, ["tile", "label"])
    dead = stats.where(night.kill(F.col("biome"), F.col("area"), F.col("std"), F.col("peak"), F.col("entropy"), F.col("known"))).select("tile", "label", F.lit(True).alias("dead"))
    v = F.floor(F.round("v", 6))
    return even.join(dead, ["tile", "label"], "left").select("tile", "y", "x", F.when(F.col("dead") | (v < 50), 0).otherwise(v).cast("long").alias("v"))
