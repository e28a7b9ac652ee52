"""Night-light stack: log medians, histogram floors, noise masks and cluster rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_radiance(v: Column, scale: float = 1e9) -> Column:
    return F.log1p(F.greatest(v, F.lit(0.0)) * scale)


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin, edge, n): counts in bins 1 to `bins` of [low, high], the last closed; values outside are left out."""
    inside = df.where(F.col(value).between(low, high))
    b = F.least(F.expr(f"width_bucket({value}, {low}D, {high}D, {bins})"), F.lit(bins).cast("long"))
    h = inside.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return h.withColumn("edge", low + (F.col("bin") - 1) * (high - low) / bins)


def noise_floor(hist: DataFrame, keys: list[str], sigmas: float, plus: float = 0.0) -> DataFrame:
    """(keys, peak, sigma, floor): the fullest bin's left edge, the first of equals, plus so many deviations."""
    n, edge = F.col("n"), F.col("edge")
    mean = F.sum(edge * n) / F.sum(n)
    s = hist.groupBy(*keys).agg(F.max_by("edge", F.struct("n", -F.col("bin"))).alias("peak"), F.sqrt(F.greatest(F.sum(edge * edge * n) / F.sum(n) - mean * mean, F.lit(0.0))).alias("sigma"))
    return s.withColumn("floor", F.col("peak") + sigmas * F.col("sigma") + plus)


def stretch(df: DataFrame, keys: list[str], value: str = "v", low: float = 0.05, high: float = 0.99, gamma: float = 2.2) -> DataFrame:
    """Positive values between two percentiles to 0..255 by a gamma curve; 0 where the raster is flat or not positive."""
    limits = df.where(F.col(value) > 0).groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("lo"), F.percentile(value, F.lit(high)).alias("hi"))
    t = F.least(F.greatest((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    lit = (F.col(value) > 0) & (F.col("hi") - F.col("lo") >= 1e-4)
    return df.join(limits, keys, "left").withColumn("byte", F.when(lit, F.floor(F.round(255 * F.pow(t, 1 / gamma), 6))).otherwise(F.lit(0)).cast("long")).drop("lo", "hi")


def sigmoid(df: DataFrame, keys: list[str], value: str = "v", k: float = 25, mid: float = 0.4) -> DataFrame:
    w = Window.partitionBy(*keys)
    span = F.max(value).over(w) - F.min(value).over(w)
    t = F.when(span >= 1e-4, (F.col(value) - F.min(value).over(w)) / span)
    return df.withColumn("sigmoid", F.when(t.isNotNull(), 1 / (1 + F.exp(-k * (t - mid)))).otherwise(F.lit(0.0)))


def entropy(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    h = histogram(df, keys, value, low, high, bins)
    p = F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) + eps)
    return h.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2(F.col("p") + eps))).alias("entropy"))


def thresholds(tundra: Column) -> list[Column]:
    """Stripe, grain and fog limits and the safe percentile, gentler where a tile has no tundra."""
    values = {"stripe": (2.8, 4.5), "grain": (2.2, 3.0), "fog": (0.15, 0.05), "p_safe": (99.5, 99.0)}
    return [F.when(tundra, F.lit(a)).otherwise(F.lit(b)).alias(k) for k, (a, b) in values.items()]


def noise_masks(sx: Column, sy: Column, lap: Column, v: Column, stripe: Column, grain: Column, fog: Column, limit: Column, steep: float = 0.2) -> dict[str, Column]:
    return {
        "stripe_mask": (F.abs(sx) / (F.abs(sy) + 1e-6) > stripe) & (F.abs(sx) > steep),
        "grain_mask": (F.abs(lap) > grain) & (v < limit),
        "fog_mask": (F.abs(lap) < fog) & (v > 0),
    }


def cluster_stats(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Area, box, mean, deviation, maximum and peakiness of each labelled cluster."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("most"),
    ).withColumn("peak", F.col("most") / (F.col("mean") + 1e-6))


def kill(biome: Column, area: Column, std: Column, peak: Column, entropy_: Column, truth: Column, flat: float = 1.5, flat_area: int = 100) -> Column:
    """Whether a cluster is noise: flat and large, or by biome unstructured or peakless; truth protects it."""
    noise = ((std < flat) & (area > flat_area)) | ((biome == 2) & ((entropy_ < 0.8) | (peak < 1.4))) | ((biome == 4) & (peak < 1.3))
    return noise & ~(truth > 0.1)
