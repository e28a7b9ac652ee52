"""Temporal composites of image stacks: frame gates, best-pixel selection, medians, exposure and histogram matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ("red", "green", "blue")
TILE, PIXEL = ("tile_r", "tile_c"), ("tile_r", "tile_c", "y", "x")


def missing_to_null(df: DataFrame) -> DataFrame:
    """(0, 0, 0) pixels become null in every band."""
    gone = (F.col("red") == 0) & (F.col("green") == 0) & (F.col("blue") == 0)
    return df.select(*[c if c not in BANDS else F.when(~gone, F.col(c)).alias(c) for c in df.columns])


def strip_artifacts(df: DataFrame, low: float = 1, high: float = 250) -> DataFrame:
    """Pixels with all bands under low or all over high become null."""
    gone = (F.greatest(*BANDS) < low) | (F.least(*BANDS) > high)
    return df.select(*[c if c not in BANDS else F.when(~gone, F.col(c)).alias(c) for c in df.columns])


def median_fill(df: DataFrame) -> DataFrame:
    """Null bands take the pixel's temporal median; a pixel null in every frame becomes 0."""
    medians = df.groupBy(*PIXEL).agg(*[F.median(b).alias(f"m_{b}") for b in BANDS])
    return df.join(medians, list(PIXEL)).select(*[c if c not in BANDS else F.coalesce(F.col(c), F.col(f"m_{c}"), F.lit(0.0)).alias(c) for c in df.columns])


def pixel_score(r: Column, g: Column, b: Column) -> Column:
    """Brightness less saturation and blue haze; the lowest is the clearest land."""
    return (r + g + b) / 3 - 2 * (F.greatest(r, g, b) - F.least(r, g, b)) - 1.5 * (b - r)


def frame_stats(df: DataFrame) -> DataFrame:
    """For each tile and frame: mean and population variance over pixels and bands, band means, their spread."""
    n, total = F.count("*") * 3, F.sum(F.col("red") + F.col("green") + F.col("blue"))
    square = F.sum(F.col("red") * F.col("red") + F.col("green") * F.col("green") + F.col("blue") * F.col("blue"))
    s = df.groupBy(*TILE, "frame").agg((total / n).alias("mean"), (square / n - (total / n) * (total / n)).alias("var"), *[F.avg(b).alias(f"mean_{b}") for b in BANDS])
    means = [F.col(f"mean_{b}") for b in BANDS]
    s = s.withColumn("sat", F.greatest(*means) - F.least(*means))
    return s.select(*TILE, "frame", *[F.round(c, 6).alias(c) for c in ("mean", "var", "mean_red", "mean_green", "mean_blue", "sat")])


def is_cloud(mean: float = 190, var: float = 20, tint: float = 8) -> Column:
    """A bright, flat, colourless frame."""
    return (F.col("mean") > mean) & (F.col("var") < var) & (F.abs(F.col("mean_red") - F.col("mean_green")) < tint) & (F.abs(F.col("mean_red") - F.col("mean_blue")) < tint)


def is_mist(mean: float = 160, sat: float = 15) -> Column:
    return (F.col("mean") > mean) & (F.col("sat") < sat)


def keep_frames(gated: DataFrame, least: float = 0.85) -> DataFrame:
    """Frames not rejected, or all of a tile's where fewer than the share `least` would remain; column reject decides."""
    sums = gated.groupBy(*TILE).agg(F.count("*").alias("n"), F.count_if(~F.col("reject")).alias("good"))
    joined = gated.join(sums, list(TILE))
    return joined.withColumn("all", F.col("good") < F.floor(least * F.col("n"))).where(F.col("all") | ~F.col("reject")).select(*gated.columns, F.when(F.col("all"), F.col("n")).otherwise(F.col("good")).alias("kept"))


def best_k(df: DataFrame, kept: DataFrame, most: int = 20, least: int = 8, share: float = 0.25, percentile: float = 0.1) -> DataFrame:
    """Per pixel the given percentile of each band over its K lowest-scored frames, K by the tile's kept frames.

    The literal bound lets the rank be cut inside the window operator; K, which varies, filters what is left.
    """
    score = F.round(pixel_score(F.col("red"), F.col("green"), F.col("blue")), 6)
    order = Window.partitionBy(*PIXEL).orderBy("score", "frame")
    ranked = df.join(kept.select(*TILE, "frame", "kept"), [*TILE, "frame"]).withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    k = F.least(F.greatest(F.lit(least), F.floor(share * F.col("kept"))), F.lit(most))
    picked = ranked.where(F.col("rank") <= k)
    return picked.groupBy(*PIXEL).agg(*[F.floor(F.least(F.greatest(F.round(F.percentile(b, F.lit(percentile)), 6), F.lit(0)), F.lit(255))).cast("long").alias(b) for b in BANDS])


def best_pixel(df: DataFrame, **gates: float) -> DataFrame:
    """The whole land composite: fill, gate frames with fallback, best K, percentile."""
    filled = median_fill(missing_to_null(df))
    cloud = is_cloud(**{k[6:]: v for k, v in gates.items() if k.startswith("cloud_")})
    mist = is_mist(**{k[5:]: v for k, v in gates.items() if k.startswith("mist_")})
    return best_k(filled, keep_frames(frame_stats(filled).withColumn("reject", cloud | mist)))


def median_composite(df: DataFrame) -> DataFrame:
    return df.groupBy(*PIXEL).agg(*[F.median(b).alias(b) for b in BANDS])


def scene_composite(df: DataFrame, reference: DataFrame, most: float = 230) -> DataFrame:
    """Median of stripped scenes, the reference where nothing is left, darkened to the reference's exposure."""
    mid = median_composite(strip_artifacts(df))
    ref = reference.select(*PIXEL, *[F.col(b).alias(f"ref_{b}") for b in BANDS])
    none = F.col("red").isNull() & F.col("green").isNull() & F.col("blue").isNull()
    filled = mid.join(ref, list(PIXEL), "left").select(*PIXEL, *[F.coalesce(F.when(none, F.col(f"ref_{b}")).otherwise(F.col(b)), F.lit(0.0)).alias(b) for b in BANDS], *[f"ref_{b}" for b in BANDS])
    means = filled.groupBy(*TILE).agg(F.avg(sum((F.col(b) for b in BANDS[1:]), F.col("red"))).alias("image"), F.avg(sum((F.col(f"ref_{b}") for b in BANDS[1:]), F.col("ref_red"))).alias("ref"))
    ratio = F.when((F.col("image") > 0) & F.col("ref").isNotNull(), F.least(F.greatest(F.col("ref") / F.col("image"), F.lit(0.1)), F.lit(1.0))).otherwise(F.lit(1.0))
    scaled = filled.join(means.select(*TILE, F.coalesce(ratio, F.lit(1.0)).alias("ratio")), list(TILE))
    return scaled.select(*PIXEL, F.round("ratio", 6).alias("ratio"), *[F.floor(F.least(F.greatest(F.round(F.col(b) * F.col("ratio"), 6), F.lit(0)), F.lit(most))).cast("long").alias(b) for b in BANDS])


def cumulative(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, cdf): counts of each value and their running share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return counts.withColumn("cdf", F.sum("n").over(run) / F.sum("n").over(whole))


def match_histogram(source: DataFrame, reference: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, matched): each source value moved to the reference value of the same cumulative share, linearly
    between the reference's steps and clamped at its ends."""
    s = cumulative(source, by, value).select(*by, value, "cdf", F.lit(0).alias("kind"))
    r = cumulative(reference, by, value).select(*by, value, "cdf", F.lit(1).alias("kind"))
    up = Window.partitionBy(*by).orderBy("cdf", "kind")
    step = F.when(F.col("kind") == 1, F.struct(F.col("cdf").alias("c"), F.col(value).alias("v")))
    both = s.unionByName(r)
    # a reference step of the same share sorts behind the source row, so look at or after it upwards
    both = both.withColumn("hi", F.first(step, ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing)))
    both = both.withColumn("lo", F.last(step, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 0")
    line = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (F.col("cdf") - F.col("lo.c")) / (F.col("hi.c") - F.col("lo.c"))
    matched = F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull(), F.col("lo.v")).when(F.col("hi.c") == F.col("cdf"), F.col("hi.v")).otherwise(line)
    return both.select(*by, value, F.round(matched, 6).alias("matched"))


def mosaic(tiles: DataFrame, rows: int, columns: int, size: int) -> DataFrame:
    """All pixels of the canvas, 0 where a tile is missing."""
    spark = tiles.sparkSession
    grid = spark.range(rows * columns * size * size).selectExpr(f"cast(id div {columns * size} as int) gy", f"cast(id % {columns * size} as int) gx")
    placed = tiles.select((F.col("tile_r") * size + F.col("y")).cast("int").alias("gy"), (F.col("tile_c") * size + F.col("x")).cast("int").alias("gx"), *BANDS)
    return grid.join(placed, ["gy", "gx"], "left").na.fill(0, list(BANDS))
