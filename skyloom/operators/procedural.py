"""Procedural noise: jittered cells, Worley distance on a torus, Fibonacci sphere points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hashed(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) from whole numbers: md5's first 8 hex digits, alike in any engine."""
    text = F.concat_ws(",", F.lit(str(seed)), *[c.cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def cell_points(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """One point in each of n^3 cells of the unit cube; idx counts x fastest."""
    c = spark.range(n**3).selectExpr("id idx", f"cast(id % {n} as int) ix", f"cast(id div {n} % {n} as int) iy", f"cast(id div {n * n} as int) iz")
    return c.select("idx", "ix", "iy", "iz", *[((F.col(f"i{a}") + hashed(seed + k, F.col("idx"))) / n).alias(f"p{a}") for k, a in enumerate("xyz")])


def worley(samples: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """(sample columns, f1): distance to the nearest point on the torus, looked up in the 27 cells around."""
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])).alias("o")
    at = samples.select("*", offsets)
    for axis, k in zip("xyz", "abc", strict=True):
        cell = F.floor(F.col(axis) * n) + F.col(f"o.{k}")
        at = at.withColumn(f"i{axis}", F.pmod(cell, F.lit(n)).cast("int")).withColumn(f"s{axis}", F.floor(cell / n))
    d = sum(((F.col(f"p{a}") + F.col(f"s{a}") - F.col(a)) * (F.col(f"p{a}") + F.col(f"s{a}") - F.col(a)) for a in "yz"), (F.col("px") + F.col("sx") - F.col("x")) * (F.col("px") + F.col("sx") - F.col("x")))
    return at.join(points.drop("idx"), ["ix", "iy", "iz"]).groupBy(*samples.columns).agg(F.sqrt(F.min(d)).alias("f1"))


def fibonacci_sphere(spark: SparkSession, n: int, jitter: float = 0.0, seed: int = 7) -> DataFrame:
    """(i, x, y, z): n points turned by the golden angle, moved in or out by up to `jitter` of the radius."""
    i = F.col("id")
    y = 1 - 2 * (i + 0.5) / n
    r, theta = F.sqrt(F.greatest(1 - y * y, F.lit(0.0))), i * (math.pi * (3 - math.sqrt(5)))
    scale = 1 + jitter * (2 * hashed(seed, i) - 1)
    return spark.range(n).select(i.alias("i"), (scale * r * F.cos(theta)).alias("x"), (scale * y).alias("y"), (scale * r * F.sin(theta)).alias("z"))


def basis(x: Column, y: Column, z: Column) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Two unit vectors across a unit normal: up x normal (x axis instead of up near the poles), and normal x that."""
    pole = F.abs(y) > 0.99
    ax, ay = F.when(pole, 1.0).otherwise(0.0), F.when(pole, 0.0).otherwise(1.0)
    tx, ty, tz = ay * z, -ax * z, ax * y - ay * x
    n = F.greatest(F.sqrt(tx * tx + ty * ty + tz * tz), F.lit(1e-12))
    tx, ty, tz = tx / n, ty / n, tz / n
    return (tx, ty, tz), (y * tz - z * ty, z * tx - x * tz, x * ty - y * tx)


def dither(value: Column, *place: Column, seed: int = 3) -> Column:
    """Triangular noise of a 255th by place (tile, y and x), the same on every run."""
    return value + (hashed(seed, *place) - hashed(seed + 1, *place)) / 255
