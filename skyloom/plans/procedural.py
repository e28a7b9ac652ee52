"""Procedural queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import procedural as op
from ..registry import query

#: Cells and samples an axis.
N, S = 8, 64


def _hash(seed: int, *ids: str) -> str:
    return f"('0x' || substr(md5(concat_ws(',', '{seed}', {', '.join(ids)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


_POINTS = f"""p AS (SELECT i AS idx, (i % {N})::INT AS ix, (i // {N} % {N})::INT AS iy, (i // {N * N})::INT AS iz, (i % {N} + {_hash(1, "i")}) / {N} AS px, (i // {N} % {N} + {_hash(2, "i")}) / {N} AS py, (i // {N * N} + {_hash(3, "i")}) / {N} AS pz FROM range({N**3}) r(i))"""
# the distance to every point on the torus, not by cells
_WORLEY = f"""s AS (SELECT i, (i % {S} + 0.5) / {S} AS x, (i // {S} % {S} + 0.5) / {S} AS y, (i // {S * S} + 0.5) / {S} AS z FROM range({S**3}) r(i)),
  f AS (SELECT i, sqrt(min(pow(least(abs(x - px), 1 - abs(x - px)), 2) + pow(least(abs(y - py), 1 - abs(y - py)), 2) + pow(least(abs(z - pz), 1 - abs(z - pz)), 2))) AS f1 FROM s CROSS JOIN p GROUP BY 1)"""


def _samples(spark: SparkSession, s: int = S) -> DataFrame:
    return spark.range(s**3).select(F.col("id").alias("i"), ((F.col("id") % s + 0.5) / s).alias("x"), ((F.expr(f"id div {s} % {s}") + 0.5) / s).alias("y"), ((F.expr(f"id div {s * s}") + 0.5) / s).alias("z"))


@query("jitter_points", f"WITH {_POINTS} SELECT idx, ix, iy, iz, round(px, 9) AS px, round(py, 9) AS py, round(pz, 9) AS pz FROM p")
def jitter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cell_points(spark, N).select("idx", "ix", "iy", "iz", *[F.round(c, 9).alias(c) for c in ("px", "py", "pz")])


@query("worley", f"WITH {_POINTS}, {_WORLEY} SELECT i, round(f1, 6) AS f1 FROM f")
def worley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.worley(_samples(spark), op.cell_points(spark, N), N).select("i", F.round("f1", 6).alias("f1"))


@query("worley_volume", f"WITH {_POINTS}, {_WORLEY} SELECT i, round(1 - least(greatest(f1 * {N}, 0), 1), 6) AS v FROM f")
def worley_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted, so cells are bright at their points."""
    f = op.worley(_samples(spark), op.cell_points(spark, N), N)
    return f.select("i", F.round(1 - F.least(F.greatest(F.col("f1") * N, F.lit(0.0)), F.lit(1.0)), 6).alias("v"))


_FIB = f"""f AS (SELECT i, k * sqrt(greatest(1 - y * y, 0)) * cos(i * (pi() * (3 - sqrt(5.0)))) AS x, k * y AS y, k * sqrt(greatest(1 - y * y, 0)) * sin(i * (pi() * (3 - sqrt(5.0)))) AS z
  FROM (SELECT i, 1 - 2 * (i + 0.5::DOUBLE) / 500 AS y, 1 + 0.05 * (2 * ({_hash(7, "i")}) - 1) AS k FROM range(500) r(i)))"""


@query("fibonacci_sphere", f"WITH {_FIB} SELECT i, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM f")
def fibonacci_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fibonacci_sphere(spark, 500, 0.05).select("i", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("min_max_component", f"WITH {_FIB} SELECT i, round(least(x, y, z), 6) AS low, round(greatest(x, y, z), 6) AS high FROM f")
def min_max_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fibonacci_sphere(spark, 500, 0.05).select("i", F.round(F.least("x", "y", "z"), 6).alias("low"), F.round(F.greatest("x", "y", "z"), 6).alias("high"))


@query("normal_basis", f"""WITH {_FIB}, u AS (SELECT i, x / r AS x, y / r AS y, z / r AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM f)),
  t AS (SELECT *, CASE WHEN abs(y) > 0.99 THEN 0 ELSE z END AS a, CASE WHEN abs(y) > 0.99 THEN -z ELSE 0 END AS b, CASE WHEN abs(y) > 0.99 THEN y ELSE -x END AS c FROM u)
  SELECT i, round(a / sqrt(a * a + b * b + c * c), 6) AS tx, round(b / sqrt(a * a + b * b + c * c), 6) AS ty, round(c / sqrt(a * a + b * b + c * c), 6) AS tz,
    round((y * c - z * b) / sqrt(a * a + b * b + c * c), 6) AS bx, round((z * a - x * c) / sqrt(a * a + b * b + c * c), 6) AS by, round((x * b - y * a) / sqrt(a * a + b * b + c * c), 6) AS bz FROM t""")
def normal_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = op.fibonacci_sphere(spark, 500, 0.05).withColumn("r", F.sqrt(F.expr("x * x + y * y + z * z")))
    u = f.select("i", *[(F.col(c) / F.col("r")).alias(c) for c in "xyz"])
    t, b = op.basis(F.col("x"), F.col("y"), F.col("z"))
    return u.select("i", *[F.round(c, 6).alias(f"t{a}") for a, c in zip("xyz", t, strict=True)], *[F.round(c, 6).alias(f"b{a}") for a, c in zip("xyz", b, strict=True)])
