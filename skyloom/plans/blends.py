"""Blend queries over the ordered layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blends as op
from ..registry import query
from ..sources.views import layers

_FOLD = "list_reduce(list({{'v': v, 'a': alpha}} ORDER BY seq), lambda s, e: {{'v': CASE WHEN s.v > {t} THEN e.v * e.a + s.v * (1 - e.a) ELSE e.v END, 'a': 0.0::DOUBLE}}, {{'v': 0.0::DOUBLE, 'a': 0.0::DOUBLE}}).v"


@query("smart_blend", f"SELECT y, x, round({_FOLD.format(t=100)}, 8) AS v FROM layers GROUP BY 1, 2", "layers")
def smart_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.smart_blend(layers(spark, sf_dir), ["y", "x"], 100).select("y", "x", F.round("v", 8).alias("v"))


@query("smart_blend_low", f"SELECT y, x, round({_FOLD.format(t=241.377)}, 8) AS v FROM layers GROUP BY 1, 2", "layers")
def smart_blend_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold within the data, so weak backgrounds are overwritten."""
    return op.smart_blend(layers(spark, sf_dir), ["y", "x"], 241.377).select("y", "x", F.round("v", 8).alias("v"))


@query("overwrite_blend", "SELECT y, x, arg_max(v, seq) AS v FROM layers GROUP BY 1, 2", "layers")
def overwrite_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.overwrite_blend(layers(spark, sf_dir), ["y", "x"])


@query("valid_kelvin", "SELECT seq, y, x, v FROM layers WHERE v > 160 AND v < 235", "layers")
def valid_kelvin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).where("not isnan(v) and v > 160 and v < 235").select("seq", "y", "x", "v")


@query("coverage", "SELECT seq, count(*) FILTER (v > 235) AS covered, round(count(*) FILTER (v > 235) / count(*), 6) AS share, count(*) FILTER (v > 235) / count(*) < 0.005 AS abort FROM layers GROUP BY 1", "layers")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.count_if(F.col("v") > 235) / F.count("*")
    return layers(spark, sf_dir).groupBy("seq").agg(F.count_if(F.col("v") > 235).alias("covered"), F.round(share, 6).alias("share"), (share < 0.005).alias("abort"))


_ORDER = (("G19", 1), ("G18", 2), ("H9", 3), ("MSG-Prime", 4), ("MSG-IODC", 5), ("NOAA-20", 6), ("NOAA-21", 7))


@query("source_order", f"SELECT name, seq, count(y) AS cells FROM (VALUES {', '.join(map(str, _ORDER))}) t(name, seq) LEFT JOIN layers USING (seq) GROUP BY 1, 2", "layers")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in the order they are blended, with their cells."""
    dim = spark.createDataFrame(list(_ORDER), "name string, seq int")
    return dim.join(layers(spark, sf_dir), "seq", "left").groupBy("name", "seq").agg(F.count("y").alias("cells"))


@query("cloud_face", f"SELECT y, x, round(CASE WHEN v > 100 THEN pow(least(greatest((276 - v) / 91, 0), 1), 0.7) ELSE 0 END, 4) AS alpha FROM (SELECT y, x, round({_FOLD.format(t=1)}, 6) AS v FROM layers WHERE v > 160 AND v < 330 GROUP BY 1, 2)", "layers")
def cloud_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, blend and opacity in one plan."""
    from ..functions.geo import kelvin_alpha

    d = op.smart_blend(layers(spark, sf_dir).where("v > 160 and v < 330"), ["y", "x"], 1).withColumn("v", F.round("v", 6))
    return d.select("y", "x", F.round(kelvin_alpha(F.col("v")), 4).alias("alpha"))
