"""Ordered blends of overlapping layers (non-commutative, so the order is a column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smart_blend(df: DataFrame, keys: list[str], threshold: float, seq: str = "seq", value: str = "v", alpha: str = "alpha") -> DataFrame:
    """Layer after layer: new * alpha + background * (1 - alpha) where the background exceeds the threshold, else new."""
    layers = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"), F.col(alpha).alias("a"))))
    fold = F.aggregate("layers", F.lit(0.0), lambda bg, e: F.when(bg > threshold, e["v"] * e["a"] + bg * (1 - e["a"])).otherwise(e["v"]))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(layers.alias("layers")).select(*keys, fold.alias("v"))


def overwrite_blend(df: DataFrame, keys: list[str], seq: str = "seq", value: str = "v") -> DataFrame:
    """The last layer that has a value."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, seq).alias("v"))
