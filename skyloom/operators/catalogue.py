"""Granule catalogues: newest and complete sets, pairing, chunks, digests, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_bucket(df: DataFrame, by: list[str], bucket: Column, value: str, order: list[str]) -> DataFrame:
    """Of each group's newest bucket the row that comes last by `order`, in one aggregation."""
    best = F.max(F.struct(bucket.alias("bucket"), *order, value)).alias("best")
    return df.groupBy(*by).agg(best).select(*by, "best.bucket", f"best.{value}")


def complete_slots(df: DataFrame, by: list[str], slot: str, part: str, parts: int) -> DataFrame:
    """Each group's newest slot with as many different parts, and its parts in order."""
    sets = df.groupBy(*by, slot).agg(F.array_sort(F.collect_set(part)).alias("parts")).where(F.size("parts") == parts)
    newest = F.max(F.struct(slot, "parts")).alias("m")
    return sets.groupBy(*by).agg(newest).select(*by, f"m.{slot}", "m.parts")


def pair(files: DataFrame, is_data: Column, key: str, value: str, limit: int | None = None) -> DataFrame:
    """(key, data, geo): the smallest name of each kind for every key that has both, newest keys first; one aggregation."""
    out = files.groupBy(key).agg(F.min(F.when(is_data, F.col(value))).alias("data"), F.min(F.when(~is_data, F.col(value))).alias("geo"))
    out = out.where("data is not null and geo is not null")
    return out.orderBy(F.col(key).desc()).limit(limit) if limit else out


def chunks(df: DataFrame, by: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Whole runs of `size` values in order within each group; what is left over is dropped, as the feature asks."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    numbered = df.withColumn("_r", rank).withColumn("chunk", F.expr(f"_r div {size}"))
    made = numbered.groupBy(*by, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda s: s[value]).alias("items"))
    return made.where(F.size("items") == size)


def digest(df: DataFrame, by: list[str], name: Column, modified: Column) -> DataFrame:
    """md5 over a group's sorted name_time entries."""
    entry = F.concat_ws("_", name, modified)
    return df.groupBy(*by).agg(F.md5(F.array_join(F.array_sort(F.collect_list(entry)), "")).alias("digest"), F.count("*").alias("files"))


def stale(df: DataFrame, as_of: str, ttl_seconds: int, modified: str = "last_modified") -> DataFrame:
    return df.where(F.expr(f"unix_timestamp(timestamp '{as_of}') - unix_timestamp({modified}) > {ttl_seconds}"))


def dates(spark, as_of: str, offset: int, depth: int) -> DataFrame:
    """The `depth` days that end `offset` days before as_of, newest first by `age`."""
    return spark.range(depth).selectExpr("cast(id as int) age", f"date_sub(date '{as_of}', {offset} + cast(id as int)) day")
