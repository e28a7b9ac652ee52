"""Rasters, stacks, points, polygons, granules and camera tracks derived from the star-schema tables.

Definitions are integer arithmetic or sums rounded to 6 places, so any engine gives the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB stack (tile_r, tile_c, frame, y, x, red, green, blue); frame is a month number, (0, 0, 0) is missing."""
    li = read(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey % 10 as int) tile_r", "cast(l_partkey % 20 as int) tile_c", "(year(l_shipdate) - 1990) * 12 + month(l_shipdate) frame",
        "cast(l_orderkey div 2 % 2 as int) y", "cast(l_orderkey % 2 as int) x",
        "if(l_discount = 0 and l_tax = 0, 0, l_quantity * 5) r", "if(l_discount = 0 and l_tax = 0, 0, l_discount * 2500) g", "if(l_discount = 0 and l_tax = 0, 0, l_tax * 3000) b",
    )
    return li.groupBy("tile_r", "tile_c", "frame", "y", "x").agg(*[F.floor(F.round(F.avg(c), 6)).cast("double").alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))])


def patch_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 rasters (tile, biome, y, x, v) from embeddings; biome 0 is ocean, 2 tundra, 3 desert, 4 tropical."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile"), (F.col("label") % 5).alias("biome"), F.posexplode("embedding").alias("pos", "v"))
    return e.selectExpr("tile", "cast(biome as int) biome", "cast(pos div 8 as int) y", "cast(pos % 8 as int) x", "round(cast(v as double), 6) v")


def grid_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse 10 x 64 raster (y, x, v); v is null in a fixed pattern."""
    li = read(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey % 10 as int) y", "cast(l_partkey % 64 as int) x", "l_quantity")
    g = li.groupBy("y", "x").agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    return g.withColumn("v", F.expr("if((y * 31 + x * 17) % 5 < 2, null, v)"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered source layers (seq, y, x, v in kelvin, alpha)."""
    li = read(spark, sf_dir, "lineitem").selectExpr("l_linenumber seq", "cast(l_suppkey % 10 as int) y", "cast(l_partkey % 20 as int) x", "l_quantity", "l_discount")
    return li.groupBy("seq", "y", "x").agg(F.round(160 + F.avg("l_quantity") * 3, 6).alias("v"), F.round(F.avg("l_discount") * 10, 6).alias("alpha"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (id, nation, lon, lat, elev)."""
    return read(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_nationkey nation", "(c_custkey * 7919 % 36000) / 100D - 180 lon", "(c_custkey * 104729 % 18000) / 100D - 90 lat", "c_acctbal elev")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons (zone, name, region, ring): a box or a triangle about a centre for each nation."""
    n = read(spark, sf_dir, "nation").selectExpr("n_nationkey zone", "n_name name", "n_regionkey region", "cast(n_nationkey * 53 % 320 - 160 as double) cx", "cast(n_nationkey * 37 % 140 - 70 as double) cy", "10D + n_nationkey % 7 half")
    corner = "named_struct('lon', {}, 'lat', {})"
    low = [corner.format("cx - half", "cy - half"), corner.format("cx + half", "cy - half")]
    box = f"array({', '.join([*low, corner.format('cx + half', 'cy + half'), corner.format('cx - half', 'cy + half')])})"
    triangle = f"array({', '.join([*low, corner.format('cx', 'cy + half')])})"
    return n.selectExpr("zone", "name", "region", "cx", "cy", "half", f"if(zone % 3 = 0, {triangle}, {box}) ring")


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with times (id, product, slot, name, last_modified)."""
    e = read(spark, sf_dir, "events").selectExpr("event_id id", "event_type product", "window(ts, '10 minutes').start slot", "ts + make_interval(0, 0, 0, 0, 0, 0, floor(value)) last_modified")
    return e.selectExpr("id", "product", "slot", "concat(upper(product), '.A', date_format(slot, 'yyyyDDD.HHmm'), '.nc') name", "last_modified")


def camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera states (session, ts, id, yaw, pitch, radius)."""
    return read(spark, sf_dir, "events").selectExpr("user_id session", "ts", "event_id id", "round(value * 7 - 360 * floor(value * 7 / 360), 6) yaw", "round(value - 178 * floor(value / 178) - 89, 6) pitch", "5.2D + (event_id % 198) / 10D radius")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building outlines (way, nodes in order, tags)."""
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey way", "map('building:material', lower(substr(o_orderpriority, 3)), 'roof:shape', o_orderstatus, 'height', if(o_orderkey % 4 = 0, null, cast(o_orderkey % 40 as string)), 'building:levels', if(o_orderkey % 3 = 0, 'x', cast(o_orderkey % 9 as string))) tags")
    refs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(F.expr("transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_extendedprice))), s -> s.l_partkey) nodes"))
    return o.join(refs, "way")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline nodes (node, lon, lat); a fifth are missing."""
    return read(spark, sf_dir, "part").where("p_partkey % 5 <> 4").selectExpr("p_partkey node", "(p_partkey * 7919 % 1000) / 10000D + 2.3 lon", "(p_partkey * 104729 % 1000) / 10000D + 48.8 lat")
