"""Points, polygons and outlines: spatial join by cells, ordered node lookup, labels, packed records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def point_in_polygon(points: DataFrame, polygons: DataFrame, size: float = 10.0) -> DataFrame:
    """All (point columns, polygon columns) with the point inside the ring.

    Polygons are dealt to the grid cells their box meets, points to their one cell, so the join is on cells; the box
    and an even-odd crossing count over the ring's edges decide. A point on an edge belongs to the lower-left side.
    """
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    box = polygons.select("*", F.array_min(lons).alias("x0"), F.array_max(lons).alias("x1"), F.array_min(lats).alias("y0"), F.array_max(lats).alias("y1"))
    dealt = box.withColumn("_cx", cells(F.col("x0"), F.col("x1"), size)).withColumn("_cy", cells(F.col("y0"), F.col("y1"), size))
    near = points.withColumn("_cx", F.floor(F.col("lon") / size)).withColumn("_cy", F.floor(F.col("lat") / size)).join(dealt, ["_cx", "_cy"])
    near = near.where("lon between x0 and x1 and lat between y0 and y1")

    def crossing(a: Column, i: Column) -> Column:
        b = F.get("ring", (i + 1) % F.size("ring"))
        spans = (a["lat"] > F.col("lat")) != (b["lat"] > F.col("lat"))
        x = a["lon"] + (F.col("lat") - a["lat"]) * (b["lon"] - a["lon"]) / F.when(spans, b["lat"] - a["lat"])
        return F.when(spans & (F.col("lon") < x), 1).otherwise(0)

    hits = F.aggregate(F.transform("ring", crossing), F.lit(0), lambda s, c: s + c)
    return near.where(hits % 2 == 1).drop("_cx", "_cy", "x0", "x1", "y0", "y1")


def ordered_nodes(ways: DataFrame, nodes: DataFrame, lon0: float, lat0: float, least: int = 3) -> DataFrame:
    """(way, n, found, verts): each way's nodes as local metres in their order; missing ones are left out and not counted."""
    from ..functions.geo import local_offset

    x, y = local_offset(F.col("lon"), F.col("lat"), F.lit(lon0), F.lit(lat0))
    spread = ways.where(F.size("nodes") >= least).select("way", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node"))
    met = spread.join(nodes.select("node", F.round(x, 3).alias("x"), F.round(y, 3).alias("y")), "node", "left")
    verts = F.transform(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("pos", "x", "y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return met.groupBy("way", "n").agg(verts.alias("verts")).select("way", "n", F.size("verts").alias("found"), "verts")


def height(tag_height: Column, levels: Column, per_level: float = 3.5) -> Column:
    """The height tag, else levels, else one level; unreadable values count as missing."""
    return F.coalesce(tag_height.try_cast("double"), F.coalesce(levels.try_cast("double"), F.lit(1.0)) * per_level)


def pack_buildings(df: DataFrame) -> DataFrame:
    """(way, packed): little-endian uint16 count, float32 height, uint8 material and roof, then float32 pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = [struct.pack("<HfBB", len(v), h, m, r) + b"".join(struct.pack("<ff", p["x"], p["y"]) for p in v) for v, h, m, r in zip(b["verts"], b["height"], b["material"], b["roof"], strict=True)]
            yield pd.DataFrame({"way": b["way"], "packed": packed})

    return df.select("way", "verts", "height", "material", "roof").mapInPandas(run, "way long, packed binary")


def clip_box(ring: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    """A ring cut to a box, side by side; empty if nothing is left."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out: list[tuple[float, float]] = []
        for k, here in enumerate(ring):
            back = ring[k - 1]
            a, b = sign * (back[axis] - limit), sign * (here[axis] - limit)
            if (a < 0) != (b < 0):
                t = a / (a - b)
                out.append((back[0] + t * (here[0] - back[0]), back[1] + t * (here[1] - back[1])))
            if b >= 0:
                out.append(here)
        ring = out
    return ring


def clipped(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(zone, n, area): vertices and area of each ring within a box; rings outside are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for zone, ring in zip(b["zone"], b["ring"], strict=True):
                cut = clip_box([(p["lon"], p["lat"]) for p in ring], *box)
                if len(cut) >= 3:
                    area = abs(sum(cut[k - 1][0] * c[1] - c[0] * cut[k - 1][1] for k, c in enumerate(cut))) / 2
                    rows.append((zone, len(cut), round(area, 6)))
            yield pd.DataFrame(rows, columns=["zone", "n", "area"])

    return df.select("zone", "ring").mapInPandas(run, "zone int, n int, area double")


def face_buckets(df: DataFrame, order: list[str]) -> DataFrame:
    """(face, points, uv): each face's vertices as one flat list in order.

    A face's list is one value of an export record; use it per request box, not over a whole world.
    """
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, "u", "v"))), lambda s: F.array(s["u"], s["v"])))
    return df.groupBy("face").agg(F.count("*").alias("points"), flat.alias("uv"))


def expand_vertices(meshes: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh, data): indexed vertices laid out one after another as (x, y, z, u, v) each."""
    spread = meshes.select("mesh", F.posexplode("indices").alias("pos", "vertex"))
    joined = spread.join(vertices, ["mesh", "vertex"])
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z", "u", "v"))), lambda s: F.array(s["x"], s["y"], s["z"], s["u"], s["v"])))
    return joined.groupBy("mesh").agg(flat.alias("data"))
