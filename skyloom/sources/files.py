"""Readers of files: images, GeoJSON, element dumps, rasters and binary assets, by Spark's own sources.

Text formats are read by Spark's JSON reader, all others as `binaryFile` rows that are decoded in Arrow batches, so files
are spread over executors and nothing passes the driver. A file that cannot be decoded gives an error that names it, or,
with strict=False, a row of nulls.
"""

from __future__ import annotations

import bz2
import io
import struct
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels

#: Large files go to a Python worker one after another.
FILES_AT_A_TIME = 4


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def decoded(found: DataFrame, decode: Callable[[bytes], dict], schema: str, strict: bool = True) -> DataFrame:
    """(path, schema's columns): decode of each file's content."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), FILES_AT_A_TIME):
                rows = []
                for path, content in batch.iloc[at : at + FILES_AT_A_TIME].itertuples(index=False):
                    try:
                        rows.append({"path": path} | decode(bytes(content)))
                    except Exception as e:
                        if strict:
                            raise ValueError(f"{path}: {e}") from e
                        rows.append({"path": path} | dict.fromkeys(names))
                yield pd.DataFrame(rows, columns=["path", *names])

    return found.select("path", "content").mapInPandas(run, f"path string, {schema}")


def images(spark: SparkSession, path: str, gray: bool = False) -> DataFrame:
    """(path, height, width, y, x, red, green, blue) or, gray, (..., v): a row for each pixel of PNG, JPEG, GIF or BMP images
    (by Spark's image source); gray is 0.299, 0.587 and 0.114 of the bands. Alpha is left out."""
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*").where("height > 0")
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") * F.col("width") - 1)).alias("i")
    byte = lambda k: F.conv(F.hex(F.substring("data", (F.col("i") * F.col("nChannels") + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    px = i.select(F.col("origin").alias("path"), "height", "width", "nChannels", "data", place)
    blue, green, red = byte(0), F.when(F.col("nChannels") > 1, byte(1)).otherwise(byte(0)), F.when(F.col("nChannels") > 2, byte(2)).otherwise(byte(0))
    px = px.select("path", "height", "width", F.expr("cast(i div width as int) y"), F.expr("cast(i % width as int) x"), red.alias("red"), green.alias("green"), blue.alias("blue"))
    return px.select("path", "height", "width", "y", "x", F.round(0.299 * F.col("red") + 0.587 * F.col("green") + 0.114 * F.col("blue")).cast("int").alias("v")) if gray else px


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, properties, ring): the outer rings of the features' polygons; a missing file or folder gives no rows."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    try:
        rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("path"), F.explode("features").alias("f"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, name string, properties map<string, string>, ring array<struct<lon: double, lat: double>>")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))).when(
        F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    )
    rows = rows.select("path", F.col("f.properties").alias("properties"), F.explode(polygons).alias("p"))
    hints = F.coalesce(*[F.col("properties")[k] for k in ("shapeName", "NAME", "name", "ADMIN")], F.lit("Unknown"))
    return rows.select("path", hints.alias("name"), "properties", F.transform(F.col("p")[0], lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"))).alias("ring"))


def elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, lon, lat) and ways (way, nodes, tags) of element dumps {"elements": [...]}."""
    element = "type: string, id: bigint, lon: double, lat: double, nodes: array<bigint>, tags: map<string, string>"
    rows = spark.read.schema(f"elements array<struct<{element}>>").option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    ways = rows.where("type = 'way' and size(nodes) >= 3 and tags is not null").select(F.col("id").alias("way"), "nodes", "tags")
    return rows.where("type = 'node'").select(F.col("id").alias("node"), "lon", "lat"), ways


def tiff(content: bytes) -> dict:
    """Height, width and values of the first image of an uncompressed TIFF of one band, in strips."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    (at,) = struct.unpack(f"{order}I", content[4:8])
    (n,) = struct.unpack(f"{order}H", content[at : at + 2])
    sizes, tags = {1: "B", 2: "c", 3: "H", 4: "I"}, {}
    for k in range(n):
        tag, kind, count = struct.unpack(f"{order}HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in sizes:
            continue
        size, place = struct.calcsize(sizes[kind]) * count, at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack(f"{order}I", content[place : place + 4])
        tags[tag] = struct.unpack(f"{order}{count}{sizes[kind]}", content[place : place + size])
    if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
        raise ValueError("compressed or of several bands")
    form = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(tags[258][0] // 8)
    data = b"".join(content[a : a + b] for a, b in zip(tags[273], tags[279], strict=True))
    return {"height": tags[257][0], "width": tags[256][0], "v": np.frombuffer(data, dtype=order + form).astype(float)}


def elevation(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, y, x, v) of uncompressed TIFF rasters."""
    return _pixels(decoded(files(spark, path, "*.tif*"), tiff, "height int, width int, v array<double>"))


def _pixels(rasters: DataFrame) -> DataFrame:
    px = rasters.select("path", "height", "width", F.posexplode("v").alias("i", "v"))
    return px.select("path", "height", "width", F.expr("cast(i div width as int) y"), F.expr("cast(i % width as int) x"), "v")


def rgba_faces(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, y, x, red, green, blue, alpha) of raw square RGBA faces; a file of another length is an error."""
    faces = decoded(files(spark, path), lambda c: {"v": kernels.raw_rgba(c, size).reshape(-1, 4).astype("int32").tolist()}, "v array<array<int>>")
    px = faces.select("path", F.posexplode("v").alias("i", "v"))
    return px.select("path", F.expr(f"cast(i div {size} as int) y"), F.expr(f"cast(i % {size} as int) x"), *[F.col("v")[k].alias(c) for k, c in enumerate(("red", "green", "blue", "alpha"))])


def tables(spark: SparkSession, path: str, *shape: int) -> DataFrame:
    """(path, i, v) of look-up tables of 32-bit floats in row-major order; the length must fit the shape."""
    return decoded(files(spark, path, "*.bin"), lambda c: {"v": kernels.lut(c, *shape).ravel().astype(float)}, "v array<double>").select("path", F.posexplode("v").alias("i", "v"))


def textures(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, format, payload) of KTX 1 files."""

    def decode(content: bytes) -> dict:
        return dict(zip(("width", "height", "format", "payload"), kernels.ktx_payload(content), strict=True))

    return decoded(files(spark, path, "*.ktx"), decode, "width int, height int, format int, payload binary")


def accessors(buffers: DataFrame) -> DataFrame:
    """(mesh, name, i, item): elements of rows (mesh, name, buffer, offset, count, component, shape, stride), as the public
    glTF layout has them; stride 0 is packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                items = kernels.accessor(bytes(r.buffer), r.offset, r.count, r.component, r.shape, r.stride)
                yield pd.DataFrame({"mesh": r.mesh, "name": r.name, "i": np.arange(len(items)), "item": items.astype(float).tolist()})

    return buffers.select("mesh", "name", "buffer", "offset", "count", "component", "shape", "stride").mapInPandas(run, "mesh string, name string, i long, item array<double>")


def zip_member(found: DataFrame, suffix: str) -> DataFrame:
    """(path, member, content): the first member by name with the suffix; nulls where an archive has none."""

    def pick(content: bytes) -> dict:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = min((n for n in z.namelist() if n.endswith(suffix)), default=None)
            return {"member": name, "content": z.read(name) if name else None}

    return decoded(found, pick, "member string, content binary")


def unpacked(found: DataFrame) -> DataFrame:
    """(path, content) of bz2 files, the suffix left out of the path; other files as they are."""
    out = decoded(found, lambda c: {"content": bz2.decompress(c) if c[:3] == b"BZh" else c}, "content binary")
    return out.withColumn("path", F.regexp_replace("path", r"\.bz2$", ""))
