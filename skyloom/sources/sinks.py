"""Sinks: encoded tiles as rows or files, and caches partitioned by key."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the signature and the colour types (by number of bands) of the PNG specification
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_COLOUR = {1: 0, 2: 4, 3: 2, 4: 6}


def png(a: np.ndarray) -> bytes:
    """A raster of 8- or 16-bit values, (height, width) or (height, width, bands), as a PNG file."""
    a = a.reshape(*a.shape[:2], -1)
    height, width, bands = a.shape
    depth = 16 if a.dtype == np.uint16 else 8
    rows = a.astype(">u2" if depth == 16 else np.uint8).reshape(height, -1).view(np.uint8)
    lines = np.hstack((np.zeros((height, 1), np.uint8), rows)).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, depth, _COLOUR[bands], 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_payloads(px: DataFrame, keys: list[str], bands: list[str], height: int, width: int, bits: int = 8) -> DataFrame:
    """(keys, png): each tile of pixels (keys, y, x, bands) encoded; missing pixels are 0, values are cut to the range."""
    kind, most = (np.uint16, 65535) if bits == 16 else (np.uint8, 255)
    schema = ", ".join([*(f"`{k}` {px.schema[k].dataType.simpleString()}" for k in keys), "png binary"])

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((height, width, len(bands)), dtype=kind)
        a[p["y"], p["x"]] = np.clip(p[bands].fillna(0).to_numpy(), 0, most)
        return pd.DataFrame([[*key, png(a)]], columns=[*keys, "png"])

    return px.select(*keys, "y", "x", *bands).groupBy(*keys).applyInPandas(run, schema)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content) as files of a folder that all executors share; gives (name, bytes) when it is run.

    A file appears whole, by renaming; attempts of one task write the same bytes. Names that repeat overwrite each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in batch.itertuples(index=False):
                part = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(bytes(content))
                fs.move(part, f"{root}/{name}")
            yield pd.DataFrame({"name": batch["name"], "bytes": batch["content"].map(len)})

    return rows.select("name", "content").mapInPandas(run, "name string, bytes long")


def tile_names(rows: DataFrame, row: str = "tile_r", column: str = "tile_c", suffix: str = "png") -> DataFrame:
    return rows.withColumn("name", F.concat_ws("_", F.lit("tile"), row, F.concat(F.col(column).cast("string"), F.lit(f".{suffix}"))))


def save_cache(layers: DataFrame, folder: str, keys: list[str]) -> None:
    """Replace the partitions of a cache (Parquet by key) that layers have rows of; others stay."""
    layers.repartition(*keys).write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def load_cache(spark: SparkSession, folder: str, **keys: object) -> DataFrame:
    """The cached rows of some keys; only their partitions are read."""
    out = spark.read.parquet(folder)
    for name, value in keys.items():
        out = out.where(F.col(name) == F.lit(value))
    return out
