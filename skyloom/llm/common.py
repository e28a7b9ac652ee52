"""Shared helpers: table access, written checkpoints and vectorised word hashing over Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skyloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skyloom/{name}-{uuid.uuid4().hex}"


CLEANUP, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


def saved(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing. The shuffles that
    made it are freed at once. rows: at most so many go to a Python worker at a time, where they are large."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    wanted = {CLEANUP: "true"} | ({BATCH: str(rows)} if rows else {})
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that are done with."""
    for t in tables:
        spark = t.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def valid(column: str) -> Column:
    """A text column for Python: bytes that are no UTF-8, which Spark lets by, become U+FFFD."""
    return F.make_valid_utf8(F.col(column))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- vectorised words -------------------------------------------------------------------------

_rng = np.random.default_rng(20240611)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_BYTE = np.where(_WORD, _TABLE[_LOW], U64(0))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U64(base), dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows with about `limit` bytes; a longer row is a run of its own."""
    data, offsets = utf8(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and 64-bit hash of each word [^\\x20\\x09-\\x0D]+ in order, A-Z lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = _WORD[data]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cut] |= inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = cut[cut > 0] - 1
    ends[cut] |= inside[cut]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = _power_tables(n)
    v = _BYTE[data]
    v *= power
    total = np.cumsum(v, dtype=np.uint64)
    h = (total[last] - total[first] + v[first]) * inverse[first]
    rows = np.searchsorted(offsets, first, side="right") - 1
    return rows, mix(h + (last - first).astype(np.uint64))


def crc_mod(column: str, n: int) -> str:
    """SQL for crc32(id as text) mod n; a null id counts as the empty text."""
    return f"pmod(crc32(cast(coalesce(cast({column} as string), '') as binary)), {n})"
