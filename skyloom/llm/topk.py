"""Exact top-k search by vector-approximation files.

Exact vectors and their approximation are tables of their own in the shared folder. The approximation packs BLOCK vectors
a row: CELLS equal cells for each dimension over the block's range, a byte each, with the ranges. Queries are a stated set,
so blocks of queries meet all blocks of cells (never of exact vectors): a query block goes to each of a number of spots
that the blocks of cells are dealt to, and these are not copied. Cells alone give each vector a lower and an upper bound
of its score. A vector stays for a query if its upper bound reaches the query's k-th best lower bound, first over the
blocks of a task, then over all; for these few the exact vectors are read and scored, best bounds first. Scores are
sums of products of floor(scale * component) in whole numbers; one beyond 64 bits raises an error.

Equal vectors are many alike for any query: of each, those with the k + 1 smallest ids are kept, of which k at most can be
in an answer, so a vector that a third of all rows hold adds no more than others.

Vectors that are null or hold a null or non-finite component, or whose id is null, take no part; nor do vectors of another
number of dimensions than the query. Rows with the query's own id are not its candidates; repeated rows are candidates
each, and repeated queries are answered each. Other columns do not matter. With no queries or no candidates there are
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

BLOCK, CELLS = 1024, 256
#: Candidates that a task holds before it gives those found so far.
HELD = 1 << 20


def _numbers(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, dims, exact, h, m): the vectors that take part as whole numbers, their hash, and how many rows hold each;
    4 bytes a number, or 8 where any is beyond 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale) + 0.0
                if np.isfinite(x).all():
                    out.append((key, len(x), (x if (np.abs(x) >= 1 << 31).any() else x.astype(np.int32)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["vec_id", "dims", "exact"])

    found = rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, dims int, exact binary")
    return found.groupBy("vec_id", "dims", "exact").agg(F.count("*").alias("m")).withColumn("h", F.xxhash64("exact"))


def unpacked(exact: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(exact, dtype=np.float64 if len(exact) == 8 * dims else np.int32).astype(np.float64)


def _blocks(rows: DataFrame, make, schema: str) -> DataFrame:
    """make(dims, ids, hashes, exact) of up to BLOCK vectors, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def pack(dims: int) -> pa.RecordBatch:
            part = held.pop(dims)
            ids, hashes = (np.array([p[i] for p in part], dtype=np.int64) for i in (0, 1))
            return make(dims, ids, hashes, np.array([p[2] for p in part], dtype=np.float64).reshape(len(part), dims))

        for batch in batches:
            for key, dims, h, exact in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(dims, []).append((key, h, unpacked(exact, dims)))
                if len(held[dims]) == BLOCK:
                    yield pack(dims)
        for dims in list(held):
            yield pack(dims)

    return rows.select("vec_id", "dims", "h", "exact").mapInArrow(run, schema)


def _row(*values: object) -> pa.RecordBatch:
    columns = [pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else pa.array([v], pa.int32()) for v in values]
    return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


class Approximation:
    """Cells of a block's vectors."""

    def __init__(self, exact: np.ndarray) -> None:
        self.low = exact.min(axis=0)
        self.width = np.maximum(exact.max(axis=0) - self.low, 1) / CELLS
        self.most = np.abs(exact).max(axis=0)
        self.cells = np.clip((exact - self.low) / self.width, 0, CELLS - 1).astype(np.uint8)

    @classmethod
    def stored(cls, ranges: bytes, cells: bytes, dims: int) -> Approximation:
        out = cls.__new__(cls)
        out.low, out.width, out.most = np.frombuffer(ranges, dtype=np.float64).reshape(3, dims)
        out.cells = np.frombuffer(cells, dtype=np.uint8).reshape(-1, dims) if dims else np.zeros((len(cells), 0), np.uint8)
        return out

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, a row for each query, wide enough for all rounding."""
        middle = (queries * self.width) @ self.cells.T.astype(np.float64) + (queries @ (self.low + self.width / 2))[:, None]
        size = np.abs(queries)
        slack = (size @ (self.width / 2) + 1e-12 * (size @ (self.most + self.width)) + 1e-3)[:, None]
        return middle - slack, middle + slack


class _Held:
    """The candidates of a query block over the blocks of cells met so far."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k, self.best, self.found = ids, k, np.full((len(ids), k), -np.inf), []

    def meet(self, low: np.ndarray, up: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> int:
        own = self.ids[:, None] == ids[None, :]
        low, up = np.where(own, -np.inf, low), np.where(own, -np.inf, up)
        top = np.partition(low, low.shape[1] - self.k, axis=1)[:, -self.k :] if low.shape[1] > self.k else low
        both = np.concatenate((self.best, top), axis=1)
        self.best = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        q, v = np.nonzero((up >= self.best.min(axis=1)[:, None]) & (up > -np.inf))
        self.found.append((q, ids[v], hashes[v], low[q, v], up[q, v]))
        return len(q)

    def left(self) -> list[np.ndarray]:
        q, *rest = (np.concatenate(c) for c in zip(*self.found, strict=True))
        keep = rest[-1] >= self.best.min(axis=1)[q]
        return [c[keep] for c in (q, *rest)]


def score(x: bytes, y: bytes, dims: int) -> int:
    a, b = unpacked(x, dims), unpacked(y, dims)
    if dims * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 1 << 62:
        return int(a.astype(np.int64) @ b.astype(np.int64))
    out = sum(int(u) * int(v) for u, v in zip(a, b, strict=True))
    if not -(1 << 63) <= out < 1 << 63:
        raise OverflowError("a score is beyond 64 bits")
    return out


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of queries, against all rows of vectors; both (vec_id, embedding)."""
    spark = vectors.sparkSession
    alike = F.dense_rank().over(Window.partitionBy("exact", "dims").orderBy("vec_id"))
    exact = saved(_numbers(vectors, scale).withColumn("r", alike).where(F.col("r") <= k + 1).drop("r"), "exact")
    asked = saved(_numbers(queries, scale), "asked")

    def cells(dims: int, ids: np.ndarray, hashes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        a = Approximation(x)
        return _row(dims, ids, hashes, np.stack((a.low, a.width, a.most)), a.cells if dims else np.zeros(len(ids), np.uint8))

    def questions(dims: int, ids: np.ndarray, hashes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return _row(dims, ids, hashes, x)

    spots = max(1, 2 * partitions(spark))
    file = _blocks(exact, cells, "dims int, ids binary, hashes binary, ranges binary, cells binary")
    file = saved(file.withColumn("spot", F.pmod(F.xxhash64("ids"), F.lit(spots)).cast("int")), "cells")
    wide = _blocks(asked.coalesce(max(1, partitions(spark) // 8)), questions, "q_dims int, q_ids binary, q_hashes binary, q_exact binary")
    wide = saved(wide, "questions").withColumn("q_spot", F.explode(F.sequence(F.lit(0), F.lit(spots - 1))))
    # the questions are more than their size on disk tells Spark, so they are not to be broadcast
    met = file.join(wide.hint("merge"), (F.col("spot") == F.col("q_spot")) & (F.col("dims") == F.col("q_dims"))).select("dims", "ids", "hashes", "ranges", "cells", "q_ids", "q_hashes", "q_exact")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], _Held] = {}
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            for (ids, hashes), h in held.items():
                q, *rest = h.left()
                own, own_hash = np.frombuffer(ids, dtype=np.int64), np.frombuffer(hashes, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[q], own_hash[q], *rest)], names=["query_id", "q_h", "vec_id", "h", "low", "up"])
            held.clear()

        for batch in batches:
            for dims, ids, hashes, ranges, cells, *question in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (question[0], question[1])
                asking = np.frombuffer(question[2], dtype=np.float64).reshape(len(key[0]) // 8, dims)
                if key not in held:
                    held[key] = _Held(np.frombuffer(key[0], dtype=np.int64), k)
                low, up = Approximation.stored(ranges, cells, dims).bounds(asking)
                size += held[key].meet(low, up, np.frombuffer(ids, dtype=np.int64), np.frombuffer(hashes, dtype=np.int64))
                if size > HELD:
                    yield from give()
                    size = 0
        yield from give()

    found = met.mapInArrow(scan, "query_id long, q_h long, vec_id long, h long, low double, up double")
    by = Window.partitionBy("query_id", "q_h")
    found = found.withColumn("r", F.row_number().over(by.orderBy(F.col("low").desc())))
    found = found.withColumn("least", F.max(F.when(F.col("r") == k, F.col("low"))).over(by)).where("least is null or up >= least")
    found = saved(found.select("query_id", "q_h", "vec_id", "h"), "candidates", rows=16)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [score(x, y, d) for d, x, y in zip(*(c.to_pylist() for c in batch.columns[5:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(points, pa.int64())], names=["query_id", "q_h", "vec_id", "m", "times", "score"])

    one = exact.select("vec_id", "h", "dims", F.least("m", F.lit(k)).alias("m"), F.col("exact").alias("x"))
    two = asked.select(F.col("vec_id").alias("query_id"), F.col("h").alias("q_h"), F.col("m").alias("times"), F.col("exact").alias("y"), F.col("dims").alias("q_dims"))
    rows = found.join(one, ["vec_id", "h"]).join(two, ["query_id", "q_h"]).where("dims = q_dims").select("query_id", "q_h", "vec_id", "m", "times", "dims", "x", "y")
    rows = rows.mapInArrow(scored, "query_id long, q_h long, vec_id long, m long, times long, score long")
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1L, m)")))
    rows = rows.withColumn("rank", F.row_number().over(by.orderBy(F.col("score").desc(), F.col("vec_id")))).where(F.col("rank") <= k)
    return rows.withColumn("copy", F.explode(F.expr("sequence(1L, times)"))).select("query_id", "rank", "vec_id", "score")
