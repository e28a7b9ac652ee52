"""Language-model scoring: an interpolated modified Kneser-Ney bigram model counted in Spark.

Tokens are a text's words (A-Z lower-cased) and one end. Spark counts tokens by 64-bit hashes, and bigrams dealt by
their first word (a word with a large share of all tokens is dealt by its second word too). Each share's bigrams are
sorted by key, the two words' 32-bit hashes, and written as a flat array in the shared folder, as are the sorted
tables of tokens, contexts and continuations. Nothing of the model goes to the driver or is broadcast but file names,
totals and the list of heavy words (at most HEAVY for each share). Workers map the arrays to memory where the shared
folder is a local path; else they fetch a copy, map it and unlink it at once.

p(w | u) = max(c(u,w) - D, 0) / c(u) + g(u) p(w) with p(w) = max(n(w) - D', 0) / n + g' / (V + 1): n(w) counts the
different words before w, V the different tokens; D and D' are the three discounts of either order. A word after an
unknown context has p(w); an unknown word has n(w) = 0. Without training text every word has p = 1 / (V + 1) = 1.

Null text counts as empty: one token, the end. Repeated rows count and are scored each; a null id counts as the empty
text in the split. Very long texts are read whole; columns besides id and text do not
matter; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh_path, mix, partitions, saved, words

END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
HEAVY, SALTS, RUN = 2, 32, 4 << 20
_LOW32 = np.uint64(0xFFFFFFFF)
_ENTRY = {
    "pairs": np.dtype([("key", "<u8"), ("c", "<u4")]),
    "tokens": np.dtype([("key", "<u8"), ("c", "<u8")]),
    "contexts": np.dtype([("key", "<u8"), ("c", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")]),
    "after": np.dtype([("key", "<u8"), ("c", "<u8")]),
}


@dataclass
class Model:
    folder: str
    shards: int
    heavy: np.ndarray  # 32-bit hashes of the words whose bigrams are dealt by both words
    total: int
    different: int
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    lower_total: int
    lower_rest: float
    files: dict[str, frozenset[int]]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, ends included, and where each text starts."""
    rows, h = words(data, offsets)
    count = np.bincount(rows, minlength=len(offsets) - 1) + 1
    ends = np.cumsum(count)
    out = np.empty(ends[-1], dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[ends - 1] = False
    out[inside] = h
    out[ends - 1] = END
    return out, ends - count


def pairs_of(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bigram key that ends in each token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = BEGIN
    return (before & _LOW32) << np.uint64(32) | (h & _LOW32)


def shard_of(keys: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    """The share a bigram is dealt to."""
    first = keys >> np.uint64(32)
    salt = np.where(np.isin(first, heavy), mix(keys) % np.uint64(SALTS) + np.uint64(1), np.uint64(0)) if len(heavy) else np.uint64(0)
    return (mix(first * np.uint64(SALTS + 1) + salt) % np.uint64(shards)).astype(np.int32)


def _filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def _store(folder: str, name: str, content: np.ndarray) -> None:
    """Write a sorted array; attempts of one task write the same bytes, and the last rename wins."""
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(pa.py_buffer(content.tobytes()))
    fs.move(part, f"{path}/{name}")


@functools.lru_cache(maxsize=4096)
def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    fs, path = _filesystem(folder)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype=_ENTRY[kind], mode="r")
    with tempfile.NamedTemporaryFile(dir=os.environ.get("TMPDIR")) as copy, fs.open_input_stream(f"{path}/{name}") as f:
        while piece := f.read(1 << 22):
            copy.write(piece)
        copy.flush()
        return np.memmap(copy.name, dtype=_ENTRY[kind], mode="r")


def _merge(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, v = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k[first], np.add.reduceat(v, first, axis=0) if len(k) else v


def _counted(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(h, starts) of each run of texts, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), RUN):
                yield make(*tokens(data, offsets))

    return docs.select("text").mapInArrow(run, schema)


def _table(df: DataFrame, folder: str, kind: str, shards: int) -> DataFrame:
    """Write rows (key, c, ...) as sorted arrays, dealt by key; gives rows (kind, shard, rows, c) with counts of counts."""
    names = [n for n in _ENTRY[kind].names if n != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        keys = columns[1].view(np.uint64)
        order = np.lexsort((keys, columns[0]))
        columns, keys = [c[order] for c in columns], keys[order]
        for shard in np.unique(columns[0]).tolist():
            a, b = np.searchsorted(columns[0], [shard, shard + 1])
            out = np.empty(b - a, dtype=_ENTRY[kind])
            out["key"] = keys[a:b]
            for name, c in zip(names, columns[2:], strict=True):
                out[name] = c[a:b]
            _store(f"{folder}/{kind}", str(shard), out)
            told = [b - a, out["c"].sum(), *((out["c"] == i).sum() for i in (1, 2, 3, 4))]
            row = [pa.array([shard], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in told)]
            yield pa.RecordBatch.from_arrays(row, names=["shard", "rows", "c", "n1", "n2", "n3", "n4"])

    rows = df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).select("shard", "key", *names).repartition(partitions(df.sparkSession), "shard")
    return rows.mapInArrow(run, "shard int, rows long, c long, n1 long, n2 long, n3 long, n4 long")


def spread(keys: np.ndarray, shards: int) -> np.ndarray:
    """Spark's pmod(xxhash64(key), shards) of 64-bit keys."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in _XX)
    k = keys * p2
    k = (k << np.uint64(31) | k >> np.uint64(33)) * p1
    h = (np.uint64(42) + p5 + np.uint64(8)) ^ k
    h = (h << np.uint64(27) | h >> np.uint64(37)) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), shards).astype(np.int64)


# fixed values: the five primes of the xxHash64 specification
_XX = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of entries counted 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = [(k + 1) - (k + 2) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else (0.5, 1.0, 1.5)[k] for k in range(3)]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(out))


def train(docs: DataFrame, *, text_column: str = "text") -> Model:
    """Count the whole text of docs and write the model's arrays."""
    spark = docs.sparkSession
    docs = docs.select(F.col(text_column).alias("text"))
    shards, folder = 4 * partitions(spark), fresh_path(spark, "lm")

    def singles(h: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        value, times = np.unique(h, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], names=["key", "c"])

    unigrams = _counted(docs, singles, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    made = _table(unigrams, folder, "tokens", shards).collect()  # a row for each share
    total, different = sum(r.c for r in made), sum(r.rows for r in made)
    files = {"tokens": frozenset(r.shard for r in made)}
    heavy = _heavy(docs, total, shards)

    def doubles(h: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        value, times = np.unique(pairs_of(h, starts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shard_of(value, heavy, shards)), pa.array(value.view(np.int64)), pa.array(times)], names=["shard", "key", "c"])

    dealt = _counted(docs, doubles, "shard int, key long, c long").repartition(partitions(spark), "shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, shard = [], [], []
        for b in batches:
            shard.append(b.column(0).to_numpy())
            keys.append(b.column(1).to_numpy().view(np.uint64))
            counts.append(b.column(2).to_numpy())
        if not keys:
            return
        shard, keys, counts = np.concatenate(shard), np.concatenate(keys), np.concatenate(counts)
        for s in np.unique(shard).tolist():
            own = shard == s
            k, c = _merge([keys[own]], [counts[own]])
            out = np.empty(len(k), dtype=_ENTRY["pairs"])
            out["key"], out["c"] = k, c
            _store(f"{folder}/pairs", str(s), out)
            first, second = k >> np.uint64(32), k & _LOW32
            stats = np.stack((c, c == 1, c == 2, c >= 3), axis=1).astype(np.int64)
            u, sums = _merge([first], [stats])
            w, n = np.unique(second, return_counts=True)
            zero = np.zeros(len(w), np.int64)
            some = np.array([len(k), (c == 1).sum(), (c == 2).sum(), (c == 3).sum(), (c == 4).sum()])
            columns = [np.concatenate((np.zeros(len(u), np.int32), np.ones(len(w), np.int32), np.full(2, 2, np.int32)))]
            columns.append(np.concatenate((u, w, np.array([0, 1 + s], np.uint64))).view(np.int64))
            for i in range(4):
                columns.append(np.concatenate((sums[:, i], n if i == 0 else zero, [some[i + 1], 1 if i == 0 else 0])))
            for at in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in columns], names=["kind", "key", "c", "n1", "n2", "n3"])

    stats = dealt.mapInArrow(write, "kind int, key long, c long, n1 long, n2 long, n3 long")
    stats = saved(stats.groupBy("kind", "key").agg(*[F.sum(x).alias(x) for x in ("c", "n1", "n2", "n3")]), "stats")
    told = stats.where("kind = 2").collect()  # a row for each share, and the counts of counts
    files["pairs"] = frozenset(r.key - 1 for r in told if r.key)
    counts = next(([r.c, r.n1, r.n2, r.n3] for r in told if r.key == 0), [0, 0, 0, 0])
    rows = _table(stats.where("kind = 0").drop("kind"), folder, "contexts", shards).collect()
    files["contexts"] = frozenset(r.shard for r in rows)
    rows = _table(stats.where("kind = 1").select("key", "c"), folder, "after", shards).collect()
    files["after"] = frozenset(r.shard for r in rows)
    n = [sum(r[f"n{i}"] for r in rows) for i in (1, 2, 3, 4)]
    lower = discounts(n)
    lower_total, kinds = sum(r.c for r in rows), sum(r.rows for r in rows)
    rest = lower[0] * n[0] + lower[1] * n[1] + lower[2] * (kinds - n[0] - n[1])
    return Model(folder, shards, heavy, total, different, discounts(counts), lower, lower_total, rest, files)


def _heavy(docs: DataFrame, total: int, shards: int) -> np.ndarray:
    """The words with more than 1 / (HEAVY * shares) of all tokens, at most HEAVY * shares of them."""
    least = total / (HEAVY * shards)

    def often(h: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        before = np.concatenate((h, np.full(len(starts), BEGIN)))
        value, times = np.unique(before & _LOW32, return_counts=True)
        # a word that is heavy over all is so in some run
        keep = times > len(h) / (HEAVY * shards)
        return pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(times[keep])], names=["key", "c"])

    rows = _counted(docs, often, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") > least / 2).orderBy(F.col("c").desc(), "key").limit(HEAVY * shards)
    return np.sort(np.array([r.key for r in rows.collect()], dtype=np.int64).view(np.uint64))


class Reader:
    """Looks keys up in a model's arrays."""

    def __init__(self, model: Model) -> None:
        self.m = model

    def _find(self, kind: str, keys: np.ndarray, shard: np.ndarray, fields: tuple[str, ...]) -> list[np.ndarray]:
        """Values of sorted, distinct keys; 0 where a key is unknown."""
        out = [np.zeros(len(keys), dtype=np.int64) for _ in fields]
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.m.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if s not in self.m.files[kind]:
                continue
            mine = order[cut[s] : cut[s + 1]]
            entries = _mapped(f"{self.m.folder}/{kind}", str(s), kind)
            at = np.minimum(np.searchsorted(entries["key"], keys[mine]), len(entries) - 1)
            hit = entries[at]
            known = hit["key"] == keys[mine]
            for o, f in zip(out, fields, strict=True):
                o[mine] = np.where(known, hit[f], 0)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and model score of each text."""
        m = self.m
        h, starts = tokens(data, offsets)
        word, which = np.unique(h, return_inverse=True)
        (c,) = self._find("tokens", word, spread(word, m.shards), ("c",))
        base = np.log10((c + 0.1) / (m.total + 0.1 * (m.different + 1)))
        short = np.unique(word & _LOW32)
        (n,) = self._find("after", short, spread(short, m.shards), ("c",))
        if m.lower_total:
            single = (np.maximum(n - _discount(n, m.lower), 0) + m.lower_rest / (m.different + 1)) / m.lower_total
        else:
            single = np.full(len(short), 1 / (m.different + 1))
        keys = pairs_of(h, starts)
        pair, at = np.unique(keys, return_inverse=True)
        (c2,) = self._find("pairs", pair, shard_of(pair, m.heavy, m.shards), ("c",))
        first, lead = np.unique(pair >> np.uint64(32), return_inverse=True)
        s, n1, n2, n3 = self._find("contexts", first, spread(first, m.shards), ("c", "n1", "n2", "n3"))
        gamma = np.where(s > 0, (m.discounts[0] * n1 + m.discounts[1] * n2 + m.discounts[2] * n3) / np.maximum(s, 1), 1.0)
        high = np.maximum(c2 - _discount(c2, m.discounts), 0) / np.maximum(s, 1)[lead]
        lower = single[np.searchsorted(short, pair & _LOW32)]
        p = np.log10(high + gamma[lead] * lower)
        count = np.diff(np.append(starts, len(h)))
        known = np.add.reduceat((c > 0)[which].astype(np.int64), starts)
        return count, known, np.add.reduceat(base[which], starts), np.add.reduceat(p[at], starts)


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def score(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row; scores are log10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1), RUN):
                count, known, base, own = reader.score(data, offsets)
                columns = [batch.column(0).slice(at, end - at), pa.array(count), pa.array(known), pa.array(np.full(end - at, model.total, np.int64)), pa.array(base), pa.array(own), pa.array(10 ** (-own / count))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

