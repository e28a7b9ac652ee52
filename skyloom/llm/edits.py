"""Document fingerprints by a randomised edit embedding.

A walk copies the character under its pointer at each step and moves the pointer on or not, by a
coin that the step and the character fix. All texts share the coins, so an edit shifts two walks
apart only until they meet again, and edit distance becomes Hamming distance of what they copy.
The fingerprint keeps SAMPLES copied symbols from the first SAMPLES steps and from each doubling of
the steps after, so it grows with the logarithm of the text; '.' marks a step beyond the walk.
Likeness is the share of equal symbols, each doubling weighted by the steps it stands for. Near copies are found by
bands, hashes of BAND symbols at places sampled over the whole walk, and each candidate is verified by its likeness
(class_id: the smallest id of an equal fingerprint; near_id: the smallest that links reach).

Null text counts as empty; the empty text has an empty fingerprint, alike 1.0 to another empty one
and 0.0 to any other. Repeated rows stay repeated; rows with equal or null ids follow each other by
text (null ids first), and one of them comes next to another. Bytes that are no UTF-8 are read as U+FFFD; columns besides
id and text do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, partitions, saved, valid
from .components import joined

#: Steps after which the coins repeat, and symbols kept of each doubling.
PERIOD, SAMPLES = 128, 64
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", dtype=np.uint8)
#: Symbols a band takes, bands, and the least likeness that links. Texts with a likeness of 0.9 share a band with a
#: probability of 0.98, those with less in fewer cases: what is compared is verified, but bands are no exact way.
BAND, BANDS, LEAST = 16, 20, 0.75


#: Characters are dealt into so many kinds, by which the coins are thrown. A task walks so many characters at a time,
#: side by side while at least NARROW texts are that long.
KINDS, TOGETHER, NARROW = 4096, 4 << 20, 24


@functools.lru_cache(maxsize=1)
def _stays() -> np.ndarray:
    """Steps the pointer stays on a character, at KINDS x PERIOD (kind of character, step)."""
    coins = mix(np.arange(1, KINDS * PERIOD + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(KINDS, PERIOD) >> np.uint64(63)
    coins[:, PERIOD - 1] |= (coins.sum(axis=1) == 0).astype(np.uint64)
    out = np.zeros((KINDS, PERIOD), dtype=np.int64)
    wait = np.argmax(coins, axis=1) + 1
    for step in range(PERIOD - 1, -1, -1):
        wait = np.where(coins[:, step] == 1, 1, wait + 1)
        out[:, step] = wait
    return out.ravel()


@functools.lru_cache(maxsize=1)
def _sampled() -> np.ndarray:
    """Sampled steps in order: the first SAMPLES, then as many of [SAMPLES, 2 SAMPLES), [2 SAMPLES, 4 SAMPLES), ..."""
    rng = np.random.default_rng(7)
    out = [np.arange(SAMPLES)]
    for low in (SAMPLES << i for i in range(40)):
        out.append(low + np.sort(rng.choice(low, SAMPLES, replace=False) if low < 1 << 24 else rng.integers(0, low, SAMPLES)))
    return np.concatenate(out)


@functools.lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """A letter for each code point."""
    return _LETTERS[(mix(np.arange(0x110000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)]


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    return ((mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(77)) >> np.uint64(52)).astype(np.int64) * PERIOD).astype(np.int32)


@functools.lru_cache(maxsize=1)
def _rows() -> list[list[int]]:
    return _stays().reshape(KINDS, PERIOD).tolist()


def _walks(codes: list[np.ndarray]) -> list[np.ndarray]:
    """For each text the step at which the pointer comes to each character, and to the end."""
    lengths = np.array([len(c) for c in codes], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    starts = np.cumsum(size) - size
    kind = _kinds()[np.concatenate([codes[i] for i in order])] if len(codes) else np.zeros(0, np.int32)
    stays, stay = _stays(), np.zeros(len(kind), dtype=np.int64)
    place, phase = starts.copy(), np.zeros(len(codes), dtype=np.int64)
    wide = np.searchsorted(-size, -np.arange(1, (size[NARROW - 1] if len(size) >= NARROW else 0) + 1), side="right").tolist()
    for k in wide:
        p, q = place[:k], phase[:k]
        d = stays[kind[p] + q]
        stay[p] = d
        q += d
        q &= PERIOD - 1
        p += 1
    rows = _rows()
    for j in range(int(np.searchsorted(-size, -len(wide), side="left")) if len(size) else 0):
        at, out, step = int(place[j]), [], int(phase[j])
        for row in map(rows.__getitem__, (kind[at : starts[j] + size[j]] // PERIOD).tolist()):
            d = row[step]
            out.append(d)
            step = (step + d) % PERIOD
        stay[at : at + len(out)] = out
    found: list[np.ndarray] = [np.zeros(1, np.int64)] * len(codes)
    for j, i in enumerate(order.tolist()):
        found[i] = np.concatenate(([0], np.cumsum(stay[starts[j] : starts[j] + size[j]])))
    return found


def _read(codes: np.ndarray, begins: np.ndarray) -> str:
    total = int(begins[-1])
    levels = max(0, (total - 1) // SAMPLES).bit_length() + (total > 0)
    out = np.full(levels * SAMPLES, 46, dtype=np.uint8)
    wanted = _sampled()[: len(out)]
    wanted = wanted[: np.searchsorted(wanted, total)]
    out[: len(wanted)] = _symbols()[codes[np.searchsorted(begins, wanted, side="right") - 1]]
    return out.tobytes().decode()


def fingerprints_of(texts: list[str]) -> list[str]:
    out: list[str] = []
    group: list[np.ndarray] = []
    size = 0
    for text in texts:
        group.append(_codes(text))
        size += len(text)
        if size >= TOGETHER:
            out += map(_read, group, _walks(group))
            group, size = [], 0
    return out + list(map(_read, group, _walks(group)))


def replaced(text: str, other: str) -> str:
    """Text with its last floor(half) of characters replaced by as many of the first of other, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def likeness(a: str, b: str) -> float:
    """Estimated share of steps at which two walks copied the same character."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, ".").encode(), dtype=np.uint8).reshape(-1, SAMPLES) for s in (a, b))
    some = (x != 46) | (y != 46)
    span = np.array([SAMPLES] + [SAMPLES << i for i in range(len(x) - 1)], dtype=float) / SAMPLES
    return float((((x == y) & some).sum(axis=1) * span).sum() / (some.sum(axis=1) * span).sum())


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    @F.pandas_udf("string")
    def one(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(fingerprints_of([t or "" for t in batch]), dtype=object)

    return docs.select(F.col(id_column).alias("doc_id"), one(valid(text_column)).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its edited text, whose last half the next row's start replaces.

    Rows are dealt by ranges of ids, whose bounds are quantiles; the first id of a range also goes to the
    range before, and that of the first range to the last, so a task meets each row's successor.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), valid(text_column).alias("text"))
    ids = rows.select("doc_id")
    n = partitions(spark)
    if isinstance(docs.schema[id_column].dataType, T.NumericType):
        cuts = ids.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n) if n > 1 else F.lit(None)).first()[0] or []
    else:  # quantiles of a bounded sample
        sample = ids.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(100 * n).collect()
        cuts = sorted(r.doc_id for r in sample)[100::100]
    cuts = np.array(sorted(set(cuts)), dtype=None if cuts and isinstance(cuts[0], int) else object)

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        out = np.zeros(len(values), dtype=np.int32)
        some = values.notna().to_numpy()
        out[some] = np.searchsorted(cuts, values[some].to_numpy(), side="right")
        return pd.Series(out)

    heads = ids.withColumn("bucket", bucket("doc_id")).groupBy("bucket").agg(F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.min("doc_id").alias("low")).orderBy("bucket").collect()  # a row for each range
    before = {row.bucket: heads[i - 1].bucket for i, row in enumerate(heads)}
    lows = [(row.bucket, None if row.nulls else row.low) for row in heads]
    first_id = F.lit(False)
    low_ids = [low for _, low in lows if low is not None]
    if low_ids:
        first_id = F.coalesce(F.col("doc_id").isin(low_ids) if len(low_ids) < 50 else F.array_contains(F.lit(low_ids), F.col("doc_id")), F.lit(False))
    if any(low is None for _, low in lows):
        first_id = first_id | F.col("doc_id").isNull()
    back = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("bucket")) if before else F.lit(0)
    places = F.when(first_id, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")), F.struct(back.alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))))
    dealt = rows.withColumn("bucket", bucket("doc_id")).select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.b", "p.guest")
    dealt = dealt.repartition(n, "b").sortWithinPartitions("b", "guest", "doc_id", "text").select("b", "guest", "doc_id", "text")
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose successor is awaited, with its range
        pairs: list[tuple[object, str, str]] = []
        size, kind_of_id = 0, None

        def flush() -> pa.RecordBatch:
            edited = [replaced(text, other) for _, text, other in pairs]
            prints = fingerprints_of([text for _, text, _ in pairs] + [other for _, _, other in pairs[-1:]] + edited)
            mine, theirs = prints[: len(pairs)], prints[len(pairs) + 1 :]
            follow = [p if k + 1 < len(pairs) and pairs[k + 1][1] is pairs[k][2] else fingerprints_of([pairs[k][2]])[0] for k, p in enumerate(prints[1 : len(pairs) + 1])]
            follow[-1] = prints[len(pairs)]
            columns = {
                "doc_id": pa.array([p[0] for p in pairs], kind_of_id),
                "n_chars": pa.array([len(p[1]) for p in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                "fingerprint": pa.array(mine, pa.string()),
                "edited_fingerprint": pa.array(theirs, pa.string()),
                "near_edited": pa.array(list(map(likeness, mine, theirs)), pa.float64()),
                "near_next": pa.array(list(map(likeness, mine, follow)), pa.float64()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            kind_of_id = batch.schema.field(2).type
            for i in range(batch.num_rows):
                b, guest, key, text = (c[i].as_py() for c in batch.columns)
                text = text or ""
                if held is not None and held[0] == b:
                    pairs.append((held[1], held[2], text))
                    size += len(held[2])
                    if size >= TOGETHER:
                        yield flush()
                        pairs, size = [], 0
                held = None if guest else (b, key, text)
        if pairs:
            yield flush()

    return dealt.mapInArrow(run, schema)


@functools.lru_cache(maxsize=64)
def _picks(levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each band among the symbols of so many doublings, each drawn as often as the steps it stands for, and odd
    weights of a band's symbols."""
    rng = np.random.default_rng(11 + levels)
    span = np.array([1.0] + [2.0**i for i in range(levels - 1)])
    picks = rng.choice(levels, (BANDS, BAND), p=span / span.sum()) * SAMPLES + rng.integers(0, SAMPLES, (BANDS, BAND))
    return picks, rng.integers(1, 1 << 63, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(fingerprint: str) -> list[int]:
    """A hash for each band over all doublings of the walk, and over all but the last, which copies that are a little
    shorter may not reach."""
    symbols = np.frombuffer(fingerprint.encode(), dtype=np.uint8)
    levels, keys = len(symbols) // SAMPLES, []
    for n in range(max(1, levels - 1), levels + 1):
        picks, weights = _picks(n)
        place = np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(n * BANDS)
        keys.append(mix(mix(place) + (symbols[picks] * weights).sum(axis=1, dtype=np.uint64)))
    return np.concatenate(keys).view(np.int64).tolist() if keys else []


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(column: pd.Series) -> pd.Series:
    return pd.Series([bands(x) for x in column], dtype=object)


@F.pandas_udf(T.DoubleType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with likeness `least` or more, and their likeness."""
    one = classes.select(F.col("node").alias("a"), F.col("fingerprint").alias("x"))
    two = classes.select(F.col("node").alias("b"), F.col("fingerprint").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", _near("x", "y").alias("near")).where(F.col("near") >= least)


def _banded(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (node, fingerprint, class_id) of equal fingerprints, and the bands (key, node) that several share."""
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    classes = saved(classes.select(F.xxhash64("fingerprint").alias("node"), "fingerprint", "class_id"), "classes")
    keyed = classes.select("node", F.explode(_bands("fingerprint")).alias("key"))  # made twice rather than kept: most go
    several = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    return classes, saved(keyed.join(several, "key"), "index")


def near_components(prints: DataFrame, *, least: float = LEAST) -> DataFrame:
    """(node, class_id, near_id) of each fingerprint of prints (doc_id, fingerprint), node being its hash: class_id is the
    smallest id with that fingerprint, near_id the smallest reachable by links, which join fingerprints that share a band
    and have a likeness of `least` or more. Null ids take part, but name a class only if all its ids are null."""
    classes, index = _banded(prints)
    labels = joined(index, lambda pairs: saved(_verified(pairs, classes, least).select("a", "b"), "links"))
    if labels is None:
        return classes.select("node", "class_id", F.col("class_id").alias("near_id"))
    merged = classes.select("node", "class_id").join(labels, "node")
    smallest = merged.groupBy("label").agg(F.min("class_id").alias("near_id"))
    merged = merged.join(smallest, "label").select("node", "near_id")
    return saved(classes.join(merged, "node", "left").select("node", "class_id", F.coalesce("near_id", "class_id").alias("near_id")), "near")


def with_near(rows: DataFrame, *, least: float = LEAST) -> DataFrame:
    """Rows (doc_id, fingerprint, ...) with class_id and near_id; `node` is replaced."""
    rows = saved(rows, "prints")
    found = near_components(rows.select("doc_id", "fingerprint"), least=least)
    return rows.withColumn("node", F.xxhash64("fingerprint")).join(found, "node", "left").drop("node")


def near_pairs(docs: DataFrame, *, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Near copies by bit-sampled bands: (doc_id, class_id) of every row, and verified pairs (class_id, other_id, near).

    Rows with equal fingerprints form a class named by its smallest id. All classes that share a band are compared, and none
    is skipped for being in a large one; near_components is the cheaper way where only what is connected matters.
    """
    prints = saved(fingerprints(docs, id_column=id_column, text_column=text_column), "prints")
    classes, index = _banded(prints)
    members = prints.withColumn("node", F.xxhash64("fingerprint")).join(classes.select("node", "class_id"), "node").select("doc_id", "class_id")
    one, two = index.withColumnRenamed("node", "a"), index.withColumnRenamed("node", "b")
    pairs = saved(_verified(one.join(two, "key").where("a < b").select("a", "b").distinct(), classes, least), "near")
    pairs = pairs.join(classes.select(F.col("node").alias("a"), F.col("class_id").alias("id_a")), "a").join(classes.select(F.col("node").alias("b"), F.col("class_id").alias("id_b")), "b")
    later = F.col("id_a") > F.col("id_b")
    return members, pairs.select(F.when(later, F.col("id_a")).otherwise(F.col("id_b")).alias("class_id"), F.when(later, F.col("id_b")).otherwise(F.col("id_a")).alias("other_id"), "near")
