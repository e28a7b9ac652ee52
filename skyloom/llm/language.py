"""Language identification by averaged hashed subword embeddings with a linear softmax.

Subwords are all runs of 2, 3 and 4 bytes of a text (A-Z lower-cased), hashed to BUCKETS; their embeddings are
averaged over the whole text and a linear layer gives a softmax over the learned languages. Training is
stochastic gradient descent in numpy on the driver, over a bounded sample: about PER_LANGUAGE rows of each
language (fewer, but one, where there are more than ROWS / PER_LANGUAGE languages), picked by a hash of the id, and of
each row up to PASSAGES passages of PASSAGE bytes, from a stretch at a hashed place. Every language in the rows to learn
from is learned. A fifth of the sample of languages with CALIBRATE rows or more there calibrates: a temperature for the
softmax, and the confidence under which a prediction is rejected (REJECT of the right predictions there fall below it).

Prediction reads every whole text. Null text, or text without a letter, gives `und` with score 0.0. Of languages with
equal scores the first by name is predicted. Without any row to learn from every prediction is `und`. Null ids are
learned from and predicted like others; repeated rows stay repeated; columns besides those named do not matter; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOW, chunks, valid

BUCKETS, WIDTH, GRAMS = 1 << 15, 12, (2, 3, 4)
PER_LANGUAGE, ROWS, PASSAGES, PASSAGE, CALIBRATE = 1000, 100_000, 2, 300, 10
EPOCHS, RATE, REJECT = 4, 0.5, 0.01
#: Steps of 16 passages that training takes at least, and more for each language.
LEAST_STEPS, STEPS_EACH = 1500, 30
#: Languages up to which their sampling rates are broadcast.
BROADCAST = 100_000


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits each bucket adds to the mean
    bias: np.ndarray
    temperature: float
    least: float


def buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of subwords: their buckets in order, and how many each row has."""
    low = _LOW[data].astype(np.uint32)
    size = np.diff(offsets)
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        if len(low) < n:
            yield np.zeros(0, np.int64), count
            continue
        h = np.full(len(low) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= low[k : k + len(h)] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        first = np.repeat(offsets[:-1] - np.cumsum(count) + count, count)
        yield (h[first + np.arange(len(first))] >> np.uint32(32 - 15)).astype(np.int64), count


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of each row, row by row, and how many each row has."""
    parts = [(np.repeat(np.arange(len(count)), count), ids) for ids, count in buckets(data, offsets)]
    rows = np.concatenate([r for r, _ in parts])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([i for _, i in parts])[order], np.bincount(rows, minlength=len(offsets) - 1)


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    number = np.zeros(len(offsets) - 1)
    for ids, count in buckets(data, offsets):
        some = count > 0
        number += count
        if len(ids):
            first = (np.cumsum(count) - count)[some]
            total[some] += np.add.reduceat(model.table[ids], first, axis=0, dtype=np.float64)
    return total / np.maximum(number, 1)[:, None] + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _passages(texts: list[bytes], y: np.ndarray, rng: np.random.Generator) -> tuple[list[bytes], np.ndarray]:
    out, labels = [], []
    for text, label in zip(texts, y, strict=True):
        for _ in range(PASSAGES if len(text) > PASSAGE else 1):
            at = int(rng.integers(0, max(1, len(text) - PASSAGE + 1)))
            out.append(text[at : at + PASSAGE])
            labels.append(label)
    return out, np.array(labels)


def fit(texts: list[bytes], labels: list[str], seed: int = 5) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.searchsorted(np.array(languages), np.array(labels))
    held = (rng.random(len(y)) < 0.2) & (np.bincount(y)[y] >= CALIBRATE)
    short, target = _passages([t for t, h in zip(texts, held, strict=True) if not h], y[~held], rng)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in short]))).astype(np.int64)
    ids, count = features(np.frombuffer(b"".join(short), dtype=np.uint8), offsets)
    starts = np.cumsum(count) - count
    k = len(languages)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((k, WIDTH), np.float32), np.zeros(k, np.float32)
    usable = np.flatnonzero(count > 0)
    epochs = max(EPOCHS, -(-16 * (LEAST_STEPS + STEPS_EACH * k) // max(1, len(usable))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(usable), max(1, len(usable) // 16)):
            if not len(batch):
                continue
            n = count[batch]
            take = ids[np.repeat(starts[batch] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            cut = np.cumsum(n) - n
            hidden = np.add.reduceat(table[take], cut, axis=0) / n[:, None]
            p = softmax(hidden @ weights.T + bias)
            p[np.arange(len(batch)), target[batch]] -= 1
            p = (p / len(batch)).astype(np.float32)
            back = p @ weights
            weights -= rate * 4 * (p.T @ hidden).astype(np.float32)
            bias -= rate * p.sum(axis=0)
            np.add.at(table, take, np.repeat(-rate * 100 * back / n[:, None], n, axis=0).astype(np.float32))
    model = Model(languages, (table @ weights.T).astype(np.float32), bias.astype(float), 1.0, 0.0)
    rest = [t for t, h in zip(texts, held, strict=True) if h]
    if rest:
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in rest]))).astype(np.int64)
        raw, truth = logits(model, np.frombuffer(b"".join(rest), dtype=np.uint8), offsets), y[held]
        tried = np.geomspace(0.05, 20, 60)
        losses = [-np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-9).mean() for t in tried]
        model.temperature = float(tried[int(np.argmin(losses))])
        p = softmax(raw / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        model.least = min(float(np.quantile(right, REJECT)), 0.99) if len(right) else 0.0
    return model


def train(docs: DataFrame, may_learn: Column, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Fit on a bounded sample of the rows where may_learn holds and neither text nor language is null."""
    rows = docs.where(may_learn & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    counts = rows.groupBy(lang_column).count().collect()  # a row for each language
    if not counts:
        return fit([], [])
    spark, most = docs.sparkSession, max(1, min(PER_LANGUAGE, ROWS // len(counts)))
    rates = spark.createDataFrame([(r[0], min(1.0, (3 * most + 20) / r[1])) for r in counts], "learned string, rate double")
    rates = F.broadcast(rates) if len(counts) <= BROADCAST else rates  # a row for each language, so the texts stay where they are
    size, hashed = F.octet_length(text_column), F.xxhash64(F.col(id_column), F.col(text_column), F.lit(31))
    spot = 1 + F.pmod(F.xxhash64(F.col(id_column), F.lit(32)), F.greatest(size - 2 * PASSAGE * PASSAGES, F.lit(1)).cast("long"))
    part = F.substring(F.col(text_column).cast("binary"), spot.cast("int"), F.lit(2 * PASSAGE * PASSAGES))
    picked = rows.select(F.col(lang_column).alias("lang"), hashed.alias("dice"), part.alias("part")).join(rates, F.col("lang") == F.col("learned"))
    picked = picked.where(F.pmod("dice", F.lit(1 << 40)) / float(1 << 40) < F.col("rate"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("dice", F.lit(1 << 40)), "dice", "part"))
    sample = picked.withColumn("place", place).where(F.col("place") <= most).orderBy("dice", "lang", "part").collect()  # at most ROWS, or a row for each language
    return fit([bytes(r.part) for r in sample], [r.lang for r in sample])


def predict(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row; accepted is false where the confidence is too low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for at, end, data, offsets in chunks(column):
                texts = column.slice(at, end - at)
                letters = np.array([t.is_valid and any(map(str.isalpha, t.as_py())) for t in texts], dtype=bool)
                if model.languages:
                    p = softmax(logits(model, data, offsets) / model.temperature)
                    best, score = p.argmax(axis=1), p.max(axis=1)
                else:
                    letters[:] = False
                    best, score = np.zeros(end - at, np.int64), np.zeros(end - at)
                named = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, np.clip(score, 0, 1), 0.0)
                columns = [batch.column(0).slice(at, end - at), pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(letters & (score >= model.least))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "accepted"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, valid(text_column)).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
