"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded in WIDTH numbers; FILTERS learned filters over SPAN bytes slide by STRIDE through chunks of
CHUNK bytes that overlap by CHUNK - STEP and together cover the whole text; each filter's largest response in a
chunk is kept, and a document is scored from the mean and the largest over its chunks by a logistic layer.
Training is Adam in numpy on the driver over a bounded sample: about PER_LABEL labelled rows of each label,
picked by a hash of the id, with up to TRAIN_CHUNKS chunks of each; of a row of more than SEEN bytes, PIECES pieces at
hashed places, one in each PIECES-th of the text, take part with SEEN bytes in all. The score is corrected from the balanced
sample to the labels' own shares.

Null text counts as empty; empty text is one chunk of padding and has a score like any other. Labels that
contradict each other for an id, or are null, are not learned from; without both labels every score is the
share of label 1 (1.0 if there are no labels). Null ids are not learned from but scored; repeated rows stay repeated;
other columns stay, but for one named score; a score is predicted 1 from its threshold on, ties included. An empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks

WIDTH, FILTERS, SPAN, STRIDE, CHUNK, STEP = 6, 16, 8, 2, 256, 192
PER_LABEL, TRAIN_CHUNKS, EPOCHS, BATCH, RATE = 1500, 4, 7, 32, 0.01
PAD = 256
#: Bytes of a sampled row that training can see; scoring always reads whole texts.
SEEN, PIECES = 1 << 16, 64


@dataclass
class Model:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    constant: float | None = None


def spots(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each chunk starts, where its text ends, and the number of chunks of each text."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-(size - (CHUNK - STEP)) // STEP))
    starts = np.repeat(offsets[:-1] - (np.cumsum(count) - count) * STEP, count) + np.arange(count.sum()) * STEP
    return starts, np.repeat(offsets[1:], count), count


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunks as rows of CHUNK symbols."""
    at = starts[:, None] + np.arange(CHUNK)
    out = np.full(at.shape, PAD, dtype=np.uint16)
    inside = at < ends[:, None]
    out[inside] = data[at[inside]]
    return out


def windows(symbols: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """(chunks, windows, SPAN * WIDTH) embedded windows."""
    x = embed[symbols]
    n = (CHUNK - SPAN) // STRIDE + 1
    view = np.lib.stride_tricks.as_strided(x, (len(x), n, SPAN * WIDTH), (x.strides[0], x.strides[1] * STRIDE, x.strides[2]))
    return view.reshape(-1, SPAN * WIDTH)


def pooled(symbols: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest response of each filter in each chunk, where it is, and the windows."""
    x = windows(symbols, model.embed)
    r = (x @ model.filters).reshape(len(symbols), -1, FILTERS)
    where = r.argmax(axis=1)
    return np.maximum(np.take_along_axis(r, where[:, None, :], axis=1)[:, 0] + model.bias, 0), where, x


def document_features(best: np.ndarray, count: np.ndarray) -> np.ndarray:
    first = np.cumsum(count) - count
    return np.hstack((np.add.reduceat(best, first, axis=0) / count[:, None], np.maximum.reduceat(best, first, axis=0)))


def score(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Probability of label 1 of each text."""
    if model.constant is not None:
        return np.full(len(offsets) - 1, model.constant)
    starts, ends, count = spots(offsets)
    best = np.concatenate([_strongest(cut(data, starts[i : i + 512], ends[i : i + 512]), model) for i in range(0, len(starts), 512)])
    z = document_features(best, count) @ model.weights + model.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _strongest(symbols: np.ndarray, model: Model) -> np.ndarray:
    x = windows(symbols, model.embed)
    return np.maximum((x @ model.filters).reshape(len(symbols), -1, FILTERS).max(axis=1) + model.bias, 0)


def fit(texts: list[bytes], labels: np.ndarray, share: float | None = None, seed: int = 3) -> Model:
    """Train on texts with labels 0 and 1; share: of label 1 where the model will be used."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    labels = np.asarray(labels, dtype=float)
    if len(set(labels.tolist())) < 2:
        constant = float(labels[0]) if len(labels) else 1.0
        return Model(np.zeros((257, WIDTH), f32), np.zeros((SPAN * WIDTH, FILTERS), f32), np.zeros(FILTERS, f32), np.zeros(2 * FILTERS, f32), 0.0, constant)
    parts = {
        "embed": rng.normal(0, 0.5, (257, WIDTH)).astype(f32),
        "filters": rng.normal(0, 1 / np.sqrt(SPAN * WIDTH), (SPAN * WIDTH, FILTERS)).astype(f32),
        "bias": np.zeros(FILTERS, f32),
        "weights": rng.normal(0, 0.1, 2 * FILTERS).astype(f32),
        "offset": np.zeros(1, f32),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parts.items()}
    step = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            chosen, count = [], []
            for i in batch:
                starts, ends, _n = spots(np.array([0, len(texts[i])]))
                some = rng.permutation(len(starts))[:TRAIN_CHUNKS]
                chosen.append(cut(np.frombuffer(texts[i], dtype=np.uint8), starts[some], ends[some]))
                count.append(len(chosen[-1]))
            symbols, n = np.concatenate(chosen), np.array(count)
            model = Model(parts["embed"], parts["filters"], parts["bias"], parts["weights"], float(parts["offset"][0]))
            best, where, x = pooled(symbols, model)
            doc = document_features(best, n)
            p = 1 / (1 + np.exp(-np.clip(doc @ model.weights + model.offset, -30, 30)))
            g = ((p - labels[batch]) / len(batch)).astype(f32)
            owner = np.repeat(np.arange(len(n)), n)
            back = g[owner, None] * model.weights[None, :FILTERS] / n[owner, None]
            first = np.cumsum(n) - n
            top = doc[:, FILTERS:]
            lead = np.zeros_like(best)
            for d in range(len(n)):
                part = best[first[d] : first[d] + n[d]]
                lead[first[d] + part.argmax(axis=0), np.arange(FILTERS)] = (top[d] > 0) * g[d] * model.weights[FILTERS:]
            back = (back + lead) * (best > 0)
            per = x.reshape(len(symbols), -1, SPAN * WIDTH)
            seen = np.take_along_axis(per, where[:, :, None], axis=1)  # chunk, filter, window
            grad = {"weights": doc.T @ g, "offset": np.array([g.sum()]), "bias": back.sum(axis=0), "filters": np.einsum("cfw,cf->wf", seen, back)}
            into = (back[:, :, None] * model.filters.T[None]).reshape(-1, SPAN, WIDTH)
            at = where.reshape(-1)[:, None] * STRIDE + np.arange(SPAN)
            used = symbols[np.repeat(np.arange(len(symbols)), FILTERS)[:, None], at]
            grad["embed"] = np.zeros_like(parts["embed"])
            np.add.at(grad["embed"], used.ravel(), into.reshape(-1, WIDTH))
            step += 1
            for k, v in parts.items():
                m, s = moments[k]
                m += 0.1 * (grad[k] - m)
                s += 0.001 * (grad[k] ** 2 - s)
                v -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(f32)
    mean = labels.mean()
    shift = 0.0 if share is None else float(np.log(share / (1 - share)) - np.log(mean / (1 - mean)))
    return Model(parts["embed"], parts["filters"], parts["bias"], parts["weights"], float(parts["offset"][0]) + shift)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Fit on a bounded sample of the labelled rows where may_learn (of the id) holds."""
    known = labels.select(F.col(id_column), F.col(label_column).alias("y")).where(may_learn & F.col("y").isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(id_column).agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2 and y in (0, 1)").drop("y2")
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return fit([], np.array([float(k) for k in counts]))
    dice = F.pmod(F.xxhash64(F.col(id_column), F.lit(41)), F.lit(1 << 40)) / float(1 << 40)
    rate = F.when(F.col("y") == 0, min(1.0, PER_LABEL / counts[0])).otherwise(min(1.0, PER_LABEL / counts[1]))
    picked = known.withColumn("dice", dice).where(F.col("dice") < rate).orderBy("dice", id_column).limit(3 * PER_LABEL).drop("dice")  # so few ids can be broadcast
    rows = docs.select(id_column, F.coalesce(F.col(text_column), F.lit("")).alias("text")).join(F.broadcast(picked), id_column)
    data = F.col("text").cast("binary")
    size, piece = F.octet_length("text"), SEEN // PIECES
    spots = [F.floor((size - SEEN) * (k + F.pmod(F.xxhash64(F.col(id_column), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)) / PIECES).cast("int") + k * piece + 1 for k in range(PIECES)]
    part = F.when(size <= SEEN, data).otherwise(F.concat(*[F.substring(data, spot, piece) for spot in spots]))
    sample = rows.select(id_column, part.alias("part"), "y").orderBy(id_column, "part").limit(4 * PER_LABEL).collect()
    return fit([bytes(r["part"]) for r in sample], np.array([r["y"] for r in sample]), counts[1] / (counts[0] + counts[1]))


def scorer(model: Model):
    """The score of a text column, as an Arrow function: no other column goes to the workers."""

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        found = [score(data, offsets, model) for _, _, data, offsets in chunks(texts)]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return probability.asNondeterministic()  # so that a filter on the score doesn't compute it again


def predict(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """All columns of docs with `score` (in place of a column of that name), for every row."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"]
    return docs.select(*columns, scorer(model)(F.col(text_column)).alias("score"))
