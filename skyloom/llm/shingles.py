"""Exact n-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes (64 bits) of its distinct runs of WORDS words; fewer words count as one run.
Two documents link when the intersection holds 75 % of the union or more. Equal sets form a class; only one
document of a class is compared with others:

- Active sets. Linked sets share k of the first |x| - ceil(0.75 |x|) + k shingles of either, in order of their hashes.
  Sets that share fewer (k is a quarter of that prefix) with all others together link with nothing and go. Shingles
  listed as heavy, from a sample, are known to be shared and not dealt out; the list decides speed only.
- Order. Among active sets each shingle is counted exactly, and all sets are sorted by one order: those in no other
  set first, then by count, heavy ones last. A set with more shingles of its own than a link allows goes, too.
- Prefix. Linked sets share a shingle among the first |x| - ceil(0.75 |x|) + 1 of either. Rare ones there are keys
  alone. Where they don't fill the prefix, it is extended by a shingle for each of the groups that frequent ones
  are dealt to by hash, and combinations of two of a group are keys: removing as many as a link allows leaves a rare
  one or two of a group.
- Candidates. A key's row tells the place in the set, so that a pair has to share it where the sizes of both still
  allow a link, which leaves hardly more pairs than links. The documents of a key are first compared with one of them,
  its hub; links found join documents in components. Other hubs are drawn for what is still apart, HUBS times in all;
  then each document outside the largest component of its key meets all of the key's in other components. So every
  pair that may link is either verified or known to be connected.
  jaccard_links has no such shortcut: it verifies every pair that shares a key, and gives the links themselves.
- Verification intersects the whole sorted sets.

Null or blank text has an empty set, which links with nothing. Repeated rows and rows with equal sets share a
component. Null ids take part, but a component's id is null only if all its ids are. Very long texts are read whole;
columns besides id and text do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, mix, release, saved, words
from .components import joined

WORDS, PER_CENT = 5, 75
#: One text in SAMPLE is searched for heavy shingles: those that HEAVY texts or more of it have, the LISTED most frequent.
SAMPLE, HEAVY, LISTED = 16, 8, 1 << 20
#: Shingles in more active sets than this are frequent.
FREQUENT, HUBS = 128, 2
_EMPTY = np.zeros(0, dtype=np.uint64)


def sets(column: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    weights = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(size)], dtype=np.uint64)
    for at, end, data, offsets in chunks(column):
        rows, h = words(data, offsets)
        count = np.bincount(rows, minlength=end - at)
        n = max(0, len(h) - size + 1)
        runs = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            runs += h[k : k + n] * weights[k]
        runs = mix(runs)
        first = np.cumsum(count) - count
        for f, c in zip(first.tolist(), count.tolist(), strict=True):
            if c >= size:
                yield np.unique(runs[f : f + c - size + 1])
            elif c:
                yield mix((h[f : f + c] * weights[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c))
            else:
                yield _EMPTY


def least_shared(n: int, per_cent: int = PER_CENT) -> int:
    """The fewest shingles that a set of n has in common with one it links with."""
    return -(-per_cent * n // 100)


def first_look(own: np.ndarray, per_cent: int = PER_CENT) -> tuple[np.ndarray, int]:
    """A set's first shingles by hash, and how many of them an active set shares with others."""
    n = len(own)
    lost = n - least_shared(n, per_cent)
    k = min(max(1, (lost + 1) // 4), n - lost)
    return own[: lost + k], k


def is_in(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are in a sorted list."""
    if not len(listed):
        return np.zeros(len(values), dtype=bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def groups(m: int) -> int:
    """How many groups frequent shingles are dealt to where the larger set of a pair has m: so many that a set has at
    most some eight combinations a shingle. 0: all count as rare."""
    return 4 ** max(0, (m.bit_length() - 7) // 2) if m >= 8 else 0


def keys_of(n: int, alone: int, shared: np.ndarray, rare: int, per_cent: int = PER_CENT) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set of n shingles, and the place of each in the set.

    alone: its shingles that no other set has; shared: the others in the common order, the first `rare` of them rare.
    The first shingle of each group of frequent ones does not count for the places of combinations.
    """
    lost = n - least_shared(n, per_cent)
    need = lost + 1 - alone
    if need <= 0:
        return _EMPTY, np.zeros(0, np.int64)
    if rare >= need or per_cent < 50:
        return shared[:need], alone + np.arange(min(need, len(shared)))
    keys, places = [shared[:rare]], [alone + np.arange(rare)]
    rest = shared[rare:]
    largest = 100 * n // per_cent
    for g in {groups(n), groups(largest)}:
        if not g:
            keys.append(rest[: need - rare])
            places.append(alone + rare + np.arange(len(keys[-1])))
            continue
        group = ((rest >> np.uint64(40)) % np.uint64(g)).astype(np.int64)
        counted = np.ones(len(rest), dtype=np.int64)
        counted[np.unique(group, return_index=True)[1]] = 0
        credit = np.cumsum(counted)
        end = int(np.searchsorted(credit, need - rare)) + 1
        order = np.argsort(group[:end], kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(group[:end][order])) + 1):
            a, b = np.triu_indices(len(members), 1)
            a, b = members[a], members[b]
            keys.append(mix(rest[a] * np.uint64(0x9E3779B97F4A7C15) + mix(rest[b] + np.uint64(g))))
            places.append(alone + rare + credit[b] - 1)
    return np.concatenate(keys), np.concatenate(places)


def links(x: bytes, y: bytes, per_cent: int = PER_CENT) -> bool:
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= per_cent * (len(x) + len(y) - both)


def _heavy(docs: DataFrame, size: int) -> np.ndarray:
    """Heavy shingles, least frequent first; for speed alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sets(batch.column(0), size))
            if found:
                value, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], names=["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    found = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY)
    found = found.orderBy(F.col("n").desc(), "h").limit(LISTED).toArrow()  # at most LISTED rows of 16 bytes
    return found.column("h").to_numpy().view(np.uint64)[::-1].copy()


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set that equal sets share."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _flat(nodes: pa.Array, lists: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (node, key), one for each value of each node's list."""
    node = np.repeat(nodes.to_numpy(), [len(x) for x in lists])
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([_EMPTY, *lists]).view(np.int64))], names=["node", "key"])


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows (node, key) whose key another node has, with the number of its nodes."""
    by = Window.partitionBy("key")
    return keyed.select("node", "key", F.count("*").over(by).cast("int").alias("df")).where("df > 1")


def _indexed(docs: DataFrame, size: int, per_cent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every row (doc_id, n, node, s2), the classes (n, node, s2, class_id, rows), the active sets (node, own), and the
    index (key, node, n, alone, place) of sets that may link."""
    heavy = _heavy(docs, size)
    by_hash = np.sort(heavy)
    rank = np.empty(len(heavy), dtype=np.int64)
    rank[np.searchsorted(by_hash, heavy)] = np.arange(len(heavy))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows = []
            for s in sets(part.column(2), size):
                prefix, k = first_look(s, per_cent)
                known = is_in(prefix, by_hash)
                rows.append((len(s), *_signature(s), k - int(known.sum()), prefix[~known].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=["doc_id", "hash", "n", "node", "s2", "more", "keys"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield _flat(part.column(0), [np.frombuffer(k.as_buffer(), dtype=np.uint64) for k in part.column(1)])

    hashed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    read = hashed.mapInArrow(look, f"doc_id {kind}, hash long, n long, node long, s2 long, more long, keys binary")
    own_first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    reps = read.where("n > 0").groupBy("n", "node", "s2").agg(F.min(own_first).alias("rep"), F.count("*").alias("rows"), F.first("more").alias("more"), F.first("keys").alias("keys"))
    reps = saved(reps, "reps", rows=1000)
    # read again, as a table with the keys would be half as large as the input
    rows = saved(read.select("doc_id", "n", "node", "s2"), "rows", rows=1000)
    met = _shared(reps.select("node", "keys").mapInArrow(spread, "node long, key long")).groupBy("node").agg(F.count("*").alias("met"))
    active = reps.join(met, "node", "left").where(F.coalesce("met", F.lit(0)) >= F.col("more")).select("node", "n", "rep.doc_id", "rep.hash")
    active = saved(active, "active")
    classes, old = saved(reps.select("n", "node", "s2", F.col("rep.doc_id").alias("class_id"), "rows"), "classes"), reps
    release(old)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = list(sets(part.column(1), size))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "own"])

    def uncommon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [np.frombuffer(k.as_buffer(), dtype=np.uint64) for k in part.column(1)]
            yield _flat(part.column(0), [s[~is_in(s, by_hash)] for s in found])

    wanted = active.select("node", F.col("doc_id").alias("id"), F.col("hash").alias("own_hash"))
    texts = hashed.join(wanted, (F.col("hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    # rows repeated with their ids give their set more than once
    own = saved(texts.mapInArrow(whole, "node long, own binary").groupBy("node").agg(F.first("own").alias("own")), "own", rows=1000)
    counted = _shared(own.mapInArrow(uncommon, "node long, key long")).groupBy("node").agg(F.collect_list("df").alias("df"), F.collect_list("key").alias("keys"))
    counted = saved(counted, "counted")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            out = []
            for node, own, df, key in zip(part.column(0).to_pylist(), *part.columns[1:], strict=True):
                s = np.frombuffer(own.as_buffer(), dtype=np.uint64)
                common = s[is_in(s, by_hash)]
                common = common[np.argsort(rank[np.searchsorted(by_hash, common)])]
                times = df.values.to_numpy() if df.is_valid else np.zeros(0, np.int32)
                others = key.values.to_numpy().view(np.uint64) if df.is_valid else _EMPTY
                order = np.lexsort((others, times))
                shared = np.concatenate((others[order], common))
                alone = len(s) - len(shared)
                keys, places = keys_of(len(s), alone, shared, int((times <= FREQUENT).sum()), per_cent)
                out.append((keys.view(np.int64), np.full(len(keys), node), np.full(len(keys), len(s)), np.full(len(keys), alone), places))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(5)], names=["key", "node", "n", "alone", "place"])

    keyed = own.join(counted, "node", "left").select("node", "own", "df", "keys").mapInArrow(index, "key long, node long, n long, alone long, place long")
    keyed = saved(keyed, "index")
    release(counted, active)
    return rows, classes, own, keyed


def _meet(per_cent: int) -> str:
    """SQL: whether sets that share a key at these places may link by it."""
    need = f"(({per_cent} * (n + n2) + {99 + per_cent}) div {100 + per_cent})"
    return f"place <= n - {need} and place2 <= n2 - {need} and least(n - alone, n2 - alone2) >= {need}"


def _verified(pairs: DataFrame, own: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            good = [links(x.as_buffer(), y.as_buffer(), per_cent) for x, y in zip(part.column(2), part.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = own.select(F.col("node").alias("a"), F.col("own").alias("x")), own.select(F.col("node").alias("b"), F.col("own").alias("y"))
    return saved(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def jaccard_components(docs: DataFrame, *, size: int = WORDS, per_cent: int = PER_CENT, hubs: int = HUBS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row: class_id is the smallest id of an equal set,
    component_id the smallest reachable by links."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows, classes, own, index = _indexed(docs, size, per_cent)
    # the first hub is a set with few shingles of its own, which others may be made from
    labels = joined(index, lambda pairs: _verified(pairs, own, per_cent), columns=("n", "alone", "place"), may=_meet(per_cent), first=F.col("alone"), hubs=hubs)
    if labels is None:
        named = classes.withColumn("component_id", F.col("class_id"))
    else:
        merged = classes.select("node", "class_id").join(labels, "node")
        smallest = merged.groupBy("label").agg(F.min("class_id").alias("component_id"))
        merged = merged.join(smallest, "label").select("node", "component_id")
        named = classes.join(merged, "node", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    named = saved(named.select("n", "node", "s2", "class_id", "component_id"), "named")
    out = rows.join(named, ["n", "node", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_links(docs: DataFrame, *, size: int = WORDS, per_cent: int = PER_CENT, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join, without the shortcut for pairs that are connected through others.

    Returns (doc_id, n_shingles, node, n_links) of every row, and the links (node, other, node < other) of different sets.
    Rows of one node have equal sets (null: the empty set). A row's links are its node's other rows and all rows of the
    nodes that its node links with. The links of a group of near copies are as many as its pairs.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows, classes, own, index = _indexed(docs, size, per_cent)
    other = index.select("key", F.col("node").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("n", "alone", "place")])
    pairs = index.withColumnRenamed("node", "a").join(other, "key").where(f"a < b and {_meet(per_cent)}").select("a", "b").distinct()
    linked = _verified(saved(pairs, "pairs"), own, per_cent)
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("node").alias("b"), "rows"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("rows").alias("others"))
    counts = classes.join(others, "node", "left").select("node", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    members = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")).join(counts, "node", "left")
    return members.select("doc_id", "n_shingles", "node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), linked.select(F.col("a").alias("node"), F.col("b").alias("other"))
