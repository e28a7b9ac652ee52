"""Connected components of a table of links, by contraction, and the join of what shares keys into components.

Every round maps each node to the smallest of itself and its neighbours (and that one's), and replaces the ends of the links
by what they are mapped to, so links within a component vanish; the smallest node of a component is never mapped to
another. Each round writes its tables to the shared folder, so lineage stays short and nothing is collected; tables that
are done with are deleted. Links from or to null are left out; without links there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, saved


def _renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows with a column's values replaced by the labels that names (node, label) has for them."""
    names = names.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(names, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_label", column)).drop("_node", "_label")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node reachable from each node that has a link. Links may repeat, in either direction."""

    def plain(rows: DataFrame) -> DataFrame:
        return rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left = saved(plain(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    rounds: list[DataFrame] = []
    while not rounds or left.limit(1).count():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        near = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
        near = saved(near, "near")
        rounds.append(saved(_renamed(near, "label", near), "mapped"))
        release(near)
        old, left = left, saved(plain(_renamed(_renamed(left, "a", rounds[-1]), "b", rounds[-1])), "links")
        release(old)
    labels = rounds[0]
    for later in rounds[1:]:
        labels = _renamed(labels, "label", later)
    if len(rounds) > 1:
        labels = saved(labels, "labels")
        release(*rounds)
    release(left)
    return labels


def joined(index: DataFrame, verify: Callable[[DataFrame], DataFrame], *, columns: tuple[str, ...] = (), may: str = "true", first: Column | None = None, hubs: int = 2) -> DataFrame | None:
    """(node, label) of the nodes that have a link, where nodes (key, node, columns) that share a key may have one; None
    without links.

    verify gives the links among pairs (a, b). may, of the columns of both (those of the other end in 2), tells pairs that
    can link. The nodes of a key are first compared with one of them, its hub (the least by `first`), so a key of any size
    gives a pair a row; other hubs are drawn for what is still apart, hubs times in all. Then each node outside its
    key's largest component meets all of the key's in other components: every pair that shares a key and may link is
    verified, or its nodes are known to be connected.
    """
    tried: list[DataFrame] = []
    labels: DataFrame | None = None

    def met(pairs: DataFrame) -> None:
        nonlocal labels
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        tried.append(saved(pairs, "pairs"))
        linked = verify(tried[-1])
        if not linked.limit(1).count():
            return
        if labels is None:
            labels = components(linked, "a", "b")
        else:
            new = components(_renamed(_renamed(linked, "a", labels), "b", labels), "a", "b")
            labels = saved(_renamed(labels.unionByName(new.withColumn("label", F.col("node"))).distinct(), "label", new), "labels")

    def apart() -> DataFrame:
        """The index with labels, of the keys with nodes in several components."""
        if labels is None:
            return index.withColumn("label", F.col("node"))
        named = index.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        split = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        return saved(named.join(split, "key"), "apart")

    other = [F.col(c).alias(f"{c}2") for c in ("label", *columns)]
    for turn in range(hubs):
        left = apart()
        draw = F.struct(F.lit(0) if turn or first is None else first, F.xxhash64("label", F.lit(turn)), F.xxhash64("node", F.lit(turn)))
        hub = left.groupBy("key").agg(F.min_by(F.struct("node", "label", *columns), draw).alias("h")).select("key", "h.*")
        hub = hub.select("key", F.col("node").alias("b"), *other)
        met(left.join(hub, "key").where(f"label <> label2 and {may}").select(F.col("node").alias("a"), "b"))
    left = apart()
    each = left.groupBy("key", "label").agg(F.count("*").alias("size"))
    main = each.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    outside = left.join(main, "key").where("label <> main").withColumnRenamed("node", "a")
    inside = left.select("key", F.col("node").alias("b"), *other)
    # of two nodes outside the key's largest component, one is enough to bring the pair
    met(outside.join(inside, "key").where(f"label <> label2 and (a < b or label2 = main) and {may}").select("a", "b"))
    release(*tried)
    return labels
