"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source's target is its share of the mix, at most `most` times its size; a document's expected number
of copies is target over source size. The whole part is taken for sure; the fractional parts are rounded
together: pairs of documents of a source transfer probability at random until one of the two is decided,
large documents first, in blocks of about BLOCK. What is left of each block, one document with some
probability, meets that of FAN other blocks in the next level, until a source has one such document, which
a last coin decides. Coins are hashes of the ids, so reruns agree whatever the partitioning.

Null text has size 0; documents of size 0 take nothing. Repeated rows share the copies their unit gets as
evenly as can be. Null is a source of its own, last. An empty table gives no rows; columns besides id,
source and text do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLOCK, FAN = 96, 64
WORD = r"[^\x20\x09-\x0D]+"


def sizes(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes_by_source: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with target: weights repeat over the sources in order, share of the total size in all;
    what is above `most` times a source's size is shared out again by weight until none is."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes_by_source.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("k", F.row_number().over(by))
    s = s.withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min_by(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("k"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def _fold(units: str, seed: int) -> str:
    """SQL that folds an array of units (size, id, m, whole, p) into the one still open and those decided."""
    unit = "named_struct('size', {0}.size, 'id', {0}.id, 'm', {0}.m, 'whole', {0}.whole, 'p', {1})"
    coin = f"pmod(xxhash64(s.open.id, b.id, s.open.size, b.size, {seed}), 9007199254740992) / 9007199254740992D"
    first = "if(x.t < 1, x.u * x.t < s.open.p, x.u * (2 - x.t) < 1 - b.p)"
    stays = f"((x.t < 1) = {first})"  # the open one stays open
    step = (
        f"transform(array(named_struct('t', s.open.p + b.p, 'u', {coin})), x -> named_struct("
        f"'open', if({stays}, {unit.format('s.open', 'if(x.t < 1, x.t, x.t - 1)')}, {unit.format('b', 'if(x.t < 1, x.t, x.t - 1)')}),"
        f"'done', concat(s.done, array(named_struct('unit', if({stays}, b, s.open), 'take', if(x.t < 1, 0L, 1L))))))[0]"
    )
    return f"aggregate(slice({units}, 2, size({units})), named_struct('open', {units}[0], 'done', slice(array(named_struct('unit', {units}[0], 'take', 0L)), 1, 0)), (s, b) -> {step})"


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), sizes(F.col(text_column)).alias("size"))
    units = saved(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "units")
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    per_source = saved(per_source, "sources")
    goal = targets(per_source.select("source", "source_size"), weights, share, most)
    goal = goal.join(per_source.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    goal = goal.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))).withColumnRenamed("source", "goal_source")
    found = units.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
    hope = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    found = found.withColumn("hope", hope).withColumn("whole", F.floor("hope")).withColumn("p", F.col("hope") - F.col("whole"))
    keys = ["source", "source_size", "target"]
    unit = F.struct("size", F.col("doc_id").alias("id"), "m", "whole", "p").alias("unit")
    open_now = (F.col("p") > 0) & (F.col("size") > 0)
    place = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("blocks")).alias("block")
    done = [found.where(~open_now).select(*keys, unit, F.lit(0).cast("long").alias("take"))]
    current = found.where(open_now).select(*keys, place, unit)
    most_blocks = per_source.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 1
    for level in range(1 + math.ceil(math.log(max(1, most_blocks), FAN))):
        folded = current.groupBy(*keys, "block").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        folded = saved(folded.select(*keys, "block", F.expr(_fold("units", seed + level)).alias("r")), f"level{level}")
        done.append(folded.select(*keys, F.explode("r.done").alias("d")).select(*keys, "d.unit", "d.take"))
        current = folded.select(*keys, F.floor(F.col("block") / FAN).alias("block"), F.col("r.open").alias("unit"))
    last = F.pmod(F.xxhash64("unit.id", "unit.size", F.lit(seed - 1)), F.lit(1 << 53)) / float(1 << 53)
    done.append(current.select(*keys, "unit", F.when(last < F.col("unit.p"), 1).otherwise(0).cast("long").alias("take")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.select(F.col("unit.id").alias("doc_id"), "source", F.col("unit.size").alias("size"), "source_size", "target", F.col("unit.m").alias("m"), (F.col("unit.whole") + F.col("take")).alias("all"))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.expr("`all` div m + if(i <= `all` % m, 1, 0)")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
