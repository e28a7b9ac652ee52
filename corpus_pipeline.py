"""A training corpus from `documents`, in five stages; each reads what the one before has written.

Every stage keeps all columns of documents but the last, which gives the encoded documents. Null text, repeated
rows and empty tables are treated as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm import bpe, lines, mixing, quality, shingles
from skyloom.llm.common import crc_mod, fresh_path, table

#: Documents scored below it go.
LEAST_QUALITY = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    part = crc_mod("doc_id", 5)
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), F.expr(f"{part} <> 0"))
    return docs.where(quality.scorer(model)(F.col("text")) >= LEAST_QUALITY)


def free_names(docs: DataFrame, n: int) -> list[str]:
    """Names that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    return [name for name in (f"_{i}" for i in range(n + len(taken))) if name not in taken][:n]


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one repeats; one that consists of such lines alone goes."""
    before, after = free_names(docs, 2)
    out = lines.dedup_lines(docs, counts=(before, after)).where(f"{before} = 0 or {after} > 0").drop(before, after)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest key, of each component of the Jaccard join. A row's key is its id (null ids
    last), then a hash of its text, so rows that share an id or have none are told apart by text."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    (name,) = free_names(docs, 1)
    keyed = docs.withColumn(name, key)
    found = shingles.jaccard_components(keyed.select(name, "text"), id_column=name)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(first, name, "left_semi").dropDuplicates([name, "text"]).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix_sources(docs)

    def keys(unit: str) -> list:
        return [F.xxhash64(*[f"{unit}.{c}" for c in order]).alias(f"k{i}") for i, order in enumerate((("id", "source", "size"), ("size", "id", "id", "source")))]

    unit = F.struct(F.col("doc_id").alias("id"), "source", "size").alias("unit")
    units = taken.select(unit, "copies").select(*keys("unit"), "copies").groupBy("k0", "k1").agg(F.sum("copies").alias("c"), F.count("*").alias("m"))
    own = F.struct(F.col("doc_id").alias("id"), F.col("source"), mixing.sizes(F.col("text")).alias("size")).alias("unit")
    rows = docs.select(F.struct(*docs.columns).alias("row"), own).select("row", *keys("unit")).join(units, ["k0", "k1"])
    order = Window.partitionBy("k0", "k1").orderBy("row.text")
    rows = rows.withColumn("copies", F.expr("c div m") + F.when(F.row_number().over(order) <= F.expr("c % m"), 1).otherwise(0))
    return rows.where("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", classify), ("line_dedup", dedup_lines), ("jaccard", dedup_near), ("mixing", mix), ("bpe", encode)]

#: No stage but the mixing of whole sizes is within SQL's reach; the tests check them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
