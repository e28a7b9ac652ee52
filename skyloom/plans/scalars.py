"""String, date, map and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.views import read


@query("url_parts", "SELECT page_id, split_part(url, '/', 3) AS host, split_part(split_part(url, '/', 5), '?', 1) AS page, starts_with(url, 'https') AS secure, regexp_matches(split_part(split_part(url, '/', 5), '?', 1), '^[0-9]+$') AS numeric_page FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.split_part(F.split_part("url", F.lit("/"), F.lit(5)), F.lit("?"), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), part.alias("page"), F.startswith("url", F.lit("https")).alias("secure"), part.rlike("^[0-9]+$").alias("numeric_page"))


@query("segment_number", "SELECT doc_id, source, substr(source, 4)::INT AS segment, replace(upper(source), 'SRC', 'S') || lpad(substr(source, 4), 2, '0') AS label FROM documents")
def segment_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("source", 4, 9)
    return read(spark, sf_dir, "documents").select("doc_id", "source", n.cast("int").alias("segment"), F.concat(F.replace(F.upper("source"), F.lit("SRC"), F.lit("S")), F.lpad(n, 2, "0")).alias("label"))


@query("iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, dayofyear(ts) AS day_of_year, strftime(ts, '%Y%j.%H%M') AS stamp FROM events")
def iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.dayofyear("ts").cast("long").alias("day_of_year"), F.date_format("ts", "yyyyDDD.HHmm").alias("stamp"))


@query("name_hint", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END, 'Unknown') AS label FROM customer")
def name_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first column that has a name, in order of preference."""
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.expr("if(c_custkey % 3 = 0, null, c_name)"), F.expr("if(c_custkey % 5 = 0, null, c_mktsegment)"), F.lit("Unknown")).alias("label"))


@query("face_paths", "SELECT upper(r_name) AS layer, face, lower(replace(r_name, ' ', '_')) || '/face_' || face || '.ktx2' AS path FROM region CROSS JOIN (SELECT unnest(['px', 'nx', 'py', 'ny', 'pz', 'nz']) AS face)")
def face_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of a layer's six faces."""
    r = read(spark, sf_dir, "region").withColumn("face", F.explode(F.array(*map(F.lit, ("px", "nx", "py", "ny", "pz", "nz")))))
    return r.select(F.upper("r_name").alias("layer"), "face", F.concat(F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit("/face_"), "face", F.lit(".ktx2")).alias("path"))


@query("tag_default", "SELECT event_id, coalesce((props::JSON ->> 'k')::INT, -1) AS k, coalesce(props::JSON ->> 'missing', 'none') AS other FROM events")
def tag_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events").withColumn("t", F.from_json("props", "map<string,string>"))
    return t.select("event_id", F.coalesce(F.col("t")["k"].cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.col("t")["missing"], F.lit("none")).alias("other"))


@query("mask_union", "SELECT doc_id, n_chars > 4000 OR lang = 'de' OR doc_id % 9 = 0 AS any_mask, n_chars > 4000 AND NOT lang = 'de' AS difference FROM documents")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, long, german = read(spark, sf_dir, "documents"), F.col("n_chars") > 4000, F.col("lang") == "de"
    return d.select("doc_id", (long | german | (F.col("doc_id") % 9 == 0)).alias("any_mask"), (long & ~german).alias("difference"))


@query("distinct_sources", "SELECT DISTINCT lang, source FROM documents")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("lang", "source").distinct()
