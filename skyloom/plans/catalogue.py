"""Catalogue queries over granule names made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as op
from ..registry import query
from ..sources.views import frames_px, granules, read


@query("date_list", "SELECT i::INT AS age, (DATE '2024-03-01' - 120 - i::INT)::DATE AS day FROM range(60) r(i)")
def date_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dates(spark, "2024-03-01", 120, 60)


@query("tile_grid", "SELECT r AS tile_r, c AS tile_c, r < 9 AS night FROM range(10) a(r) CROSS JOIN range(20) b(c)")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The land grid; the night grid has the first nine rows."""
    return spark.range(200).selectExpr("cast(id div 20 as int) tile_r", "cast(id % 20 as int) tile_c", "id div 20 < 9 night")


@query("fetch_plan", """WITH have AS (SELECT DISTINCT tile_r, tile_c, frame FROM frames_px) SELECT r AS tile_r, c AS tile_c, m AS frame FROM range(10) a(r) CROSS JOIN range(20) b(c) CROSS JOIN range(61, 145) d(m)
  WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.tile_r = r AND have.tile_c = c AND have.frame = m)""", "frames_px")
def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile-frames of dates x tiles that are not there yet."""
    plan = spark.range(200).selectExpr("cast(id div 20 as int) tile_r", "cast(id % 20 as int) tile_c").withColumn("frame", F.explode(F.sequence(F.lit(61), F.lit(144))))
    return plan.join(frames_px(spark, sf_dir).select("tile_r", "tile_c", "frame").distinct(), ["tile_r", "tile_c", "frame"], "left_anti")


@query("first_layer", """SELECT tile_r, tile_c, frame, arg_min(layer, n) AS layer FROM (SELECT DISTINCT tile_r, tile_c, frame, x + 2 * y AS n, ['a', 'b', 'c', 'd'][x + 2 * y + 1] AS layer FROM frames_px WHERE red > 100) GROUP BY 1, 2, 3""", "frames_px")
def first_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several layers for a tile and date the first that works."""
    n = F.col("x") + 2 * F.col("y")
    return frames_px(spark, sf_dir).where("red > 100").groupBy("tile_r", "tile_c", "frame").agg(F.get(F.array(*map(F.lit, "abcd")), F.min(n)).alias("layer"))


@query("latest_granule", """SELECT product, bucket, id FROM (SELECT product, date_trunc('hour', slot) AS bucket, id, row_number() OVER (PARTITION BY product ORDER BY date_trunc('hour', slot) DESC, last_modified DESC, id DESC) AS k FROM granules) WHERE k = 1""", "granules")
def latest_granule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last modified file of each product's newest hour."""
    return op.newest_bucket(granules(spark, sf_dir), ["product"], F.date_trunc("hour", "slot"), "id", ["last_modified"])


@query("complete_slot", """WITH s AS (SELECT product, date_trunc('day', slot) AS slot, id % 10 AS part FROM granules), c AS (SELECT product, slot FROM s GROUP BY 1, 2 HAVING count(DISTINCT part) = 10),
  m AS (SELECT product, max(slot) AS slot FROM c GROUP BY 1) SELECT product, slot, list(DISTINCT part ORDER BY part) AS parts FROM s JOIN m USING (product, slot) GROUP BY 1, 2""", "granules")
def complete_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest day on which all ten segments of a product arrived."""
    g = granules(spark, sf_dir).select("product", F.date_trunc("day", "slot").alias("slot"), (F.col("id") % 10).alias("part"))
    return op.complete_slots(g, ["product"], "slot", "part", 10)


@query("slot_windows", "SELECT slot AS slot_start, slot + INTERVAL 10 MINUTE AS slot_end, count(*) AS n, count(DISTINCT product) AS products FROM granules GROUP BY 1, 2", "granules")
def slot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("products"))
    return e.select(F.col("w.start").alias("slot_start"), F.col("w.end").alias("slot_end"), "n", "products")


_KEY = "split_part(name, '.', 2) || '.' || split_part(name, '.', 3)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return granules(spark, sf_dir).withColumn("key", F.regexp_extract("name", r"\.(A\d{7}\.\d{4})\.", 1)).withColumn("head", F.split_part("name", F.lit("."), F.lit(1)))


@query("granule_keys", f"SELECT DISTINCT split_part(name, '.', 1) AS head, {_KEY} AS key, substr(split_part(name, '.', 2), 6)::INT AS day_of_year, split_part(name, '.', 3)::INT // 100 AS hour FROM granules", "granules")
def granule_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition times taken from file names."""
    g = _named(spark, sf_dir).select("head", "key").distinct()
    return g.select("head", "key", F.substring("key", 6, 3).cast("int").alias("day_of_year"), F.substring("key", 10, 2).cast("int").alias("hour"))


@query("pair_granules", f"""WITH g AS (SELECT {_KEY} AS key, split_part(name, '.', 1) AS head, name, id FROM granules),
  d AS (SELECT key, min(name || '#' || id % 3) AS data FROM g WHERE head IN ('CLICK', 'VIEW') GROUP BY 1), o AS (SELECT key, min(name || '#' || id % 3) AS geo FROM g WHERE head NOT IN ('CLICK', 'VIEW') GROUP BY 1)
  SELECT key, data, geo FROM d JOIN o USING (key) ORDER BY key DESC LIMIT 100""", "granules")
def pair_granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest (data, geolocation) pairs by time key."""
    g = _named(spark, sf_dir).withColumn("file", F.concat("name", F.lit("#"), F.col("id") % 3))
    return op.pair(g, F.col("head").isin("CLICK", "VIEW"), "key", "file", 100)


@query("unseen_granules", f"SELECT id, {_KEY} AS key FROM granules WHERE id % 5 <> 1 AND {_KEY} NOT IN (SELECT {_KEY} FROM granules WHERE id % 5 = 1)", "granules")
def unseen_granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file in five was seen before; all others are asked for."""
    g = _named(spark, sf_dir)
    return g.where("id % 5 <> 1").select("id", "key").join(g.where("id % 5 = 1").select("key"), "key", "left_anti").select("id", "key")


@query("strip_pairs", f"""SELECT id, key, geo FROM (SELECT a.id, a.key, b.id AS geo, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS k FROM (SELECT id, {_KEY} AS key FROM granules WHERE id % 2 = 0) a
  JOIN (SELECT id, {_KEY} AS key FROM granules WHERE id % 2 = 1) b USING (key)) WHERE k = 1""", "granules")
def strip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even files are strips, odd ones geolocation, as in catalog_join."""
    g = _named(spark, sf_dir)
    geo = g.where("id % 2 = 1").groupBy("key").agg(F.min("id").alias("geo"))
    return g.where("id % 2 = 0").select("id", "key").join(geo, "key").select("id", "key", "geo")


@query("catalog_join", f"""SELECT r.key, r.files, g.geo FROM (SELECT {_KEY} AS key, count(*) AS files FROM granules WHERE id % 2 = 0 GROUP BY 1) r JOIN (SELECT {_KEY} AS key, arg_max(id, id) AS geo FROM granules WHERE id % 2 = 1 GROUP BY 1) g USING (key)""", "granules")
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radiances with the last geolocation file of their key."""
    g = _named(spark, sf_dir)
    rad = g.where("id % 2 = 0").groupBy("key").agg(F.count("*").alias("files"))
    return rad.join(g.where("id % 2 = 1").groupBy("key").agg(F.max("id").alias("geo")), "key")


@query("scene_topk", "SELECT c_custkey AS item, round(c_acctbal, 2) AS cloud FROM customer WHERE c_custkey % 360 BETWEEN 10 AND 200 AND c_nationkey BETWEEN 3 AND 20 ORDER BY c_acctbal, c_custkey LIMIT 12")
def scene_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve least cloudy scenes whose box overlaps the request."""
    c = read(spark, sf_dir, "customer").where("c_custkey % 360 between 10 and 200 and c_nationkey between 3 and 20")
    return c.orderBy("c_acctbal", "c_custkey").limit(12).select(F.col("c_custkey").alias("item"), F.round("c_acctbal", 2).alias("cloud"))


_CHANNELS = (("click", "C13"), ("view", "B13"), ("purchase", "M15"), ("signup", "IR_108"))


@query("reader_channels", f"SELECT product, coalesce(channel, 'unknown') AS channel, count(*) AS n FROM granules LEFT JOIN (VALUES {', '.join(map(str, _CHANNELS))}) t(product, channel) USING (product) GROUP BY 1, 2", "granules")
def reader_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The infrared channel each reader decodes."""
    dim = F.broadcast(spark.createDataFrame(list(_CHANNELS), "product string, channel string"))  # four rows
    return granules(spark, sf_dir).join(dim, "product", "left").groupBy("product", F.coalesce("channel", F.lit("unknown")).alias("channel")).agg(F.count("*").alias("n"))


@query("file_hash", "SELECT product, md5(string_agg(name || '_' || floor(epoch(last_modified))::BIGINT, '' ORDER BY name || '_' || floor(epoch(last_modified))::BIGINT)) AS digest, count(*) AS files FROM granules GROUP BY 1", "granules")
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.digest(granules(spark, sf_dir), ["product"], F.col("name"), F.unix_timestamp("last_modified").cast("string"))


@query("stale_victims", "SELECT id FROM granules WHERE epoch(TIMESTAMP '2024-01-20') - floor(epoch(last_modified)) > 84600", "granules")
def stale_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stale(granules(spark, sf_dir), "2024-01-20 00:00:00", 84600).select("id")


@query("freshness", "SELECT product, count(*) FILTER (epoch(TIMESTAMP '2024-02-01') - floor(epoch(last_modified)) < 864000) AS fresh, count(*) AS files FROM granules GROUP BY 1", "granules")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp("last_modified")
    return granules(spark, sf_dir).groupBy("product").agg(F.count_if(age < 864000).alias("fresh"), F.count("*").alias("files"))


@query("chunk_tens", "SELECT product, chunk, list(id ORDER BY r) AS items FROM (SELECT product, id, row_number() OVER w - 1 AS r, (row_number() OVER w - 1) // 10 AS chunk FROM granules WINDOW w AS (PARTITION BY product ORDER BY name, id)) GROUP BY 1, 2 HAVING count(*) = 10", "granules")
def chunk_tens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.chunks(granules(spark, sf_dir), ["product"], ["name", "id"], "id", 10)


@query("files_by_key", f"SELECT {_KEY} AS key, list(id ORDER BY id) AS ids FROM granules GROUP BY 1", "granules")
def files_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))


@query("cache_lookup", "SELECT product, count(*) AS hits FROM granules WHERE md5(name)[1:1] = 'a' GROUP BY 1", "granules")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached layers found by their file hash."""
    return granules(spark, sf_dir).where(F.substring(F.md5("name"), 1, 1) == "a").groupBy("product").agg(F.count("*").alias("hits"))


@query("first_product", "SELECT product, min(name) AS name FROM granules GROUP BY 1 ORDER BY product LIMIT 1", "granules")
def first_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return granules(spark, sf_dir).groupBy("product").agg(F.min("name").alias("name")).orderBy("product").limit(1)


@query("faces_complete", "SELECT tile_r, count(DISTINCT (y * 2 + x + frame) % 6) = 6 AS complete FROM frames_px GROUP BY 1", "frames_px")
def faces_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = (F.col("y") * 2 + F.col("x") + F.col("frame")) % 6
    return frames_px(spark, sf_dir).groupBy("tile_r").agg((F.countDistinct(face) == 6).alias("complete"))
