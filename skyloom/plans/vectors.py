"""Queries over points, polygons and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import vectors as op
from ..registry import query
from ..sources.views import nodes, places, read, ways, zones

_INSIDE = """SELECT id, zone, name FROM (SELECT p.id, p.lon, p.lat, z.zone, z.name, unnest(range(len(ring))) AS i, z.ring FROM places p JOIN zones z ON p.lon BETWEEN cx - half AND cx + half AND p.lat BETWEEN cy - half AND cy + half)
  WHERE (ring[i + 1].lat > lat) <> (ring[(i + 1) % len(ring) + 1].lat > lat) AND lon < ring[i + 1].lon + (lat - ring[i + 1].lat) * (ring[(i + 1) % len(ring) + 1].lon - ring[i + 1].lon) / (ring[(i + 1) % len(ring) + 1].lat - ring[i + 1].lat)
  GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1"""


@query("point_in_polygon", f"SELECT id, zone FROM ({_INSIDE})", "places", "zones")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.point_in_polygon(places(spark, sf_dir).select("id", "lon", "lat"), zones(spark, sf_dir)).select("id", "zone")


@query("land_union", f"SELECT id, count(zone) > 0 AS land FROM places LEFT JOIN ({_INSIDE}) USING (id) GROUP BY 1", "places", "zones")
def land_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment in any polygon, instead of a union of geometries."""
    p = places(spark, sf_dir).select("id", "lon", "lat")
    hit = op.point_in_polygon(p, zones(spark, sf_dir)).select("id").distinct().withColumn("land", F.lit(True))
    return p.join(hit, "id", "left").select("id", F.coalesce("land", F.lit(False)).alias("land"))


_BIOMES = ((1, "LAND"), (2, "CHINA|CANADA|RUSSIA"), (3, "EGYPT|IRAN|IRAQ|ALGERIA"), (4, "^B.*L$|INDONESIA|PERU"))


@query("biome_overwrite", f"""SELECT id, coalesce(max(CASE WHEN regexp_matches(name, '(?i)INDONESIA|PERU|^B.*L$') THEN 4 WHEN regexp_matches(name, '(?i)EGYPT|IRAN|IRAQ|ALGERIA') THEN 3 WHEN regexp_matches(name, '(?i)CHINA|CANADA|RUSSIA') THEN 2 WHEN name IS NOT NULL THEN 1 END), 0) AS biome
  FROM places LEFT JOIN ({_INSIDE}) USING (id) GROUP BY 1""", "places", "zones")
def biome_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cover class of each point: later classes overwrite earlier ones, ocean where there is none."""
    z = zones(spark, sf_dir)
    kind = F.lit(1)
    for k, pattern in _BIOMES[1:]:
        kind = F.when(F.col("name").rlike(f"(?i){pattern}"), k).otherwise(kind)
    p = places(spark, sf_dir).select("id", "lon", "lat")
    hit = op.point_in_polygon(p, z.withColumn("biome", kind)).groupBy("id").agg(F.max("biome").alias("biome"))
    return p.join(hit, "id", "left").select("id", F.coalesce("biome", F.lit(0)).alias("biome"))


@query("bbox_slice", "SELECT zone, name FROM zones WHERE cx + half >= -30 AND cx - half <= 60 AND cy + half >= -20 AND cy - half <= 50", "zones")
def bbox_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones(spark, sf_dir).where("cx + half >= -30 and cx - half <= 60 and cy + half >= -20 and cy - half <= 50").select("zone", "name")


@query("iso_filter", "SELECT DISTINCT substr(upper(n_name), 1, 3) AS iso FROM nation WHERE n_name IS NOT NULL AND length(n_name) > 4 AND substr(upper(n_name), 1, 3) <> 'ALG'")
def iso_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = read(spark, sf_dir, "nation").where("n_name is not null and length(n_name) > 4").select(F.upper(F.substring("n_name", 1, 3)).alias("iso"))
    return iso.where("length(iso) = 3 and iso <> 'ALG'").distinct()


@query("admin_hierarchy", "SELECT zone, lvl, 'ADM' || lvl || '/' || name AS layer FROM zones CROSS JOIN range(0, 5) r(lvl) WHERE lvl = 0 OR lvl <= CASE WHEN half * half > 240 THEN 0 WHEN half * half > 160 THEN 1 WHEN half * half > 120 THEN 2 ELSE 3 END", "zones")
def admin_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries always, lower levels as far as the request's depth goes."""
    area = F.col("half") * F.col("half")
    depth = F.when(area > 240, 0).when(area > 160, 1).when(area > 120, 2).otherwise(3)
    levels = zones(spark, sf_dir).withColumn("lvl", F.explode(F.sequence(F.lit(0), depth)))
    return levels.select("zone", "lvl", F.concat(F.lit("ADM"), F.col("lvl"), F.lit("/"), F.col("name")).alias("layer"))


@query("labels_union", """SELECT 'country' AS kind, name AS n, 0 AS lvl FROM zones UNION ALL SELECT 'region', r_name, 1 FROM region UNION ALL SELECT 'city', coalesce(c_name, 'Unknown'), 2 FROM customer""", "zones")
def labels_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir).select(F.lit("country").alias("kind"), F.col("name").alias("n"), F.lit(0).alias("lvl"))
    r = read(spark, sf_dir, "region").select(F.lit("region").alias("kind"), F.col("r_name").alias("n"), F.lit(1).alias("lvl"))
    c = read(spark, sf_dir, "customer").select(F.lit("city").alias("kind"), F.coalesce("c_name", F.lit("Unknown")).alias("n"), F.lit(2).alias("lvl"))
    return z.unionByName(r).unionByName(c)


_UV = """SELECT zone, i, lon, lat, round(cos(radians(lat + 2)) * cos(radians(lon)), 9) AS x, round(cos(radians(lat + 2)) * sin(radians(lon)), 9) AS y, round(sin(radians(lat + 2)), 9) AS z FROM (SELECT zone, unnest(range(len(ring))) AS i, unnest(ring).lon AS lon, unnest(ring).lat AS lat FROM zones)"""


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = zones(spark, sf_dir).select("zone", F.posexplode("ring").alias("i", "p")).select("zone", "i", "p.lon", "p.lat")
    face, u, w = geo.face_uv(F.col("lon"), F.col("lat"))
    return v.select("zone", "i", face.alias("face"), u.alias("u"), w.alias("v"))


@query("face_buckets", f"""WITH d AS ({_UV}), f AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x > 0 THEN 0 ELSE 1 END WHEN abs(y) >= abs(x) AND abs(y) >= abs(z) THEN CASE WHEN y > 0 THEN 2 ELSE 3 END WHEN z > 0 THEN 4 ELSE 5 END AS face FROM d),
  t AS (SELECT zone, i, face, round_even((CASE face WHEN 0 THEN y / abs(x) WHEN 1 THEN -y / abs(x) WHEN 2 THEN -x / abs(y) WHEN 3 THEN x / abs(y) ELSE y / abs(z) END + 1) / 2, 6) AS u,
    round_even((CASE face WHEN 0 THEN -z / abs(x) WHEN 1 THEN -z / abs(x) WHEN 2 THEN -z / abs(y) WHEN 3 THEN -z / abs(y) WHEN 4 THEN x / abs(z) ELSE -x / abs(z) END + 1) / 2, 6) AS v FROM f)
  SELECT face, count(*) AS points, flatten(list([u, v] ORDER BY zone, i)) AS uv FROM t GROUP BY 1""", "zones")
def face_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.face_buckets(_vertices(spark, sf_dir), ["zone", "i"])


@query("osm_join_nodes", """WITH s AS (SELECT way, len(nodes) AS n, unnest(range(len(nodes))) AS pos, unnest(nodes) AS node FROM ways WHERE len(nodes) >= 3)
  SELECT way, n, count(lon) AS found, round(sum(round(6371000 * radians(lon - 2.3) * cos(radians(48.8)), 3) * (pos + 1)), 3) AS sum_x, round(sum(round(6371000 * radians(lat - 48.8), 3) * (pos + 1)), 3) AS sum_y FROM s LEFT JOIN nodes USING (node) GROUP BY 1, 2""", "ways", "nodes")
def osm_join_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each outline in order, checked by position-weighted sums."""
    w = ways(spark, sf_dir)
    spread = w.where("size(nodes) >= 3").select("way", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node"))
    x, y = geo.local_offset(F.col("lon"), F.col("lat"), F.lit(2.3), F.lit(48.8))
    met = spread.join(nodes(spark, sf_dir).select("node", F.round(x, 3).alias("x"), F.round(y, 3).alias("y")), "node", "left")
    return met.groupBy("way", "n").agg(F.count("x").alias("found"), F.round(F.sum(F.col("x") * (F.col("pos") + 1)), 3).alias("sum_x"), F.round(F.sum(F.col("y") * (F.col("pos") + 1)), 3).alias("sum_y"))


@query("outline_vertices", """WITH s AS (SELECT way, len(nodes) AS n, unnest(range(len(nodes))) AS pos, unnest(nodes) AS node FROM ways WHERE len(nodes) >= 3)
  SELECT way, n, count(lon) AS found, list(round(6371000 * radians(lon - 2.3) * cos(radians(48.8)), 3) ORDER BY pos) FILTER (lon IS NOT NULL) AS xs FROM s LEFT JOIN nodes USING (node) GROUP BY 1, 2 HAVING count(lon) > 0""", "ways", "nodes")
def outline_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op.ordered_nodes(ways(spark, sf_dir), nodes(spark, sf_dir), 2.3, 48.8)
    return d.where("found > 0").select("way", "n", "found", F.transform("verts", lambda p: p["x"]).alias("xs"))


_MATERIALS = (("urgent", 1), ("high", 2), ("medium", 3), ("low", 4))
_ROOFS = (("O", 1), ("F", 2))


@query("material_lookup", f"""SELECT way, coalesce(m.code, 0) AS material, coalesce(r.code, 0) AS roof FROM ways LEFT JOIN (VALUES {', '.join(map(str, _MATERIALS))}) m(material, code) USING (material) LEFT JOIN (VALUES {', '.join(map(str, _ROOFS))}) r(roof, code) USING (roof)""", "ways")
def material_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, ways(spark, sf_dir)).select("way", "material", "roof")


def _coded(spark: SparkSession, w: DataFrame) -> DataFrame:
    m = F.broadcast(spark.createDataFrame(list(_MATERIALS), "mat string, material int"))  # four rows
    r = F.broadcast(spark.createDataFrame(list(_ROOFS), "shape string, roof int"))  # two rows
    d = w.join(m, F.col("tags")["building:material"] == F.col("mat"), "left").join(r, F.col("tags")["roof:shape"] == F.col("shape"), "left")
    return d.na.fill(0, ["material", "roof"])


@query("building_height", "SELECT way, coalesce(TRY_CAST(height AS DOUBLE), coalesce(TRY_CAST(levels AS DOUBLE), 1) * 3.5) AS height FROM ways", "ways")
def building_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways(spark, sf_dir).select("way", op.height(F.col("tags")["height"], F.col("tags")["building:levels"]).alias("height"))


@query("osm_labels", "SELECT event_id AS id, (props::JSON ->> 'k')::INT AS k FROM events WHERE regexp_matches(event_type, '^(view|click)$') AND (props::JSON ->> 'k') IS NOT NULL")
def osm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements whose kind matches a pattern and that have the tag."""
    e = read(spark, sf_dir, "events").withColumn("tags", F.from_json("props", "map<string,string>"))
    return e.where(F.col("event_type").rlike("^(view|click)$") & F.col("tags")["k"].isNotNull()).select(F.col("event_id").alias("id"), F.col("tags")["k"].cast("int").alias("k"))


@query("osm_elements", "SELECT event_type AS type, count(*) AS n, max((props::JSON ->> 'k')::INT) AS most FROM events GROUP BY 1")
def osm_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.from_json("props", "k int").alias("p"))
    return e.groupBy("type").agg(F.count("*").alias("n"), F.max("p.k").alias("most"))


@query("payload_assemble", """SELECT key, coalesce(i.n, 0) AS images, coalesce(b.n, 0) AS buildings, coalesce(v.n, 0) AS labels FROM (SELECT l_suppkey % 150 AS key, count(*) AS n FROM lineitem GROUP BY 1) i
  FULL JOIN (SELECT o_custkey % 200 AS key, count(*) AS n FROM orders GROUP BY 1) b USING (key) FULL JOIN (SELECT c_custkey % 250 AS key, count(*) AS n FROM customer GROUP BY 1) v USING (key)""")
def payload_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imagery, buildings and labels of a request side by side, whichever are there."""
    parts = [("lineitem", "l_suppkey % 150", "images"), ("orders", "o_custkey % 200", "buildings"), ("customer", "c_custkey % 250", "labels")]
    out = None
    for name, key, column in parts:
        part = read(spark, sf_dir, name).groupBy(F.expr(key).alias("key")).agg(F.count("*").alias(column))
        out = part if out is None else out.join(part, "key", "full")
    return out.na.fill(0)


@query("expand_vertices", """SELECT way AS mesh, flatten(list([x, y, z, u, v] ORDER BY pos)) AS data FROM (SELECT way, unnest(range(len(nodes))) AS pos, unnest(nodes) AS node FROM ways)
  JOIN (SELECT p_partkey AS node, p_size::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS y, (p_partkey % 11)::DOUBLE AS z, 0.5::DOUBLE AS u, 0.25::DOUBLE AS v FROM part) USING (node) GROUP BY 1""", "ways")
def expand_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways(spark, sf_dir)
    v = read(spark, sf_dir, "part").selectExpr("p_partkey vertex", "cast(p_size as double) x", "cast(p_partkey % 7 as double) y", "cast(p_partkey % 11 as double) z", "0.5D u", "0.25D v")
    used = w.select(F.col("way").alias("mesh"), F.explode("nodes").alias("vertex")).distinct()
    return op.expand_vertices(w.select(F.col("way").alias("mesh"), F.col("nodes").alias("indices")), used.join(v, "vertex"))


@query("pack_buildings")
def pack_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways(spark, sf_dir)
    h = _coded(spark, w).select("way", "material", "roof", op.height(F.col("tags")["height"], F.col("tags")["building:levels"]).alias("height"))
    return op.pack_buildings(op.ordered_nodes(w, nodes(spark, sf_dir), 2.3, 48.8).join(h, "way"))


@query("polygon_clip")
def polygon_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.clipped(zones(spark, sf_dir), (-30.0, -20.0, 60.0, 50.0))


@query("representative_point", "SELECT zone, name AS n, round(list_avg([p.lon FOR p IN ring]), 6) AS lon, round(list_avg([p.lat FOR p IN ring]), 6) AS lat FROM zones", "zones")
def representative_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vertex, which lies within a convex ring."""
    mean = lambda k: F.aggregate(F.transform("ring", lambda p: p[k]), F.lit(0.0), lambda a, b: a + b) / F.size("ring")
    return zones(spark, sf_dir).select("zone", F.col("name").alias("n"), F.round(mean("lon"), 6).alias("lon"), F.round(mean("lat"), 6).alias("lat"))
