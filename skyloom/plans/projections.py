"""Projection queries over points, tiles and face grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..registry import query
from ..sources.views import camera, frames_px, layers, places

N = 16


def _grid(spark: SparkSession, names: list[str], n: int = N) -> DataFrame:
    faces = F.explode(F.array(*[F.struct(F.lit(i).alias("face_no"), F.lit(f).alias("face")) for i, f in enumerate(names)])).alias("f")
    return spark.range(n * n).selectExpr(f"cast(id div {n} as int) y", f"cast(id % {n} as int) x").select("y", "x", faces).select("f.face_no", "f.face", "y", "x")


def _r(**columns: Column) -> list[Column]:
    return [F.round(c, 6).alias(k) for k, c in columns.items()]


def _face_sql(faces: dict, u: str, v: str) -> str:
    """x, y, z columns of face points as SQL."""
    out = []
    for axis, name in enumerate("abc"):
        out.append("CASE face " + " ".join(f"WHEN '{f}' THEN {t[axis][0]} + {t[axis][1]} * {u} + {t[axis][2]} * {v}" for f, t in faces.items()) + f" END AS d{name}")
    return ", ".join(out)


def _grid_sql(names: list[str], n: int = N) -> str:
    return f"SELECT list_position({names}, face) - 1 AS face_no, face, y, x FROM (SELECT unnest({names}) AS face) CROSS JOIN range({n}) a(y) CROSS JOIN range({n}) b(x)"


@query("tile_bounds", "SELECT r AS tile_r, c AS tile_c, (90 - 18 * r)::DOUBLE AS north, (72 - 18 * r)::DOUBLE AS south, (18 * c - 180)::DOUBLE AS west, (18 * c - 162)::DOUBLE AS east FROM range(10) a(r) CROSS JOIN range(20) b(c)")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(200).selectExpr("cast(id div 20 as int) tile_r", "cast(id % 20 as int) tile_c")
    return t.selectExpr("tile_r", "tile_c", "90D - 18 * tile_r north", "72D - 18 * tile_r south", "18D * tile_c - 180 west", "18D * tile_c - 162 east")


@query("pixel_centres", "SELECT r AS tile_r, y, x, round(90 - 18 * r - (y + 0.5) * 18 / 8, 6) AS lat, round(-180 + (x + 0.5) * 18 / 8, 6) AS lon FROM range(10) a(r) CROSS JOIN range(8) b(y) CROSS JOIN range(8) c(x)")
def pixel_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitude and longitude of the pixel centres of the first tile column."""
    t = spark.range(640).selectExpr("cast(id div 64 as int) tile_r", "cast(id div 8 % 8 as int) y", "cast(id % 8 as int) x")
    return t.select("tile_r", "y", "x", *_r(lat=90 - 18 * F.col("tile_r") - (F.col("y") + 0.5) * 18 / 8, lon=-180 + (F.col("x") + 0.5) * 18 / 8))


@query("bbox_window", """SELECT id, greatest(0, least(4096, floor(round((lon - 0.5 + 180) / 360 * 4096, 6))))::INT AS x0, greatest(0, least(4096, floor(round((lon + 0.5 + 180) / 360 * 4096, 6))))::INT AS x1,
  greatest(0, least(4096, floor(round((90 - lat - 0.5) / 180 * 4096, 6))))::INT AS y0, greatest(0, least(4096, floor(round((90 - lat + 0.5) / 180 * 4096, 6))))::INT AS y1 FROM places""", "places")
def bbox_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-degree box as a clamped window of the world raster."""
    x = geo.pixel_window(F.col("lon") - 0.5, F.col("lon") + 0.5, 360.0, -180.0, 4096)
    y = geo.pixel_window(90 - F.col("lat") - 0.5, 90 - F.col("lat") + 0.5, 180.0, 0.0, 4096)
    return places(spark, sf_dir).select("id", x[0].alias("x0"), x[1].alias("x1"), y[0].alias("y0"), y[1].alias("y1"))


@query("reference_window", "SELECT r AS tile_r, c AS tile_c, r * 1080 // 10 AS y0, (r + 1) * 1080 // 10 AS y1, c * 2110 // 20 AS x0, (c + 1) * 2110 // 20 AS x1 FROM range(10) a(r) CROSS JOIN range(20) b(c)")
def reference_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(200).selectExpr("id div 20 tile_r", "id % 20 tile_c")
    return t.selectExpr("tile_r", "tile_c", "tile_r * 1080 div 10 y0", "(tile_r + 1) * 1080 div 10 y1", "tile_c * 2110 div 20 x0", "(tile_c + 1) * 2110 div 20 x1")


_Y_UP = list(geo.FACES_Y_UP)
_PLACED = f"""g AS ({_grid_sql(_Y_UP)}), w AS (SELECT face, y, x, tan(pi() / 4 * ((x + 0.5) / {N} * 2 - 1)) AS u, tan(pi() / 4 * ((y + 0.5) / {N} * 2 - 1)) AS v FROM g),
  d AS (SELECT face, y, x, {_face_sql(geo.FACES_Y_UP, "u", "v")} FROM w),
  s AS (SELECT face, y, x, da * sqrt(1 - db * db / 2 - dc * dc / 2 + db * db * dc * dc / 3) AS a, db * sqrt(1 - dc * dc / 2 - da * da / 2 + dc * dc * da * da / 3) AS b, dc * sqrt(1 - da * da / 2 - db * db / 2 + da * da * db * db / 3) AS c FROM d),
  ll AS (SELECT face, y, x, degrees(atan2(a, c)) AS lon, degrees(asin(least(greatest(b / sqrt(a * a + b * b + c * c), -1), 1))) AS lat FROM s)"""


def _placed(spark: SparkSession) -> DataFrame:
    g = _grid(spark, _Y_UP)
    u, v = (geo.warp((F.col(c) + 0.5) / N * 2 - 1) for c in ("x", "y"))
    lon, lat = geo.lonlat(*geo.spherify(*geo.direction(geo.FACES_Y_UP, F.col("face"), u, v)))
    return g.select("face", "y", "x", lon.alias("lon"), lat.alias("lat"))


@query("face_lonlat", f"WITH {_PLACED} SELECT face, y, x, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ll")
def face_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark).select("face", "y", "x", *_r(lon=F.col("lon"), lat=F.col("lat")))


@query("equirect_pixel", "SELECT id, round((lon + 180) / 360 * 128 - 0.5 - 128 * floor(((lon + 180) / 360 * 128 - 0.5) / 128), 6) AS px, round(least(greatest((90 - lat) / 180 * 64 - 0.5, 0), 63), 6) AS py FROM places", "places")
def equirect_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = geo.equirect_pixel(F.col("lon"), F.col("lat"), 128, 64)
    return places(spark, sf_dir).select("id", *_r(px=px, py=py))


@query("cube_uv", """WITH d AS (SELECT id, round(cos(radians(lat + 2)) * cos(radians(lon)), 9) AS x, round(cos(radians(lat + 2)) * sin(radians(lon)), 9) AS y, round(sin(radians(lat + 2)), 9) AS z FROM places),
  f AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x > 0 THEN 0 ELSE 1 END WHEN abs(y) >= abs(x) AND abs(y) >= abs(z) THEN CASE WHEN y > 0 THEN 2 ELSE 3 END WHEN z > 0 THEN 4 ELSE 5 END AS face FROM d)
  SELECT id, face, round_even((CASE face WHEN 0 THEN y / abs(x) WHEN 1 THEN -y / abs(x) WHEN 2 THEN -x / abs(y) WHEN 3 THEN x / abs(y) ELSE y / abs(z) END + 1) / 2, 6) AS u,
    round_even((CASE face WHEN 0 THEN -z / abs(x) WHEN 1 THEN -z / abs(x) WHEN 2 THEN -z / abs(y) WHEN 3 THEN -z / abs(y) WHEN 4 THEN x / abs(z) ELSE -x / abs(z) END + 1) / 2, 6) AS v FROM f""", "places")
def cube_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    face, u, v = geo.face_uv(F.col("lon"), F.col("lat"))
    return places(spark, sf_dir).select("id", face.alias("face"), u.alias("u"), v.alias("v"))


@query("gnomonic", """WITH c AS (SELECT * FROM (VALUES ('px', 90, 0), ('nx', -90, 0), ('py', 0, 90), ('ny', 0, -90), ('pz', 0, 0), ('nz', 180, 0)) t(face, lon0, lat0)),
  k AS (SELECT id, face, lon, lat, lon0, lat0, sin(radians(lat0)) * sin(radians(lat)) + cos(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)) AS k FROM places CROSS JOIN c),
  p AS (SELECT id, face, 6378137 * cos(radians(lat)) * sin(radians(lon - lon0)) / k AS x, 6378137 * (cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0))) / k AS y FROM k WHERE k > 0.5)
  SELECT id, face, round(x, 3) AS x, round(y, 3) AS y FROM p WHERE abs(x) <= 6378137 AND abs(y) <= 6378137""", "places")
def gnomonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on each 45-degree face plane that they fall on."""
    centres = [("px", 90, 0), ("nx", -90, 0), ("py", 0, 90), ("ny", 0, -90), ("pz", 0, 0), ("nz", 180, 0)]
    c = F.explode(F.array(*[F.struct(F.lit(f).alias("face"), F.lit(a).alias("lon0"), F.lit(b).alias("lat0")) for f, a, b in centres])).alias("c")
    p = places(spark, sf_dir).select("id", "lon", "lat", c).select("id", "lon", "lat", "c.*")
    x, y, k = geo.gnomonic(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    p = p.select("id", "face", k.alias("k"), F.when(k > 0.5, x).alias("x"), F.when(k > 0.5, y).alias("y")).where("k > 0.5")
    return p.where(f"abs(x) <= {geo.EARTH} and abs(y) <= {geo.EARTH}").select("id", "face", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("cube_conv_c", f"""WITH g AS ({_grid_sql(list(geo.FACES_PLAIN))}), w AS (SELECT face, y, x, x * 2.0::DOUBLE / {N - 1} - 1 AS u, y * 2.0::DOUBLE / {N - 1} - 1 AS v FROM g), d AS (SELECT face, y, x, {_face_sql(geo.FACES_PLAIN, "u", "v")} FROM w)
  SELECT face, y, x, round((atan2(round(dc, 9), round(da, 9)) + pi()) / (2 * pi()), 6) AS su, round(least(greatest(0.5 - asin(db / sqrt(da * da + db * db + dc * dc)) / pi(), 0.001), 0.999), 6) AS sv FROM d""")
def cube_conv_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture coordinates of plain faces sampled end to end."""
    u, v = ((F.col(c) * 2.0 / (N - 1) - 1) for c in ("x", "y"))
    a, b, c = geo.direction(geo.FACES_PLAIN, F.col("face"), u, v)
    lat = F.asin(b / F.sqrt(a * a + b * b + c * c))
    return _grid(spark, list(geo.FACES_PLAIN)).select("face", "y", "x", *_r(su=(F.atan2(F.round(c, 9), F.round(a, 9)) + F.pi()) / (2 * F.pi()), sv=geo.clamp(0.5 - lat / F.pi(), 0.001, 0.999)))


@query("cube_conv_d", f"""WITH g AS ({_grid_sql(list(geo.FACES_Z_UP))}), w AS (SELECT face_no, face, y, x, tan(pi() / 4 * (x * 2.0::DOUBLE / {N - 1} - 1)) AS u, tan(pi() / 4 * (y * 2.0::DOUBLE / {N - 1} - 1)) AS v FROM g), d AS (SELECT face_no, y, x, {_face_sql(geo.FACES_Z_UP, "u", "v")} FROM w)
  SELECT face_no * {N} + y AS strip_y, x, round(degrees(atan2(round(db, 9), round(da, 9))), 6) AS lon, round(degrees(asin(dc / sqrt(da * da + db * db + dc * dc))), 6) AS lat FROM d""")
def cube_conv_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six warped z-up faces in one vertical strip."""
    u, v = (geo.warp(F.col(c) * 2.0 / (N - 1) - 1) for c in ("x", "y"))
    a, b, c = geo.direction(geo.FACES_Z_UP, F.col("face"), u, v)
    d = _grid(spark, list(geo.FACES_Z_UP)).select((F.col("face_no") * N + F.col("y")).alias("strip_y"), "x", a.alias("a"), b.alias("b"), c.alias("c"))
    return d.select("strip_y", "x", *_r(lon=F.degrees(F.atan2(F.round("b", 9), F.round("a", 9))), lat=F.degrees(F.asin(F.expr("c / sqrt(a * a + b * b + c * c)")))))


@query("lat_stretch", "SELECT id, round(sign(lat) * least(greatest(CASE WHEN abs(lat / 90) <= 0.6 THEN abs(lat / 90) * 0.5 / 0.6 ELSE 0.5 + (abs(lat / 90) - 0.6) * 0.5 / 0.4 END, 0), 1), 6) AS y FROM places", "places")
def lat_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("id", *_r(y=geo.stretch_latitude(F.col("lat") / 90)))


@query("local_offset", "SELECT id, round(6371000 * radians(lon - 2.3) * cos(radians(48.8)), 3) AS east, round(6371000 * radians(lat - 48.8), 3) AS north FROM places", "places")
def local_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = geo.local_offset(F.col("lon"), F.col("lat"), F.lit(2.3), F.lit(48.8))
    return places(spark, sf_dir).select("id", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query("orbit_xyz", "SELECT id, round(radius * cos(radians(pitch)) * cos(radians(yaw)), 6) AS x, round(radius * sin(radians(pitch)), 6) AS y, round(radius * cos(radians(pitch)) * sin(radians(yaw)), 6) AS z FROM camera", "camera")
def orbit_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = geo.orbit(F.col("yaw"), F.col("pitch"), F.col("radius"))
    return camera(spark, sf_dir).select("id", *_r(x=x, y=y, z=z))


@query("ray_sphere", """WITH o AS (SELECT id, radius * cos(radians(pitch)) * cos(radians(yaw)) AS ox, radius * sin(radians(pitch)) AS oy, radius * cos(radians(pitch)) * sin(radians(yaw)) AS oz, radius FROM camera),
  n AS (SELECT id, ox, oy, oz, -ox / radius AS ux, -oy / radius AS uy, -oz / radius AS uz, (id % 5) * 0.3 AS tilt FROM o),
  r AS (SELECT id, ox, oy, oz, ux / q AS dx, (uy + tilt) / q AS dy, uz / q AS dz FROM (SELECT *, sqrt(ux * ux + (uy + tilt) * (uy + tilt) + uz * uz) AS q FROM n)),
  t AS (SELECT *, CASE WHEN round(b * b - c, 9) >= 0 THEN -b - sqrt(greatest(b * b - c, 0)) END AS t FROM (SELECT *, ox * dx + oy * dy + oz * dz AS b, ox * ox + oy * oy + oz * oz - 25 AS c FROM r)),
  p AS (SELECT id, CASE WHEN t >= 0 THEN t END AS t, ox + t * dx AS x, oy + t * dy AS y, oz + t * dz AS z FROM t)
  SELECT id, round(t, 5) AS distance, CASE WHEN t IS NOT NULL THEN round(degrees(asin(least(greatest(y / 5, -1), 1))), 4) END AS lat,
    CASE WHEN t IS NOT NULL THEN round(degrees(atan2(x, z)) - 90 - 360 * floor((degrees(atan2(x, z)) - 90 + 180) / 360), 4) END AS lon FROM p""", "camera")
def ray_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the view ray meets the globe; longitudes shifted by 90 degrees and wrapped, null on a miss."""
    c = camera(spark, sf_dir)
    o = geo.orbit(F.col("yaw"), F.col("pitch"), F.col("radius"))
    c = c.select("id", *[k.alias(n) for n, k in zip(("ox", "oy", "oz"), o, strict=True)], *[(-k / F.col("radius")).alias(n) for n, k in zip(("ux", "uy", "uz"), o, strict=True)])
    c = c.withColumn("uy", F.col("uy") + (F.col("id") % 5) * 0.3).withColumn("q", F.expr("sqrt(ux * ux + uy * uy + uz * uz)"))
    ray = tuple(F.col(k) / F.col("q") for k in ("ux", "uy", "uz"))
    t, (x, y, z) = geo.ray_sphere((F.col("ox"), F.col("oy"), F.col("oz")), ray)
    p = c.select("id", t.alias("t"), x.alias("x"), y.alias("y"), z.alias("z"))
    lon = F.degrees(F.atan2("x", "z")) - 90
    return p.select("id", F.round("t", 5).alias("distance"), F.when(F.col("t").isNotNull(), F.round(F.degrees(F.asin(geo.clamp(F.col("y") / 5, -1, 1))), 4)).alias("lat"), F.round(lon - 360 * F.floor((lon + 180) / 360), 4).alias("lon"))


@query("zoom_level", "SELECT id, least(greatest(floor(15 - log2(greatest(radius - 5, 1e-6) * 16)), 8), 15)::INT AS zoom FROM camera", "camera")
def zoom_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera(spark, sf_dir).select("id", geo.zoom_level(F.col("radius") - 5).alias("zoom"))


@query("zoom_depth", "SELECT id, CASE WHEN a > 50 THEN 0 WHEN a > 10 THEN 1 WHEN a > 2 THEN 2 ELSE 3 END AS depth FROM (SELECT id, (id % 13) * (id % 7) * 1.0 AS a FROM places)", "places")
def zoom_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("id", geo.zoom_depth((F.col("id") % 13) * (F.col("id") % 7)).alias("depth"))


@query("kelvin_alpha", "SELECT seq, y, x, round(CASE WHEN v > 100 THEN pow(least(greatest((276 - v) / 91, 0), 1), 0.7) ELSE 0 END, 6) AS alpha FROM layers", "layers")
def kelvin_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).select("seq", "y", "x", *_r(alpha=geo.kelvin_alpha(F.col("v"))))


@query("face_rgba", "SELECT seq, y, x, 255 AS red, 255 AS green, 255 AS blue, floor(round(CASE WHEN v > 100 THEN pow(least(greatest((276 - v) / 91, 0), 1), 0.7) ELSE 0 END * 255, 6))::BIGINT AS alpha FROM layers", "layers")
def face_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White pixels whose opacity is the cloud."""
    return layers(spark, sf_dir).select("seq", "y", "x", *[F.lit(255).alias(c) for c in ("red", "green", "blue")], geo.to_byte(geo.kelvin_alpha(F.col("v"))).alias("alpha"))


@query("minmax_u16", "SELECT id, floor(round(least(greatest((elev - (SELECT min(elev) FROM places)) / ((SELECT max(elev) FROM places) - (SELECT min(elev) FROM places)), 0), 1) * 65535, 6))::BIGINT AS height FROM places", "places")
def minmax_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    span = p.agg(F.min("elev").alias("lo"), F.max("elev").alias("hi"))
    t = geo.clamp((F.col("elev") - F.col("lo")) / (F.col("hi") - F.col("lo")), 0, 1)
    return p.join(F.broadcast(span)).select("id", F.floor(F.round(t * 65535, 6)).cast("long").alias("height"))  # one row


def _elevation(spark: SparkSession) -> DataFrame:
    return spark.range(64 * 32).selectExpr("cast(id div 64 as int) y", "cast(id % 64 as int) x", "cast((id * 7919) % 9000 - 500 as double) elev")


_ELEVATION = "e AS (SELECT i // 64 AS y, i % 64 AS x, ((i * 7919) % 9000 - 500)::DOUBLE AS elev FROM range(2048) r(i))"


def _bilinear(at: DataFrame, raster: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Four weighted neighbours joined on their integer pixel and summed."""
    fx, fy = F.floor("px"), F.floor("py")
    taps = F.explode(F.array(*[F.struct(F.least(fy + j, F.lit(height - 1)).cast("int").alias("y"), F.pmod(fx + i, F.lit(width)).cast("int").alias("x"), ((F.col("px") - fx) if i else (1 - F.col("px") + fx)).alias("wx"), ((F.col("py") - fy) if j else (1 - F.col("py") + fy)).alias("wy")) for j in (0, 1) for i in (0, 1)])).alias("t")
    return at.select(*keys, taps).select(*keys, "t.*").withColumnsRenamed({"y": "ry", "x": "rx"}).join(raster.withColumnsRenamed({"y": "ry", "x": "rx"}), ["ry", "rx"]).groupBy(*keys).agg(F.sum(F.col("wx") * F.col("wy") * F.col("elev")).alias("value"))


_SAMPLED = f"""{_ELEVATION}, q AS (SELECT face, y, x, (lon + 180) / 360 * 64 - 0.5 - 64 * floor(((lon + 180) / 360 * 64 - 0.5) / 64) AS px, least(greatest((90 - lat) / 180 * 32 - 0.5, 0), 31) AS py FROM ll),
  b AS (SELECT q.face, q.y, q.x, sum(CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END * CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END * elev) AS value
    FROM q CROSS JOIN range(2) a(i) CROSS JOIN range(2) c(j) JOIN e ON e.y = least(floor(py) + j, 31) AND e.x = (floor(px) + i) % 64 GROUP BY 1, 2, 3)"""


def _sampled(spark: SparkSession) -> DataFrame:
    p = _placed(spark)
    px, py = geo.equirect_pixel(F.col("lon"), F.col("lat"), 64, 32)
    return _bilinear(p.select("face", F.col("y").alias("fy"), F.col("x").alias("fx"), px.alias("px"), py.alias("py")), _elevation(spark), ["face", "fy", "fx"], 64, 32).withColumnsRenamed({"fy": "y", "fx": "x"})


@query("bilinear_sample", f"WITH {_PLACED}, {_SAMPLED} SELECT face, y, x, round(value, 5) AS value FROM b")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark).select("face", "y", "x", F.round("value", 5).alias("value"))


@query("height_norm", f"WITH {_PLACED}, {_SAMPLED} SELECT face, y, x, floor(round((value - (SELECT min(elev) FROM e)) / ((SELECT max(elev) FROM e) - (SELECT min(elev) FROM e)) * 65535, 3))::BIGINT AS height FROM b")
def height_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation faces as 16-bit heights over one range for all."""
    span = _elevation(spark).agg(F.min("elev").alias("lo"), F.max("elev").alias("hi"))
    h = F.floor(F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 65535, 3))
    return _sampled(spark).join(F.broadcast(span)).select("face", "y", "x", h.cast("long").alias("height"))  # one row


@query("swath_bin", """SELECT y, x, arg_min(elev, d * 1000000000 + id) AS v FROM (SELECT id, elev, floor((90 - lat) / 5)::INT AS y, floor((lon + 180) / 5)::INT AS x,
  round(((90 - lat) / 5 - floor((90 - lat) / 5) - 0.5) * ((90 - lat) / 5 - floor((90 - lat) / 5) - 0.5) + ((lon + 180) / 5 - floor((lon + 180) / 5) - 0.5) * ((lon + 180) / 5 - floor((lon + 180) / 5) - 0.5), 6) AS d FROM places) GROUP BY 1, 2""", "places")
def swath_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell takes the sample nearest to its centre."""
    p = places(spark, sf_dir).select("id", "elev", ((90 - F.col("lat")) / 5).alias("fy"), ((F.col("lon") + 180) / 5).alias("fx"))
    dy, dx = (F.col(c) - F.floor(c) - 0.5 for c in ("fy", "fx"))
    p = p.select("id", "elev", F.floor("fy").cast("int").alias("y"), F.floor("fx").cast("int").alias("x"), F.round(dy * dy + dx * dx, 6).alias("d"))
    return p.groupBy("y", "x").agg(F.min_by("elev", F.struct("d", "id")).alias("v"))


@query("viewport_span", "SELECT id, round(least(2 * degrees((radius - 5) * tan(radians(22.5)) / 5) * 1.15, 6), 6) AS lat_span, round(least(2 * degrees((radius - 5) * tan(radians(22.5)) * 1.6 / 5) * 1.15, 8), 6) AS lon_span FROM camera", "camera")
def viewport_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.degrees((F.col("radius") - 5) * F.tan(F.radians(F.lit(22.5))) / 5)
    wide = F.degrees((F.col("radius") - 5) * F.tan(F.radians(F.lit(22.5))) * 1.6 / 5)
    return camera(spark, sf_dir).select("id", *_r(lat_span=F.least(2 * half * 1.15, F.lit(6.0)), lon_span=F.least(2 * wide * 1.15, F.lit(8.0))))


@query("pack_uint8", "SELECT tile_r, tile_c, frame, y, x, floor(round(red / 255 * 255, 6))::BIGINT AS byte FROM frames_px", "frames_px")
def pack_uint8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_px(spark, sf_dir).select("tile_r", "tile_c", "frame", "y", "x", geo.to_byte(F.col("red") / 255).alias("byte"))
