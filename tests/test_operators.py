"""Goldens and properties of the operators on small rasters, tracks and shapes."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.operators import blends, camera, catalogue, composite, kernels, procedural, stencils, vectors
from skyloom.streaming import dwell


def raster(spark, a, tile=0):
    return spark.createDataFrame([(tile, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "tile long, y int, x int, v double")


def back(df, column, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r[column] is None else r[column]
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).normal(0, 10, (12, 10)).round(3)


def test_laplacian_and_sobel(spark, noise):
    p = np.pad(noise, 1, mode="reflect")
    want = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * noise
    assert np.allclose(back(stencils.laplacian(raster(spark, noise), ["tile"]), "lap", noise.shape), want)
    d = stencils.sobel(raster(spark, noise), ["tile"])
    sx = sum(k * (p[i : i + 12, 2:] - p[i : i + 12, :-2]) for i, k in enumerate((1, 2, 1)))
    assert np.allclose(back(d, "sx", noise.shape), sx)


def test_gaussian_folds_beyond_the_border(spark, noise):
    small = noise[:4, :5]
    w = np.array(stencils.kernel(1.5))
    r = len(w) // 2
    p = np.pad(small, r, mode="symmetric")
    p = np.apply_along_axis(lambda c: np.convolve(c, w, "valid"), 0, p)
    want = np.apply_along_axis(lambda c: np.convolve(c, w, "valid"), 1, p)
    assert np.allclose(back(stencils.gaussian(raster(spark, small), ["tile"], 1.5, 1.5), "blur", small.shape), want)


def test_closing_erosion_distance(spark, noise):
    closed = back(stencils.closing(raster(spark, noise), ["tile"], 1), "closed", noise.shape)
    assert (closed >= noise).all()
    again = back(stencils.closing(raster(spark, closed), ["tile"], 1), "closed", noise.shape)
    assert (again == closed).all()
    mask = noise > -8
    eroded = back(stencils.erode(raster(spark, noise), ["tile"], 2, F.col("v") > -8), "eroded", noise.shape).astype(bool)
    want = mask.copy()
    for _ in range(2):
        q = np.pad(want, 1)
        want = q[1:-1, 1:-1] & q[:-2, 1:-1] & q[2:, 1:-1] & q[1:-1, :-2] & q[1:-1, 2:]
    assert (eroded == want).all()
    exact = kernels.distance_transform(mask)
    near = back(stencils.distance(raster(spark, noise), ["tile"], F.col("v") > -8, 4), "distance", noise.shape)
    assert np.allclose(np.where(exact <= 4, exact, np.nan), near, equal_nan=True)


def test_erosion_of_sparse_rasters(spark):
    rng = np.random.default_rng(8)
    there, good = rng.random((2, 15, 13)) > 0.06
    px = [(0, y, x, float(good[y, x])) for y in range(15) for x in range(13) if there[y, x]]
    for times in (1, 3):
        got = {(r.y, r.x): r.eroded for r in stencils.erode(spark.createDataFrame(px, "tile long, y int, x int, v double"), ["tile"], times, F.col("v") > 0).collect()}
        want = there & good
        for _ in range(times):
            q = np.pad(want, 1)
            want = q[1:-1, 1:-1] & q[:-2, 1:-1] & q[2:, 1:-1] & q[1:-1, :-2] & q[1:-1, 2:]
        assert got == {(y, x): bool(want[y, x]) for _, y, x, _ in px}


def test_dither_differs_by_tile(spark):
    df = spark.range(2000).selectExpr("id % 2 tile", "cast(id div 2 as int) y", "0 x", "0.5D v")
    got = df.withColumn("d", procedural.dither(F.col("v"), F.col("tile"), F.col("y"), F.col("x"))).collect()
    off = {t: [r.d - 0.5 for r in sorted(got, key=lambda r: r.y) if r.tile == t] for t in (0, 1)}
    assert max(map(abs, off[0] + off[1])) <= 1 / 255 and abs(np.corrcoef(off[0], off[1])[0, 1]) < 0.1


def test_gap_fill_keeps_valid_pixels_and_wraps(spark):
    row = [None, 1.0, None, None, 4.0, None]
    rows = [(0, x, v) for x, v in enumerate(row)] + [(1, x, None) for x in range(6)] + [(2, x, 5.0 if x == 2 else None) for x in range(6)]
    d = stencils.fill_gaps(spark.createDataFrame(rows, "y int, x int, v double"), 6)
    got = {(r.y, r.x): r.filled for r in d.collect()}
    assert [got[0, x] for x in range(6)] == [2.0, 1.0, 2.0, 3.0, 4.0, 3.0]
    assert all(got[1, x] is None for x in range(6)) and all(got[2, x] == 5.0 for x in range(6))


def test_blend_order_and_thresholds(spark):
    rows = [(0, 1, 200.0, 1.0), (0, 2, 100.0, 0.25), (0, 3, 50.0, 0.0), (1, 1, 0.5, 1.0), (1, 2, 300.0, 0.1)]
    df = spark.createDataFrame(rows, "p int, seq int, v double, alpha double")
    got = {r.p: r.v for r in blends.smart_blend(df, ["p"], 100).collect()}
    assert got == {0: 175.0, 1: 300.0}
    opaque = df.withColumn("alpha", F.lit(1.0))
    assert sorted(map(tuple, blends.smart_blend(opaque, ["p"], 1).collect())) == sorted(map(tuple, blends.overwrite_blend(df, ["p"]).collect()))


def stack(spark, rows):
    return spark.createDataFrame(rows, "tile_r int, tile_c int, frame int, y int, x int, red double, green double, blue double")


def test_best_pixel(spark):
    rng = np.random.default_rng(2)
    rows = [(0, 0, f, 0, x, *map(float, rng.integers(1, 120, 3))) for f in range(40) for x in range(2)]
    rows += [(0, 0, 40, 0, x, 250.0, 250.0, 250.0) for x in range(2)]
    got = {r.x: (r.red, r.green, r.blue) for r in composite.best_pixel(stack(spark, rows)).collect()}
    again = composite.best_pixel(stack(spark, rows[::-1])).collect()
    assert got == {r.x: (r.red, r.green, r.blue) for r in again}
    for x in range(2):
        px = np.array([r[5:] for r in rows if r[4] == x and r[2] < 40])
        score = px.mean(axis=1) - 2 * (px.max(axis=1) - px.min(axis=1)) - 1.5 * (px[:, 2] - px[:, 0])
        best = px[np.argsort(score.round(6), kind="stable")[:10]]
        assert got[x] == tuple(np.floor(np.percentile(best, 10, axis=0).round(6)).astype(int))


def test_best_pixel_edges(spark):
    assert composite.best_pixel(stack(spark, [])).count() == 0
    few = composite.best_pixel(stack(spark, [(0, 0, f, 0, 0, 10.0 * (f + 1), 10.0, 10.0) for f in range(3)])).collect()
    assert len(few) == 1 and few[0].red == 12
    cloudy = composite.best_pixel(stack(spark, [(0, 0, f, 0, 0, 240.0, 240.0, 240.0) for f in range(3)])).collect()
    assert (cloudy[0].red, cloudy[0].blue) == (240, 240)  # all rejected, so all are kept
    gone = composite.best_pixel(stack(spark, [(0, 0, 0, 0, 0, 0.0, 0.0, 0.0)])).collect()
    assert gone[0].red == 0


def test_scene_composite_takes_the_reference(spark):
    px = stack(spark, [(0, 0, 0, 0, 0, 0.0, 0.0, 0.0), (0, 0, 0, 0, 1, 100.0, 100.0, 100.0)])
    ref = stack(spark, [(0, 0, 9, 0, 0, 50.0, 50.0, 50.0), (0, 0, 9, 0, 1, 50.0, 50.0, 50.0)])
    got = {r.x: (r.ratio, r.red) for r in composite.scene_composite(px, ref).collect()}
    assert got == {0: (0.666667, 33), 1: (0.666667, 66)}


def test_catalogue(spark):
    rows = [("a", s, p) for s, n in ((1, 10), (2, 9), (3, 11)) for p in range(n)]
    got = catalogue.complete_slots(spark.createDataFrame(rows, "k string, slot int, part int"), ["k"], "slot", "part", 10).collect()
    assert [(r.slot, len(r.parts)) for r in got] == [(1, 10)]
    names = spark.createDataFrame([("k1", "b", "d"), ("k1", "a", "d"), ("k2", "c", "d"), ("k1", "g", "g"), ("k3", "h", "g")], "key string, v string, kind string")
    assert [tuple(r) for r in catalogue.pair(names, F.col("kind") == "d", "key", "v", 5).collect()] == [("k1", "a", "g")]


def test_point_in_polygon_and_clip(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)]
    polygons = spark.createDataFrame([(1, [{"lon": a, "lat": b} for a, b in ring])], "zone int, ring array<struct<lon double, lat double>>")
    points = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 5.0), (3, 1.0, 5.0), (4, 11.0, 5.0), (5, -1.0, 5.0)], "id int, lon double, lat double")
    got = sorted(r.id for r in vectors.point_in_polygon(points, polygons, 3.0).collect())
    assert got == [1, 3]
    assert sorted(vectors.clip_box([(0, 0), (4, 0), (4, 4), (0, 4)], 1, 1, 9, 2)) == [(1, 1), (1, 2), (4, 1), (4, 2)]
    assert vectors.clip_box([(0, 0), (1, 0), (1, 1)], 5, 5, 6, 6) == []


def test_outlines_are_packed(spark):
    ways = spark.createDataFrame([(1, [5, 6, 7]), (2, [5, 6]), (3, [7, 99, 5])], "way long, nodes array<long>")
    nodes = spark.createDataFrame([(5, 0.0, 0.0), (6, 0.001, 0.0), (7, 0.0, 0.001)], "node long, lon double, lat double")
    d = vectors.ordered_nodes(ways, nodes, 0.0, 0.0)
    got = {r.way: (r.n, r.found, [p.x for p in r.verts]) for r in d.collect()}
    assert got == {1: (3, 3, [0.0, 111.195, 0.0]), 3: (3, 2, [0.0, 0.0])}
    packed = vectors.pack_buildings(d.withColumn("height", F.lit(7.5)).withColumn("material", F.lit(2)).withColumn("roof", F.lit(1))).where("way = 1").first().packed
    assert len(packed) == 8 + 3 * 8 and struct.unpack("<HfBB", packed[:8]) == (3, 7.5, 2, 1)


def test_camera_edges(spark):
    rows = [(1, "2024-01-01 00:00:00", 1, 179.0, 0.0), (1, "2024-01-01 00:00:01", 2, -179.0, 0.0), (1, "2024-01-01 00:00:01", 3, 0.0, 0.0), (1, "2024-01-01 00:00:02", 4, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "session long, t string, id long, yaw double, pitch double").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.id: r for r in camera.dwell(camera.velocities(df), 0.7, 0.9).collect()}
    assert got[2].yaw_speed == 2.0 and got[3].yaw_speed is None
    assert [got[i].still_for for i in (1, 2, 3, 4)] == [0.0, 0.0, 0.0, 1.0] and got[4].pull


def test_dwell_stream_equals_batch(spark, tmp_path):
    rows = [(s, f"2024-01-01 00:00:{i:02d}", i, float((i // 4) * 10 * s % 360), 0.0) for s in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "session long, t string, id long, yaw double, pitch double").selectExpr("session", "cast(t as timestamp) ts", "id", "yaw", "pitch")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = dwell.dwell_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 0.7, 1.5)
    got = {(r.session, r.id): (r.still_for, r.pull) for r in dwell.drained(stream, "dwell_test", f"{tmp_path}/state").collect()}
    batch = camera.dwell(camera.velocities(df), 0.7, 1.5)
    assert got == {(r.session, r.id): (r.still_for, r.pull) for r in batch.collect()}


def test_fresh_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:30:00")], "name string, t string").selectExpr("name", "cast(t as timestamp) last_modified")
    df.write.parquet(f"{tmp_path}/in")
    out = dwell.drained(dwell.fresh_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), "fresh_test", f"{tmp_path}/state")
    assert sorted(r.name for r in out.collect()) == ["a", "b"]


def test_complete_stream_counts_parts(spark, tmp_path):
    parts = [("00:01", p) for p in range(10)] + [("00:11", 3)] * 12 + [("00:21", p) for p in range(10)] + [("00:21", 4), ("02:00", 1)]
    df = spark.createDataFrame(parts, "t string, part int").selectExpr("cast('2024-01-01 ' || t || ':00' as timestamp) ts", "part")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = dwell.complete_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 10)
    got = dwell.drained(stream, "complete_test", f"{tmp_path}/state").selectExpr("date_format(slot, 'HH:mm') s", "n", "parts").collect()
    assert sorted(map(tuple, got)) == [("00:00", 10, 10), ("00:20", 11, 10)]


def test_kernels():
    rng = np.random.default_rng(3)
    mask = rng.random((14, 11)) > 0.45
    y, x = np.nonzero(~mask)
    want = np.array([[np.sqrt(((y - i) ** 2 + (x - j) ** 2).min()) for j in range(11)] for i in range(14)])
    assert np.allclose(kernels.distance_transform(mask), np.where(mask, want, 0))
    assert np.isinf(kernels.distance_transform(np.ones((3, 3), bool))).all()
    wide = np.ones((512, 512), bool)
    wide[100, 30] = False
    assert kernels.distance_transform(wide)[511, 511] == pytest.approx(np.hypot(411, 481))
    labels = kernels.connected(mask)
    for i in range(14):
        for j in range(11):
            for a, b in ((0, 1), (1, 0), (1, 1), (1, -1)):
                if 0 <= i + a < 14 and 0 <= j + b < 11 and mask[i, j] and mask[i + a, j + b]:
                    assert labels[i, j] == labels[i + a, j + b]
    assert set(np.unique(labels[mask])) == {min(np.flatnonzero(labels.ravel() == k)) + 1 for k in np.unique(labels[mask])}
    a = rng.random((8, 8)) * 255
    assert np.allclose(kernels.bicubic(a, 8, 8), a) and np.allclose(kernels.bicubic(np.full((5, 5), 3.0), 11, 7), 3)
    flat = kernels.clahe(np.full((16, 16), 100.0), 2.0, 4)
    assert flat.min() == flat.max() and kernels.clahe(a).min() >= 0 and kernels.clahe(a).max() <= 255.0001
    step = np.zeros((20, 20))
    step[:, 10:] = 200
    edges = kernels.canny(step)
    assert set(np.unique(np.nonzero(edges)[1])) <= {9, 10} and edges.any(axis=1).all()
    assert kernels.high_frequency_share(rng.random((32, 32))) > kernels.high_frequency_share(np.outer(np.hanning(32), np.hanning(32)))


def test_binary_formats():
    data = struct.pack("<6f", *range(6))
    assert kernels.accessor(data, 0, 2, 5126, "VEC3").tolist() == [[0, 1, 2], [3, 4, 5]]
    mixed = b"".join(struct.pack("<fHH", i, 7, 9) for i in range(3))
    assert kernels.accessor(mixed, 4, 3, 5123, "VEC2", 8).tolist() == [[7, 9]] * 3
    assert kernels.raw_rgba(bytes(16), 2).shape == (2, 2, 4)
    with pytest.raises(ValueError):
        kernels.raw_rgba(bytes(15), 2)
    head = b"\xabKTX 11\xbb\r\n\x1a\n" + b"\x01\x02\x03\x04" + struct.pack("<12I", 0, 1, 0, 37808, 0, 4, 2, 0, 0, 1, 1, 0)
    head = head[:12] + b"\x01\x02\x03\x04" + struct.pack("<12I", 0, 1, 0, 37808, 0, 4, 2, 0, 0, 1, 1, 0)
    assert kernels.ktx_payload(head + struct.pack("<I", 3) + b"abc")[3] == b"abc"
    assert kernels.lut(struct.pack("<4f", 1, 2, 3, 4), 2, 2).tolist() == [[1, 2], [3, 4]]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=3, max_size=8))
def test_clip_stays_in_the_box(ring):
    for x, y in vectors.clip_box(ring, -10, -5, 20, 15):
        assert -10 - 1e-9 <= x <= 20 + 1e-9 and -5 - 1e-9 <= y <= 15 + 1e-9


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 9), st.integers(2, 9), st.randoms())
def test_components_do_not_depend_on_values(h, w, rng):
    mask = np.array([[rng.random() > 0.5 for _ in range(w)] for _ in range(h)])
    labels = kernels.connected(mask)
    assert ((labels > 0) == mask).all()
