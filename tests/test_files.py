"""Readers and sinks, by round trips over small files."""

import bz2
import io
import json
import struct
import zipfile

import numpy as np
import pytest

from skyloom.sources import files, sinks


def test_png_tiles_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    tiles = {(r, c): rng.integers(0, 256, (3, 5, 3)) for r in range(2) for c in range(2)}
    rows = [(r, c, y, x, *map(int, a[y, x])) for (r, c), a in tiles.items() for y in range(3) for x in range(5) if (y, x) != (2, 4)]
    px = spark.createDataFrame(rows, "tile_r int, tile_c int, y int, x int, red int, green int, blue int")
    made = sinks.tile_names(sinks.png_payloads(px, ["tile_r", "tile_c"], ["red", "green", "blue"], 3, 5)).withColumnRenamed("png", "content")
    written = {r.name: r.bytes for r in sinks.write_files(made, f"{tmp_path}/out").collect()}
    assert sorted(written) == ["tile_0_0.png", "tile_0_1.png", "tile_1_0.png", "tile_1_1.png"] and min(written.values()) > 50
    got = files.images(spark, f"{tmp_path}/out").collect()
    assert len(got) == 4 * 15
    for r in got:
        a = tiles[tuple(map(int, r.path.rsplit("/", 1)[1][5:8].split("_")))]
        want = (0, 0, 0) if (r.y, r.x) == (2, 4) else tuple(a[r.y, r.x])
        assert (r.height, r.width, r.red, r.green, r.blue) == (3, 5, *want)
    gray = files.images(spark, f"{tmp_path}/out", gray=True).where("y = 0 and x = 0").collect()
    assert sorted(r.v for r in gray) == sorted(round(float(a[0, 0] @ [0.299, 0.587, 0.114])) for a in tiles.values())
    high = sinks.png(np.array([[0, 65535], [258, 1]], dtype=np.uint16))
    assert high[24:26] == bytes([16, 0]) and len(sinks.png(np.zeros((4, 4, 4), np.uint8))) > 50


def test_cache_replaces_its_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "layer string, face int, v double")
    sinks.save_cache(df, f"{tmp_path}/cache", ["layer", "face"])
    sinks.save_cache(df.where("layer = 'b'").selectExpr("layer", "face", "v * 10 v"), f"{tmp_path}/cache", ["layer", "face"])
    assert sorted((r.layer, r.face, r.v) for r in sinks.load_cache(spark, f"{tmp_path}/cache").collect()) == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 30.0)]
    assert [r.v for r in sinks.load_cache(spark, f"{tmp_path}/cache", layer="a", face=2).collect()] == [2.0]


def test_geojson_and_elements(spark, tmp_path):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 0.0]]
    features = [
        {"type": "Feature", "properties": {"shapeName": "One"}, "geometry": {"type": "Polygon", "coordinates": [ring, ring]}},
        {"type": "Feature", "properties": {"pop": 3}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring[::-1]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}},
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = files.geojson(spark, f"{tmp_path}/a.geojson").collect()
    assert [r.name for r in got] == ["One", "Unknown", "Unknown"] and [(p.lon, p.lat) for p in got[2].ring] == [tuple(p) for p in ring[::-1]]
    assert files.geojson(spark, f"{tmp_path}/none.geojson").count() == 0
    dump = {"elements": [{"type": "node", "id": 1, "lon": 2.5, "lat": 48.5}, {"type": "way", "id": 7, "nodes": [1, 2, 3], "tags": {"height": "9"}}, {"type": "way", "id": 8, "nodes": [1, 2], "tags": {}}]}
    (tmp_path / "e.json").write_text(json.dumps(dump))
    nodes, ways = files.elements(spark, f"{tmp_path}/e.json")
    assert [tuple(r) for r in nodes.collect()] == [(1, 2.5, 48.5)]
    assert [(r.way, r.nodes, r.tags) for r in ways.collect()] == [(7, [1, 2, 3], {"height": "9"})]


def tiff(a, order):
    data = a.astype(f"{order}i2").tobytes()
    entries = [(256, 3, 1, a.shape[1]), (257, 3, 1, a.shape[0]), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, len(data)), (339, 3, 1, 2)]
    out = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8 + len(data)) + data + struct.pack(f"{order}H", len(entries))
    for tag, kind, n, value in entries:
        out += struct.pack(f"{order}HHI", tag, kind, n) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
    return out + bytes(4)


def test_binary_files(spark, tmp_path):
    a = np.arange(-6, 6).reshape(3, 4)
    for name, order in (("le", "<"), ("be", ">")):
        (tmp_path / f"{name}.tif").write_bytes(tiff(a, order))
    got = files.elevation(spark, str(tmp_path)).collect()
    assert len(got) == 24 and all(r.v == a[r.y, r.x] and (r.height, r.width) == (3, 4) for r in got)
    with pytest.raises(Exception, match="bad.tif"):
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "bad.tif").write_bytes(b"II*")
        files.elevation(spark, f"{tmp_path}/bad").collect()
    faces = np.random.default_rng(2).integers(0, 256, (4, 4, 4)).astype(np.uint8)
    (tmp_path / "faces").mkdir()
    (tmp_path / "faces" / "posx.raw").write_bytes(faces.tobytes())
    assert all((r.red, r.green, r.blue, r.alpha) == tuple(faces[r.y, r.x]) for r in files.rgba_faces(spark, f"{tmp_path}/faces", 4).collect())
    (tmp_path / "lut.bin").write_bytes(np.linspace(0, 1, 6, dtype="<f4").tobytes())
    assert [round(r.v, 6) for r in sorted(files.tables(spark, str(tmp_path), 2, 3).collect(), key=lambda r: r.i)] == [0, 0.2, 0.4, 0.6, 0.8, 1]
    ktx = b"\xabKTX 11\xbb\r\n\x1a\n" + b"\x01\x02\x03\x04" + struct.pack("<12I", 0, 1, 0, 33779, 6408, 8, 4, 0, 0, 1, 1, 4) + b"meta" + struct.pack("<I", 3) + b"abc"
    (tmp_path / "t.ktx").write_bytes(ktx)
    texture = files.textures(spark, str(tmp_path)).collect()
    assert len(texture) == 1 and bytes(texture[0].payload) == b"abc"
    pairs = np.arange(12, dtype="<f4").tobytes()
    rows = spark.createDataFrame([("m", "POSITION", bytearray(pairs), 4, 2, 5126, "VEC3", 20)], "mesh string, name string, buffer binary, offset int, count int, component int, shape string, stride int")
    assert [r.item for r in sorted(files.accessors(rows).collect(), key=lambda r: r.i)] == [[1, 2, 3], [6, 7, 8]]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("b.nat", b"two")
        z.writestr("a.nat", b"one")
        z.writestr("a.xml", b"x")
    (tmp_path / "z.zip").write_bytes(buffer.getvalue())
    (tmp_path / "s.DAT.bz2").write_bytes(bz2.compress(b"segment"))
    member = files.zip_member(files.files(spark, str(tmp_path), "*.zip"), ".nat").collect()
    assert [(r.member, bytes(r.content)) for r in member] == [("a.nat", b"one")]
    segment = files.unpacked(files.files(spark, str(tmp_path), "*.bz2")).collect()
    assert segment[0].path.endswith("s.DAT") and bytes(segment[0].content) == b"segment"
