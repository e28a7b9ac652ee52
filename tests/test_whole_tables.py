"""Queries of whole tables and of full sizes against brute force."""

import collections
import os

import numpy as np
import pytest

from skyloom import registry
from skyloom.operators import procedural
from skyloom.sources.views import patch_px

SF = "/root/testdata/sf0.001"


def test_worley_volume(spark):
    points = np.array([(r.px, r.py, r.pz) for r in procedural.cell_points(spark, 8).collect()])
    f1 = {r.i: r.f1 for r in registry.queries()["worley"](spark, SF).collect()}
    v = {r.i: r.v for r in registry.queries()["worley_volume"](spark, SF).collect()}
    assert sorted(f1) == sorted(v) == list(range(64**3))
    for i in [*range(0, 64**3, 997), 64**3 - 1]:
        d = np.abs((np.array([i % 64, i // 64 % 64, i // 4096]) + 0.5) / 64 - points)
        want = np.sqrt((np.minimum(d, 1 - d) ** 2).sum(axis=1).min())
        assert abs(f1[i] - want) < 2e-6 and abs(v[i] - (1 - min(want * 8, 1))) < 2e-5


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_components_of_every_tile(spark, tmp_path):
    lit = collections.defaultdict(set)
    spark.range(250).selectExpr("id AS vec_id", "id AS label", "transform(sequence(0, 63), i -> cast(pmod(hash(id, i), 100) / 200D AS float)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    for r in patch_px(spark, str(tmp_path)).collect():
        if r.v > 0.15:
            lit[r.tile].add((r.y, r.x))
    want = {}
    for tile, left in lit.items():
        while left:
            group, new = set(), {min(left)}
            while new:
                group |= new
                new = {(y + a, x + b) for y, x in new for a in (-1, 0, 1) for b in (-1, 0, 1)} & left - group
            left -= group
            first = min(group)
            want |= {(tile, *p): first[0] * 8 + first[1] + 1 for p in group}
    got = {(r.tile, r.y, r.x): r.label for r in registry.queries()["components"](spark, str(tmp_path)).collect()}
    assert len(lit) == 250 and got == want
