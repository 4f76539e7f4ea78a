import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayline.operators.rtree import RTree
from wayline.operators.spatial import _metres, in_zones, near_pairs

SCHEMA = "frame_id string, survey_id string, lat double, lon double, leaf string, id string"


def brute(rows, radius):
    ok = [r for r in rows if r[0] and r[2] is not None and r[3] is not None and abs(r[2]) <= 90 and abs(r[3]) <= 180 and (r[2], r[3]) != (0, 0)]
    return {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[1] != b[1] and _metres(np.array(a[2]), np.array(a[3]), b[2], b[3]) <= radius}


@given(st.integers(0, 200), st.integers(1, 60), st.integers(0, 9))
@settings(max_examples=40, deadline=None)
def test_rtree_finds_all(n, m, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 20, n).astype(float), rng.integers(0, 20, n).astype(float)
    a, b = rng.integers(0, 20, m).astype(float), rng.integers(0, 20, m).astype(float)
    got = {(int(q), int(k)) for qs, ks in RTree(x, y, x, y).probe(a - 1, b - 1, a + 1, b + 1, most=64) for q, k in zip(qs, ks)}
    assert got == {(q, k) for q in range(m) for k in range(n) if abs(a[q] - x[k]) <= 1 and abs(b[q] - y[k]) <= 1}


@pytest.mark.parametrize("block", [40_000, 20])
@pytest.mark.parametrize("place", [(10.0, 20.0), (62.0, 180.0), (-89.99999, 0.0), (0.0, -180.0)])
def test_near_pairs(spark, place, block):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        la = float(np.clip(place[0] + rng.normal(0, 2e-4), -90, 90))
        lo = (place[1] + rng.normal(0, 3e-4) / max(np.cos(np.radians(la)), 1e-3) + 540) % 360 - 180
        rows.append((f"f{i:03d}", f"s{i % 4}", la, float(lo), "x", "y"))
    rows += [rows[3], rows[4], (None, "s1", *place, "x", "y"), ("bad", "s1", 0.0, 0.0, "x", "y"), ("nan", "s1", None, 1.0, "x", "y"), ("tie", "s9", rows[5][2], rows[5][3], "x", "y")]
    got = [tuple(r) for r in near_pairs(spark.createDataFrame(rows, SCHEMA), "frame_id", "survey_id", "lat", "lon", 20.0, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 20.0) and got


def test_no_points(spark):
    none = spark.createDataFrame([], SCHEMA)
    zones = spark.createDataFrame([], "zone_id string, ring array<struct<lat double, lon double>>, hole array<struct<lat double, lon double>>")
    assert near_pairs(none, "frame_id", "survey_id", "lat", "lon", 6.0).count() == 0
    assert in_zones(none, "frame_id", "lat", "lon", zones).count() == 0


@pytest.mark.parametrize("block", [150_000, 10])
def test_zones(spark, block):
    square = lambda s, w, n, e: [(s, w), (s, e), (n, e), (n, w)]
    zones = [
        ("plain", square(10.0, 10.0, 11.0, 11.0), None),
        ("closed", [*square(10.0, 10.0, 11.0, 11.0), (10.0, 10.0)][::-1], square(10.4, 10.4, 10.6, 10.6)),
        ("dateline", square(-1.0, 179.0, 1.0, -179.0), []),
        ("broken", [(1.0, 2.0), (3.0, 4.0)], None), ("none", None, None), (None, square(10.0, 10.0, 11.0, 11.0), None),
        ("bow", [(20.0, 20.0), (21.0, 21.0), (21.0, 20.0), (20.0, 21.0)], None),
    ]
    shape = "array<struct<lat double, lon double>>"
    z = spark.createDataFrame(zones, f"zone_id string, ring {shape}, hole {shape}")
    points = [("a", "", 10.5, 10.5), ("b", "", 10.2, 10.2), ("c", "", 0.5, 179.5), ("d", "", 0.5, -179.5), ("e", "", 0.5, 178.9), ("f", "", None, 1.0), (None, "", 10.5, 10.5), ("b", "", 10.2, 10.2), ("g", "", 20.1, 20.5), ("h", "", 20.1, 20.12), ("k", "", 20.5, 20.1)]
    p = spark.createDataFrame([(*x, "", "") for x in points], SCHEMA)
    got = [tuple(r) for r in in_zones(p, "frame_id", "lat", "lon", z, block=block).collect()]
    assert sorted(got) == sorted([("a", "plain"), ("b", "plain"), ("b", "closed"), ("c", "dateline"), ("d", "dateline"), ("g", "bow"), ("h", "bow")])
