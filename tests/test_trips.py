import numpy as np
import pytest

from wayline.operators.trips import StopConfig, stops_and_trips, tv_denoise

SCHEMA = "record_id string, survey_id string, t long, lat double, lon double, source string, chunk int"
BASE = 1_704_067_200_000


@pytest.mark.parametrize("lam", [0.5, 4.0, 100.0])
def test_denoising_is_optimal(lam):
    rng = np.random.default_rng(2)
    y = rng.normal(0, 3, 60).cumsum()
    x = tv_denoise(y.tolist(), lam)
    # the dual of the problem certifies the optimum: |u| <= lam, and = lam * sign where x steps
    u = np.cumsum(x - y)[:-1]
    assert np.all(np.abs(u) <= lam + 1e-9) and abs((x - y).sum()) < 1e-9
    step = np.diff(x)
    big = np.abs(step) > 1e-9
    assert np.allclose(u[big], lam * np.sign(step[big]))


def test_denoising_short():
    assert len(tv_denoise([], 1.0)) == 0 and tv_denoise([3.0], 1.0).tolist() == [3.0]


def drive(legs, hz=1.0, noise=1.5, seed=0, survey="s", lat0=-20.0, lon0=179.999, at=BASE):
    """legs: ('stop', seconds) or ('go', seconds, east m/s, north m/s) or ('gap', seconds)."""
    rng, rows, x, y, t = np.random.default_rng(seed), [], 0.0, 0.0, 0.0
    marks = []
    for leg in legs:
        if leg[0] == "gap":
            t += leg[1]
            continue
        vx, vy = leg[2:] if leg[0] == "go" else (0.0, 0.0)
        first = t
        for _ in range(int(leg[1] * hz)):
            lat = lat0 + (y + rng.normal(0, noise)) / 111195.0
            lon = lon0 + (x + rng.normal(0, noise)) / 111195.0 / np.cos(np.radians(lat0))
            rows.append((f"{survey}-{len(rows):06d}", survey, at + int(t * 1000), float(lat), float((lon + 540) % 360 - 180), "clash", 1))
            x, y, t = x + vx / hz, y + vy / hz, t + 1.0 / hz
        marks.append((leg[0], first, t))
    return rows, marks


def near(got, want, tol=6.0):
    return len(got) == len(want) and all(g[0] == w[0] and abs(g[1] - w[1]) <= tol and abs(g[2] - w[2]) <= tol for g, w in zip(got, want))


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = stops_and_trips(df, "survey_id", "t", "lat", "lon", "record_id", **kw).collect()
    return [(r.kind, (r.t0 - BASE) / 1000, (r.t1 - BASE) / 1000, r.distance_m) for r in sorted(out, key=lambda r: (r.source, r.t0))]


def test_stops_trips_strays_and_traffic(spark):
    rows, _ = drive([("stop", 200), ("go", 300, 10, 0), ("stop", 60), ("go", 200, 0, 12), ("stop", 400), ("go", 100, -9, 0)])
    strayed = [(*r[:3], r[3] + (0.003 if i in (50, 51, 400, 700) else 0), *r[4:]) for i, r in enumerate(rows)]
    got = found(spark, strayed + rows[:20] + [(None, None, None, None, None, "", 0), ("n", "s", BASE + 5, float("nan"), 1.0, "", 0), ("o", "s", BASE + 7, 0.0, 0.0, "", 0)])
    assert near(got, [("stop", 0, 200), ("trip", 200, 760), ("stop", 760, 1160), ("trip", 1160, 1259)])
    assert abs(got[1][3] - 300 * 10 - 200 * 12) < 700 and got[0][3] == 0


def test_gaps(spark):
    same, _ = drive([("go", 100, 10, 0), ("stop", 60), ("gap", 1500), ("stop", 60), ("go", 100, 10, 0)])
    assert near(found(spark, same), [("trip", 0, 100), ("stop", 100, 1720), ("trip", 1720, 1819)])
    other, _ = drive([("go", 100, 10, 0)])
    far, _ = drive([("go", 200, 10, 0)], lat0=-20.1, at=BASE + 1_000_000)
    assert near(found(spark, other + far), [("trip", 0, 99), ("trip", 1000, 1199)])
    tunnel = [r for i, r in enumerate(drive([("go", 600, 10, 0)])[0]) if not 200 <= i < 400]
    assert near(found(spark, tunnel), [("trip", 0, 599)])


def test_chunks_change_nothing(spark):
    rows, _ = drive([("go", 500, 8, 0), ("stop", 1500), ("go", 500, 0, 8), ("stop", 130), ("go", 300, 8, 0)], seed=4)
    whole = found(spark, rows)
    assert near(whole, [("trip", 0, 500), ("stop", 500, 2000), ("trip", 2000, 2500), ("stop", 2500, 2630), ("trip", 2630, 2929)])
    cut = found(spark, rows, config=StopConfig(chunk_s=700, halo_s=120))
    assert near(cut, [w[:3] for w in whole])


def test_nothing_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [("a", "s", BASE, 1.0, 1.0, "", 0)]) == []
    assert found(spark, [("a", "s", BASE, 1.0, 1.0, "", 0)] * 3) == []
