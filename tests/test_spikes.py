import numpy as np

import pyarrow as pa

from wayline.operators import spikes
from wayline.operators.spikes import FIELDS, SpikeConfig, exact_medians, implausible

SCHEMA = "record_id string, survey_id string, t long, lat double, lon double, accuracy_m double, speed_mps double, heading_deg double, id string, median double"


def track(n=400, survey="s", moving=True, **change):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        r = {"accuracy_m": 5.0 + rng.integers(0, 10) / 10, "speed_mps": 10.0 + rng.integers(-5, 5) / 10, "heading_deg": (359.0 + rng.integers(-30, 30) / 10) % 360}
        for k, f in change.items():
            r[k] = f(i, r[k])
        rows.append((f"r{i:05d}", survey, 1_704_067_100_000 + i * 1000, 10.0 + (i * 9e-5 if moving else 0.0), 179.9999, *[None if r[k] is None else float(r[k]) for k in ("accuracy_m", "speed_mps", "heading_deg")], "x", 1.0))
    return rows


def flags(spark, rows, config=SpikeConfig()):
    out = implausible(spark.createDataFrame(rows, SCHEMA), "record_id", "survey_id", "t", "lat", "lon", config).collect()
    assert len(out) == len(set(out))
    return {(r.id, r.field_name, r.reason) for r in out}


def test_each_kind(spark):
    rows = track(
        accuracy_m=lambda i, v: 60.0 if i in (30, 31, 32) else 0.0 if i == 200 else v,
        speed_mps=lambda i, v: 25.0 if i == 50 else 30.0 if 300 <= i < 304 else 101.0 if i == 90 else None if i == 91 else v,
        heading_deg=lambda i, v: 120.0 if i == 70 else 45.6 if 100 <= i < 170 else float("nan") if i == 250 else v,
    )
    want = {(f"r{i:05d}", "accuracy_m", "spike") for i in (30, 31, 32)} | {("r00200", "accuracy_m", "impossible"), ("r00050", "speed_mps", "spike"), ("r00090", "speed_mps", "impossible"), ("r00070", "heading_deg", "spike"), ("r00250", "heading_deg", "impossible")}
    want |= {(f"r{i:05d}", "heading_deg", "stuck") for i in range(100, 170)}
    assert flags(spark, rows) == want
    assert flags(spark, rows, SpikeConfig(chunk_ms=60_000, halo_ms=20_000)) == want  # runs and spikes over the edges of chunks


def test_stuck_needs_movement_length_and_nearness(spark):
    parked = track(moving=False, speed_mps=lambda i, v: 0.0)
    assert flags(spark, parked) == set()
    short = track(speed_mps=lambda i, v: 7.7 if i < 59 else v)
    assert flags(spark, short) == set()


def test_copies_and_dirt(spark):
    rows = track(120, speed_mps=lambda i, v: 40.0 if i == 60 else v)
    copy = ("zz", *rows[60][1:5], 5.4, 40.0, 359.0, "x", 1.0)
    blank = [(None, "s", 5, 1.0, 1.0, -1.0, -1.0, -1.0, "x", 1.0), ("no-t", "s", None, 1.0, 1.0, 5.0, -1.0, 400.0, "x", 1.0), ("no-s", None, 7, 1.0, 1.0, None, 200.0, None, "x", 1.0)]
    got = flags(spark, rows + [copy, rows[60]] + blank)
    assert got == {("r00060", "speed_mps", "spike"), ("zz", "speed_mps", "spike"), ("no-t", "speed_mps", "impossible"), ("no-t", "heading_deg", "impossible"), ("no-s", "speed_mps", "impossible")}
    assert flags(spark, []) == set()


def test_parked_with_strays_is_not_stuck(spark):
    for strays in (range(97, 100), range(0, 3), range(40, 47)):
        rows = [(*r[:4], 180.0 - 0.002 if i in strays else r[4], *r[5:]) for i, r in enumerate(track(100, moving=False, speed_mps=lambda i, v: 0.0))]
        assert flags(spark, rows) == set()


def table(v, field, step=1000):
    """One chunk of readings of one field, as the operator's tasks get it."""
    t0 = 1_704_067_200_000
    n = len(v)
    cols = {"id": [f"r{i:05d}" for i in range(n)], "t": [t0 + i * step for i in range(n)], "lat": [10.0 + i * 9e-5 for i in range(n)], "lon": [20.0] * n}
    cols |= {f.name: pa.array([float(x) for x in v] if f is field else [None] * n, pa.float64()) for f in FIELDS}
    return (pa.scalar("s"), pa.scalar(t0 // SpikeConfig().chunk_ms)), pa.table(cols)


def found(v, field, kind):
    out = spikes._pieces(*table(v, field), SpikeConfig()).to_pylist()
    return {i for r in out if r["kind"] == kind and not r["opens"] and not r["closes"] for i in r["ids"]}


def by_rule(v, f, limit, agree=0.5, longest=3):
    def off(a, b):
        d = abs(a - b)
        return min(d, f.period - d) if f.period else d

    out = set()
    for i in range(1, len(v)):
        for j in range(i + 1, min(i + longest, len(v) - 1) + 1):
            if off(v[i - 1], v[j]) <= agree * limit and all(min(off(x, v[i - 1]), off(x, v[j])) > limit for x in v[i:j]):
                out |= {f"r{k:05d}" for k in range(i, j)}
    return out


def test_flagged_innovations_are_the_rules_spikes_on_quiet_sources():
    rng = np.random.default_rng(0)
    for trial in range(40):
        f = FIELDS[1 + trial % 2]
        v = np.cumsum(rng.normal(0, 0.02 * f.limit, 300)) + (50.0 if f.name == "speed_mps" else 180.0)
        for i in range(5, 290, 12):
            v[i : i + rng.integers(1, 4)] += f.limit * rng.choice([-1.4, 1.4, 2.5])
        v = np.clip(v, 0, 99.9) if f.name == "speed_mps" else np.mod(v, 360.0)
        assert found(v, f, "spike") == by_rule(v, f, f.limit)


def test_without_the_filter_the_result_is_another(monkeypatch):
    speed = FIELDS[1]
    rng = np.random.default_rng(1)
    v = 10 + rng.normal(0, 0.3, 400)
    v[50], v[200:280] = 30.0, 12.3
    assert found(v, speed, "spike") == {"r00050"} and len(found(v, speed, "stuck")) == 80
    # a source whose readings scatter by more than the limit has no spikes, whatever the rule alone would say
    wild = 50 + rng.normal(0, 12.0, 400)
    assert by_rule(wild, speed, speed.limit) and len(found(wild, speed, "spike")) * 10 < len(by_rule(wild, speed, speed.limit))
    everything = lambda t, v, *_: ([(1, len(v) - 1)] if len(v) < 4 else [], np.zeros(len(v), bool))
    monkeypatch.setattr(spikes, "kalman", everything)
    assert found(v, speed, "spike") == set() and found(v, speed, "stuck") == set()
    monkeypatch.setattr(spikes, "kalman", lambda t, v, *_: ([(i, i + 1) for i in range(1, len(v) - 1)], np.ones(len(v), bool)))
    assert len(found(wild, speed, "spike")) > 20


def test_medians_by_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(x)) for s, n in (("a", 1), ("b", 2), ("c", 999), ("d", 1000)) for x in np.round(rng.lognormal(2, 1, n), 2)] + [("e", 5.0)] * 50 + [("f", 1e-200), ("g", None)]
    got = {r.source: r.median for r in exact_medians(spark.createDataFrame(rows, "s string, x double").where("x is not null"), "s", "x").collect()}
    want = {s: sorted(x for k, x in rows if k == s) for s in "abcdef"}
    assert got == {s: v[(len(v) + 1) // 2 - 1] for s, v in want.items()}
