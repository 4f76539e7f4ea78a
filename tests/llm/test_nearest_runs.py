import random

from pyspark.sql import functions as F

from wayline.llm.nearest import nearest_in_time
from wayline.llm.runs import collapse_runs, damage_class

L, R = "frame_id string, s string, t long, chunk int", "record_id string, s string, t long, entity string"


def nearest(spark, left, right, tolerance=15, bucket=100):
    out = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "frame_id", "record_id", "s", "s", "t", "t", tolerance, bucket).collect()
    return sorted((r.left_id, r.right_id, r.distance) for r in out)


def test_nearest_against_brute_force(spark):
    rng = random.Random(3)
    left = [(f"f{i:03d}", f"s{i % 3}", rng.randrange(-500, 2000), 0) for i in range(300)]
    right = [(f"r{i:03d}", f"s{i % 3}", rng.randrange(-500, 2000), "") for i in range(150)]
    want = []
    for f, s, t, _ in left:
        near = min(((abs(t - u), u, r) for r, q, u, _ in right if q == s), default=None)
        if near and near[0] <= 15:
            want.append((f, near[2], near[0]))
    assert nearest(spark, left + left[:9], right + right[:9]) == sorted(want)


def test_nearest_ties_and_dirt(spark):
    left = [("mid", "s", 105, 0), ("edge", "s", 125, 0), ("out", "s", 126, 0), (None, "s", 100, 0), ("n", None, 100, 0), ("m", "s", None, 0), ("lone", "x", 100, 0)]
    right = [("late", "s", 110, ""), ("b", "s", 100, ""), ("a", "s", 100, ""), (None, "s", 105, ""), ("c", None, 105, ""), ("d", "s", None, "")]
    assert nearest(spark, left, right) == [("edge", "late", 15), ("mid", "a", 5)]
    assert nearest(spark, [], right) == [] and nearest(spark, left, []) == []


SCHEMA = "id string, track string, survey string, t long, c string, x double, entity string"


def runs(spark, rows, partitions=4, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(partitions)
    return sorted(tuple(r) for r in collapse_runs(df, ["survey", "track"], "t", "id", F.col("c"), 10, **kw).collect())


def brute(rows):
    out = []
    for r in sorted({r for r in rows if None not in (r[0], r[1], r[2], r[3])}, key=lambda r: (r[2], r[1], r[3], r[0])):
        if out and (out[-1][0], out[-1][1], out[-1][2]) == (r[2], r[1], r[4]) and r[3] - out[-1][6] <= 10:
            out[-1] = (*out[-1][:4], r[0], out[-1][5], r[3], out[-1][7] + 1, r[3] - out[-1][5])
        else:
            out.append((r[2], r[1], r[4], r[0], r[0], r[3], r[3], 1, 0))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def test_runs_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"e{i:04d}", f"t{min(rng.randrange(6), 2)}", "s", rng.randrange(0, 4000), rng.choice(["a", "a", "a", "b", None]), 0.0) for i in range(900)]
    dirt = [(None, "t0", "s", 1, "a", 0.0), ("q", None, "s", 1, "a", 0.0), ("q", "t0", None, 1, "a", 0.0), ("q", "t0", "s", None, "a", 0.0)]
    got = sorted(runs_any(spark, rows + rows[:50] + dirt), key=lambda r: tuple(map(str, r)))
    assert got == brute(rows)
    assert runs_any(spark, []) == []


def runs_any(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return [tuple(r) for r in collapse_runs(df, ["survey", "track"], "t", "id", F.col("c"), 10).collect()]


def test_one_entity_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(f"e{i:04d}", "t", "s", i, "a" if i < 950 else "b", 0.0) for i in range(1000)]
        assert sorted(r[3:8] for r in runs_any(spark, rows)) == [("e0000", "e0949", 0, 949, 950), ("e0950", "e0999", 950, 999, 50)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_tolerance_is_measured_from_the_anchor(spark):
    rows = [(f"e{i}", "t", "s", i, "a", x) for i, x in enumerate([1.0, 1.4, 1.8, 2.4, 2.6, None, None, 2.6])]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = sorted((r.first_id, r.n) for r in collapse_runs(df, ["survey", "track"], "t", "id", F.col("c"), 10, {"x": 0.9}).collect())
    assert got == [("e0", 3), ("e3", 2), ("e5", 2), ("e7", 1)]


def test_labels(spark):
    labels = ["D40", " d00", "LONGITUDINAL-CRACK", "alligator crack\t", "Pothole", "other_thing", None]
    df = spark.createDataFrame([(x,) for x in labels], "c string").select(damage_class(F.col("c")).alias("c"))
    assert [r.c for r in df.collect()] == ["pothole", "longitudinal_crack", "longitudinal_crack", "alligator_crack", "pothole", "other_thing", None]
