import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators import clustering, detect, evaluate, pixels, roads, rollup, store, track, tracking, training

T0 = 1_787_049_731_000
LAT, LON = 40.18231, 44.51491


def fixes(spark, rows):
    return spark.createDataFrame(rows, "record_id string, survey_id string, t long, lat double, lon double, accuracy_m double, speed_mps double, heading_deg double")


def straight(n=61, speed=10.0):
    return [(f"r{i:03d}", "s", T0 + i * 1000, LAT, LON + i * 0.0000118 * speed, 5.0, speed, 90.0) for i in range(n)]


def test_cleaning_counts_the_first_reason(spark):
    rows = straight(10)
    dirt = [
        ("x1", "s", T0, float("nan"), 500.0, 99.0, None, None), ("x2", "s", T0, 95.0, LON, 99.0, None, None), ("x3", "s", T0, LAT, LON, 25.1, None, None), ("x4", "s", T0 + 1000, LAT, LON, 3.0, None, None),
        ("x5", "s", T0 + 2000, LAT, LON, None, None, None), ("x6", "s", T0 + 99000, LAT, LON, 25.0, None, None), ("x7", "s", None, LAT, LON, 5.0, None, None),
    ]
    df = fixes(spark, rows + dirt)
    s = track.track_stats(df).first()
    assert (s.total_input, s.dropped_malformed, s.dropped_out_of_range, s.dropped_low_accuracy, s.kept, s.deduplicated, s.reordered) == (17, 2, 1, 1, 11, 2, True)
    kept = {r.t: r.accuracy_m for r in track.clean_track(df).collect()}
    assert kept[T0 + 1000] == 3.0 and kept[T0 + 2000] == 5.0


def test_distance_of_a_track(spark):
    r = track.track_distance(track.clean_track(fixes(spark, straight(11)))).first()
    assert r.n_fixes == 11 and abs(r.distance_m - 10 * 10.03) < 0.5
    assert track.track_distance(track.clean_track(fixes(spark, straight(1)))).first().distance_m == 0


def test_locate(spark):
    rows = straight(21)
    rows = [r for r in rows if not T0 + 5000 < r[2] < T0 + 17000]
    q = spark.createDataFrame([(i, "s", t) for i, t in enumerate([T0 - 2000, T0, T0 + 1500, T0 + 2000, T0 + 11000, T0 + 20000, T0 + 20500])] + [(99, "none", T0)], "k int, survey_id string, t long")
    hours = [track.TrackConfig(), track.TrackConfig(bucket_ms=700)]
    for c in hours:
        at = {r.k: r for r in track.locate(track.clean_track(fixes(spark, rows)), q, "k", c).collect()}
        assert set(at) == set(range(7))
        assert at[0].method == "phone_gps" and not at[0].is_trustworthy and at[0].uncertainty_m == 5.0 + 10.0 * 2
        assert at[1].is_trustworthy and at[1].gap_s == 0 and at[1].method == "phone_gps"
        assert abs(at[2].lon - (LON + 1.5 * 0.000118)) < 1e-9 and at[2].method == "interpolated_phone_gps"
        assert at[3].gap_s == 1.0 and abs(at[3].lon - (LON + 2 * 0.000118)) < 1e-9
        assert at[4].gap_s == 12.0 and not at[4].is_trustworthy
        assert at[5].method == "phone_gps" and at[6].uncertainty_m == 10.0


def test_sampling(spark):
    s = spark.createDataFrame([("s", T0, 60.0), ("empty", T0, 2.0)], "survey_id string, recording_start_epoch_ms long, duration_s double")
    moving = track.clean_track(fixes(spark, straight()))
    got = track.sampling_plan(s, moving).where("survey_id = 's'").orderBy("index").collect()
    assert got[0].distance_from_previous_m is None and all(r.distance_from_previous_m >= 2.5 for r in got[1:]) and len(got) == 241
    assert track.sampling_plan(s, moving, track.SamplingConfig(spacing_m=10.0)).where("survey_id = 's'").count() <= 61
    assert track.sampling_plan(s, moving).where("survey_id = 'empty'").count() == 9
    parked = track.clean_track(fixes(spark, straight(speed=0.0)))
    assert track.sampling_plan(s, parked).where("survey_id = 's'").count() == 0
    assert track.sampling_plan(s, moving, track.SamplingConfig(mode="fixed_fps", max_frames=5)).count() == 10


def test_sampling_against_the_rule(spark):
    rng = random.Random(12)
    rows, lon, t = [], LON, T0
    for i in range(160):
        speed = rng.choice([0.0, 0.5, 3.0, 9.0, None, float("nan")])
        lon, t = lon + 0.0000118 * (2.0 if speed is None or math.isnan(speed) else speed), t + rng.choice([500, 1000, 1000, 4000])
        rows.append((f"r{i:03d}", "s", t, LAT, lon, 5.0, speed, 90.0))
    kept = track.clean_track(fixes(spark, rows))
    s = spark.createDataFrame([("s", T0, (t - T0) / 1000.0)], "survey_id string, recording_start_epoch_ms long, duration_s double")
    grid = track.time_grid(s, 0.25)
    at = track.locate(kept, grid.select("survey_id", F.col("index").alias("k"), F.col("t_epoch_ms").alias("t")), "k").orderBy("k").collect()
    want, last = [], None
    for r in at:
        if r.speed_mps is not None and r.speed_mps < 1.0:
            continue
        if last is not None:
            p, q = math.radians(last.lat), math.radians(r.lat)
            d = 2 * 6371008.8 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(r.lon - last.lon) / 2) ** 2))
            if d < 2.5 or r.t - last.t < 100:
                continue
        want.append(r.t)
        last = r
    got = [r.t_epoch_ms for r in track.sampling_plan(s, kept).orderBy("index").collect()]
    assert got == want and len(want) > 40


def test_sampling_where_no_join_is_broadcast(spark):
    rows = [(f"r{s}{i}", f"s{s}", T0 + i * 1000, LAT, LON + i * 0.000118, 5.0, 10.0, 90.0) for s in range(30) for i in range(40)]
    s = spark.createDataFrame([(f"s{k}", T0, 39.0) for k in range(31)], "survey_id string, recording_start_epoch_ms long, duration_s double")
    plan = lambda: {r.survey_id: r["count"] for r in track.sampling_plan(s, track.clean_track(fixes(spark, rows))).groupBy("survey_id").count().collect()}
    want = plan()
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.unionOutputPartitioning")}
    try:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "12"), ("spark.sql.unionOutputPartitioning", "true")):
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.unionOutputPartitioning")  # its default is true, too
        assert plan() == want and len(want) == 31 and want["s0"] > 100
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def frames_and_boxes(spark, boxes, times):
    f = spark.createDataFrame([("s", f"f{i:02d}", T0 + t) for i, t in enumerate(times)], "survey_id string, frame_id string, t_epoch_ms long")
    d = spark.createDataFrame(boxes, "frame_id string, detection_id string, damage_class string, confidence double, x1 double, y1 double, x2 double, y2 double")
    return f, d


def test_tracking_rules(spark):
    box = lambda f, n, c="pothole", x=0.0: (f"f{f:02d}", n, c, 0.5, 10.0 + x, 10.0, 110.0 + x, 110.0)
    boxes = [box(0, "a"), box(1, "b", x=20), box(1, "other", x=500), box(2, "c", "transverse_crack", x=20), box(3, "d", x=30), box(6, "e", x=30), box(7, "f", x=30)]
    f, d = frames_and_boxes(spark, boxes, [0, 400, 800, 1200, 1600, 2000, 2400, 4500])
    got = {r.detection_id: r.track_no for r in tracking.track_detections(f, d).collect()}
    assert got["a"] == got["b"] == got["d"] == got["e"] and len({got["a"], got["other"], got["c"], got["f"]}) == 4
    s = {r.track_no: r for r in tracking.summarize_tracks(tracking.track_detections(f, d), ["survey_id", "track_no"]).collect()}
    assert s[got["a"]].n_detections == 4 and s[got["a"]].best_detection_id == "a"


def test_tracking_against_the_rule(spark):
    rng = random.Random(3)
    times, boxes = [], []
    for k in range(60):
        times.append((times[-1] if times else 0) + rng.choice([200, 500, 900, 2500]))
        for j in range(rng.randrange(0, 5)):
            x = 100.0 * rng.randrange(4) + rng.uniform(0, 60)
            boxes.append((f"f{k:02d}", f"d{k:02d}{j}", rng.choice(["pothole", "alligator_crack"]), 0.5, x, 10.0, x + 100.0, 110.0))
    f, d = frames_and_boxes(spark, boxes, times)
    got = {r.detection_id: r.track_no for r in tracking.track_detections(f, d).collect()}
    open_, n, want = {}, 0, {}
    for k, t in enumerate(times):
        here = [b for b in boxes if b[0] == f"f{k:02d}"]
        open_ = {no: tr for no, tr in open_.items() if t - tr[1] <= 2000}
        pairs = sorted(((-tracking.box_iou(tr[0], b[4:]), a, j) for a, (no, tr) in enumerate(open_.items()) for j, b in enumerate(here) if tr[2] == b[2]), key=lambda p: p)
        nos, taken, met = list(open_), set(), {}
        for v, a, j in pairs:
            if -v >= 0.15 and a not in taken and j not in met:
                taken.add(a)
                met[j] = nos[a]
        for a, no in enumerate(nos):
            if a not in taken:
                open_[no][3] += 1
        open_ = {no: tr for no, tr in open_.items() if tr[3] <= 2}
        for j, b in enumerate(here):
            if j not in met:
                n += 1
                met[j] = n
            open_[met[j]] = [b[4:], t, b[2], 0]
            want[b[1]] = met[j]
    assert got == want and n > 20


def candidates(spark, places, cls="pothole", u=5.0):
    rows = [(f"o{i:03d}", "s", i, cls if isinstance(cls, str) else cls[i], 0.5, LAT, LON + m * 0.0000118, u, f"f{i}") for i, m in enumerate(places)]
    df = spark.createDataFrame(rows, "observation_id string, survey_id string, o long, damage_class string, confidence double, lat double, lon double, uncertainty_m double, representative_frame_id string")
    return df.withColumn("observed_at", F.timestamp_seconds(F.col("o") + 1_787_000_000)).drop("o")


def test_clustering_both_ways(spark):
    n = lambda df: clustering.cluster(df).select("cluster_id").distinct().count()
    assert n(candidates(spark, [5.0 * i for i in range(100)])) > 10
    assert n(candidates(spark, [0.4 * i for i in range(20)])) == 1
    assert n(candidates(spark, [0, 3])) == 1 and n(candidates(spark, [0, 200])) == 2
    assert n(candidates(spark, [0, 1], ["pothole", "transverse_crack"])) == 2
    d = clustering.defects_of(clustering.cluster(candidates(spark, [0, 1, 2]))).first()
    assert d.observation_count == 3 and d.uncertainty_m >= 5.0 and d.survey_ids == ["s"]


def by_sequence(df):
    """The rule itself: one candidate after another, against all clusters."""
    c, clusters, out = clustering.ClusteringConfig(), {}, {}
    for r in df.orderBy("observed_at", "observation_id").collect():
        best, to = math.inf, r.observation_id
        for k, m in clusters.items():
            if m[0].damage_class != r.damage_class:
                continue
            d = min(float(clustering._metres(np.array([x.lat]), np.array([x.lon]), r.lat, r.lon)[0]) for x in m)
            both = [*m, r]
            w = np.array([1 / max(x.uncertainty_m, 0.5) ** 2 for x in both])
            la, lo = np.array([x.lat for x in both]), np.array([x.lon for x in both])
            far = clustering._metres(la, lo, float((w * la).sum() / w.sum()), float((w * lo).sum() / w.sum())).max()
            if d <= min(c.merge_radius_m + r.uncertainty_m + max(x.uncertainty_m for x in m), c.max_merge_radius_m) and d < best and far <= c.max_extent_m:
                best, to = d, k
        clusters.setdefault(to, []).append(r)
        out[r.observation_id] = to
    return out


def test_clustering_by_tiles_is_the_global_rule(spark):
    rng = random.Random(4)
    df = candidates(spark, [rng.uniform(0, 900) for _ in range(150)], [rng.choice(["pothole", "alligator_crack"]) for _ in range(150)], u=3.0)
    for tile in (2000.0, 130.0):
        got = {r.observation_id: r.cluster_id for r in clustering.cluster(df, clustering.ClusteringConfig(tile_m=tile)).collect()}
        assert got == by_sequence(df)


def test_clustering_of_a_long_chain_and_over_the_180th_meridian(spark):
    n = 20_000
    rows = spark.range(n).select(F.format_string("o%06d", "id").alias("observation_id"), F.lit("s").alias("survey_id"), F.timestamp_seconds(F.col("id") + 1_787_000_000).alias("observed_at"), F.lit("pothole").alias("damage_class"), F.lit(0.5).alias("confidence"), F.lit(0.0001).alias("lat"), (F.pmod(179.5 + F.col("id") * 0.00005 + F.rand(3) * 0.00002 + 180.0, F.lit(360.0)) - 180.0).alias("lon"), F.lit(2.0).alias("uncertainty_m"), F.lit("f").alias("representative_frame_id"))
    rows = clustering.checkpoint(rows)
    got = {r.observation_id: r.cluster_id for r in clustering.cluster(rows).collect()}
    r = rows.orderBy("observation_id").toPandas()
    assert r.lon.max() > 179.99 and r.lon.min() < -179.99
    want = clustering.greedy_clusters(r.observation_id.tolist(), r.lat.tolist(), [x % 360.0 for x in r.lon], r.uncertainty_m.tolist(), r.damage_class.tolist(), clustering.ClusteringConfig())
    assert got == dict(zip(r.observation_id, want)) and 1000 < len(set(want)) < 8000


def network(spark):
    deg = 0.0000118
    rows = []
    for name, way, a, b, one in (("East", "1", (LAT, LON), (LAT, LON + 400 * deg), False), ("North", "2", (LAT - 0.0018, LON + 200 * deg), (LAT + 0.0018, LON + 200 * deg), True), (None, "3", (LAT + 0.01, LON), (LAT + 0.01, LON + 400 * deg), False)):
        for i in range(5):
            p = [tuple(u + (v - u) * k / 5 for u, v in zip(a, b)) for k in (i, i + 1)]
            rows.append((f"way/{way}#{i}", f"way/{way}", i, *p[0], *p[1], name, "residential", one))
    return spark.createDataFrame(rows, "segment_id string, way_id string, seg_ord long, a_lat double, a_lon double, b_lat double, b_lon double, name string, highway string, oneway boolean")


def test_matching(spark):
    deg = 0.0000118
    rows = [
        ("on", LAT + 3e-5, LON + 60 * deg, 5.0, 270.0), ("between", LAT + 2e-5, LON + 202 * deg, 5.0, None), ("cross", LAT + 2e-5, LON + 60 * deg, 5.0, 0.0), ("far", LAT + 0.005, LON, 5.0, None),
        ("wrong", LAT + 0.0012, LON + 200 * deg, 5.0, 180.0), ("right", LAT + 0.0012, LON + 201 * deg, 5.0, 10.0), ("past", LAT, LON - 10 * deg, 3.0, None),
    ]
    p = spark.createDataFrame(rows, "point_id string, lat double, lon double, uncertainty_m double, heading_deg double")
    got = {r.point_id: r for r in roads.match_points(p, network(spark)).collect()}
    assert roads.match_points(p, network(spark), roads.MatchingConfig(require_named=True)).where("way_id = 'way/3'").count() == 0
    assert {k: r.reason for k, r in got.items()} == {"on": "matched", "between": "ambiguous", "cross": "heading_mismatch", "far": "no_candidates", "wrong": "heading_mismatch", "right": "matched", "past": "matched"}
    assert got["on"].way_id == "way/1" and abs(got["on"].lat - LAT) < 1e-6 and got["on"].uncertainty_m == 5.0 and got["on"].heading_delta_deg < 1
    assert got["far"].lat == rows[3][1] and abs(got["past"].match_distance_m - 10) < 0.1 and abs(got["past"].lon - LON) < 1e-9


def test_matching_over_the_180th_meridian(spark):
    deg = 0.00001
    seg = spark.createDataFrame([(f"way/1#{i}", "way/1", i, 1.0, 179.9995 + i * 50 * deg - (360 if i > 9 else 0), 1.0, 179.9995 + (i + 1) * 50 * deg - (360 if i >= 1 else 0), "Line", "road", False) for i in (0, 1)] + [("way/2#0", "way/2", 0, 2.0, 179.999, 2.001, -179.999, "Over", "road", False)], "segment_id string, way_id string, seg_ord long, a_lat double, a_lon double, b_lat double, b_lon double, name string, highway string, oneway boolean")
    p = spark.createDataFrame([("west", 1.00001, 179.99975, 5.0, None), ("east", 1.00001, -179.9998, 5.0, None), ("edge", 1.00001, 180.0, 5.0, None), ("on", 2.0005 + 1e-5, 180.0, 5.0, None), ("on2", 2.00075, -179.9995, 5.0, None), ("off", 2.0005, -179.99, 5.0, None)], "point_id string, lat double, lon double, uncertainty_m double, heading_deg double")
    got = {r.point_id: r.way_id for r in roads.match_points(p, seg).collect()}
    assert got == {"west": "way/1", "east": "way/1", "edge": "way/1", "on": "way/2", "on2": "way/2", "off": None}


def test_matching_against_all_pairs(spark):
    rng = random.Random(2)
    seg, pts = [], []
    for i in range(60):
        a, b = (LAT + rng.uniform(0, 0.02), LON + rng.uniform(0, 0.02)), rng.uniform(0, 0.006)
        seg.append((f"way/{i}#0", f"way/{i}", 0, *a, a[0] + rng.uniform(-b, b), a[1] + rng.uniform(-b, b), None, "road", False))
    for i in range(400):
        s, f = rng.choice(seg), rng.random()
        pts.append((f"p{i}", s[3] + (s[5] - s[3]) * f + rng.uniform(-3e-4, 3e-4), s[4] + (s[6] - s[4]) * f + rng.uniform(-3e-4, 3e-4), rng.uniform(0, 20), None))
    p = spark.createDataFrame(pts, "point_id string, lat double, lon double, uncertainty_m double, heading_deg double")
    g = spark.createDataFrame(seg, "segment_id string, way_id string, seg_ord long, a_lat double, a_lon double, b_lat double, b_lon double, name string, highway string, oneway boolean")
    near = geo.with_projection(p.withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"}).join(g), "p_lat", "p_lon", "a_lat", "a_lon", "b_lat", "b_lon").where("distance_m <= 20").groupBy("point_id").agg(F.min(F.struct("distance_m", "segment_id")).alias("m"))
    want = {r.point_id: r.m.segment_id for r in near.collect()}
    got = {r.point_id: r for r in roads.match_points(p, g, roads.MatchingConfig(ambiguity_m=0.0, min_radius_m=20.0)).collect()}
    assert {k: r.segment_id for k, r in got.items() if r.reason == "matched"} == want and len(want) > 200


def test_rollup_knows_clean_from_never_driven(spark):
    deg = 0.0000118
    f = spark.createDataFrame([(f"f{i}", "s", T0 + i, float(i), LAT + 1e-5, LON + 5 * i * deg, 5.0, 90.0) for i in range(30)] + [("z", "s", T0 + 999, 99.0, LAT + 0.01, LON, 5.0, None)], "frame_id string, survey_id string, t_epoch_ms long, video_time_s double, lat double, lon double, uncertainty_m double, heading_deg double")
    d = spark.createDataFrame([("d1", "pothole", "repaired", LAT + 1e-5, LON + 50 * deg, 4.0, None, "s"), ("d2", "pothole", "rejected", LAT, LON + 60 * deg, 4.0, "way/1#0", "s"), ("d3", "pothole", "verified", LAT + 0.05, LON, 4.0, None, "s")], "defect_id string, damage_class string, status string, lat double, lon double, uncertainty_m double, segment_id string, survey_id string")
    seg = network(spark)
    cover = rollup.coverage_by_way(f, seg)
    r = {x.way_id: x for x in rollup.street_report(rollup.ways_of_defects(d, seg), cover, seg, True).collect()}
    assert r["way/1"].state == "defects" and (r["way/1"].probable, r["way/1"].rejected, r["way/1"].pothole) == (1, 1, 1)
    assert abs(r["way/1"].surveyed_m - 145) < 1.5 and r["way/1"].defects_per_100m == round(1 / r["way/1"].surveyed_m * 100, 2)
    assert r["way/3"].state == "not_surveyed" and r["way/3"].surveyed_m == 0


def test_evaluation(spark):
    box = "image_id string, damage_class string, box_id string, {}x1 double, y1 double, x2 double, y2 double"
    g = spark.createDataFrame([("i", "pothole", "g1", 0.0, 0.0, 10.0, 10.0), ("i", "pothole", "g2", 20.0, 0.0, 30.0, 10.0), ("i", "alligator_crack", "g3", 0.0, 0.0, 5.0, 5.0)], box.format(""))
    p = spark.createDataFrame([("i", "pothole", "p1", 0.9, 0.0, 0.0, 10.0, 10.0), ("i", "pothole", "p2", 0.8, 0.0, 1.0, 10.0, 11.0), ("i", "pothole", "p3", 0.7, 20.0, 0.0, 30.0, 10.0), ("i", "pothole", "p4", 0.7, 50.0, 0.0, 60.0, 10.0)], box.format("score double, "))
    m = evaluate.match_boxes(p, g)
    assert {r.box_id: r.hit for r in m.collect()} == {"p1": True, "p2": False, "p3": True, "p4": False}
    s = {r.damage_class: r for r in evaluate.class_scores(m, g).collect()}
    assert (s["pothole"].tp, s["pothole"].fp, s["pothole"].fn) == (2, 2, 0) and s["alligator_crack"].precision is None and s["alligator_crack"].recall == 0
    ap = {r.damage_class: r.ap for r in evaluate.average_precision(m, g).collect()}
    assert abs(ap["pothole"] - (0.5 * 1.0 + 0.5 * 2 / 3)) < 1e-9 and ap["alligator_crack"] == 0
    extra = p.union(spark.createDataFrame([("i", "transverse_crack", "p5", 0.9, 0.0, 0.0, 1.0, 1.0)], box.format("score double, ")))
    every = evaluate.scores(evaluate.match_boxes(extra, g), g)
    odd = every.where("damage_class = 'transverse_crack'").first()
    assert (odd.fp, odd.recall, odd.ap) == (1, None, None)
    t = evaluate.totals(every).first()
    assert (t.tp, t.fp, t.fn, t.n_classes) == (2, 3, 1, 3) and abs(t.map50 - ap["pothole"] / 2) < 1e-9 and abs(t.macro_f1 - s["pothole"].f1) < 1e-9
    assert "n/a" in evaluate.report(every) and "pothole" in evaluate.report(every)
    with pytest.raises(ValueError):
        evaluate.totals(every, "train")


def test_claims_against_the_rule(spark):
    rng = random.Random(6)
    rows, truth = [], []
    for k in range(40):
        for j in range(rng.randrange(0, 7)):
            x = rng.uniform(0, 12)
            (rows if rng.random() < 0.6 else truth).append((f"i{k % 20}", rng.choice("ab"), f"b{k:02d}{j}", round(rng.random(), 1), x, 0.0, x + 10, 10.0))
    kind = "image_id string, damage_class string, box_id string, score double, x1 double, y1 double, x2 double, y2 double"
    got = {r.box_id: r.hit for r in evaluate.match_boxes(spark.createDataFrame(rows, kind), spark.createDataFrame(truth, kind)).collect()}
    want, used = {}, set()
    for r in sorted(rows, key=lambda r: (-r[3], r[2])):
        near = [(-tracking.box_iou(r[4:], g[4:]), g[2]) for g in truth if g[:2] == r[:2] and g[2] not in used]
        hit = bool(near) and -min(near)[0] >= 0.5
        want[r[2]] = hit
        if hit:
            used.add(min(near)[1])
    assert got == want and any(want.values())


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, first string, v int")
    new = spark.createDataFrame([(2, "x", None), (3, "c", 3)], "k int, first string, v int")
    got = sorted(tuple(r) for r in store.upsert(old, new, ["k"], ["first"]).collect())
    assert got == [(1, "a", 1), (2, "b", None), (3, "c", 3)]
    path = str(tmp_path / "t")
    store.replace_table(old, path)
    store.replace_table(store.upsert(store.read_table(spark, path), new, ["k"]), path)
    back = store.read_table(spark, path, {"later": "string"})
    assert back.count() == 3 and back.columns == ["k", "first", "v", "later"]
    log, refused = store.append_only(old, new.union(new), "k")
    assert log.count() == 3 and refused.count() == 3 and store.orphans(new, old, "k").count() == 1
    entries = spark.createDataFrame([("d", 1, "a", "x"), ("d", 3, "b", None), ("d", 2, "c", "y")], "d string, at int, p string, q string")
    r = store.current_state(entries, "d", "at", "p", ["p", "q"]).first()
    assert (r.p, r.q, r.n_entries) == ("b", "y", 3)


def test_pixels(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 255, (40, 60, 3)).astype(np.uint8)
    flat = np.full((40, 60, 3), 10, np.uint8)
    df = spark.createDataFrame([("noisy", img.tobytes(), 40, 60, 3), ("flat", flat.tobytes(), 40, 60, 3), ("none", None, None, None, None)], "image_id string, data binary, height int, width int, channels int")
    v = {r.image_id: r.v for r in pixels.score_images(df).select("image_id", pixels.verdict(F.col("blur"), F.col("brightness")).alias("v")).collect()}
    assert (v["noisy"].quality, v["flat"].quality, v["none"].quality) == ("accepted", "rejected", "accepted") and set(v["flat"].reasons) == {"too_blurred", "too_dark"}
    out = pixels.redact_images(df.where("data is not null"), spark.createDataFrame([("noisy", 10.0, 10.0, 40.0, 30.0)], "image_id string, x1 double, y1 double, x2 double, y2 double")).collect()
    got = {r.image_id: np.frombuffer(r.data, np.uint8).reshape(40, 60, 3) for r in out}
    assert (got["flat"] == flat).all() and (got["noisy"][:5] == img[:5]).all() and (got["noisy"][12:28, 12:38] != img[12:28, 12:38]).mean() > 0.9


def test_detectors_and_splits(spark):
    f = spark.range(400).select(F.format_string("f%d", "id").alias("frame_id"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    x = detect.fake_detector(f)
    assert 80 < x.count() < 160 and x.exceptAll(detect.fake_detector(f.repartition(3))).count() == 0 and detect.null_detector(f).count() == 0
    with pytest.raises(RuntimeError):
        detect.model_detector()
    rows = spark.createDataFrame([(f"i{i:03d}", "c", i) for i in range(90)] + [("k", "d", 1)], "image_id string, country string, i int")
    n = {r.split: r["count"] for r in training.contiguous_splits(rows.where("country = 'c'"), "country", ["i"]).groupBy("split").count().collect()}
    assert n == {"train": 62, "val": 13, "test": 15}
    assert training.survey_splits(rows.select(F.col("country").alias("survey_id")).where("survey_id = 'd'")).first().split == "train"
    with pytest.raises(ValueError):
        training.survey_splits(rows, 0.9, 0.2)


def test_spherical_constant():
    assert math.isclose(roads.geo.EARTH_RADIUS_M, 6371008.8)
