import json
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline import schema
from wayline.functions import misc
from wayline.operators import detect, pixels, roads, rollup, store, track
from wayline.plans import demo
from wayline.plans.process import PipelineConfig, evidence_boxes, persist, process, run_json
from wayline.sources import archive, bundle, frames, osm
from wayline.streaming import tracks


def test_frame_sources(spark, tmp_path):
    plan = spark.createDataFrame([("s", t) for t in (0.0, 0.4, 1.2, 9.0)], "survey_id string, video_time_s double")
    long = spark.createDataFrame([("s", 2.0)], "survey_id string, duration_s double")
    assert {r.frame_id for r in frames.synthetic_frames(plan, long).collect()} == {"s:f0.000", "s:f0.400", "s:f1.200"}
    for name in ("s/frames/a.jpg", "s/frames/b.PNG", "s/frames/c.jpeg", "s/frames/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    images = frames.image_times(frames.list_images(spark, str(tmp_path)), long)
    assert {r.frame_id: r.video_time_s for r in images.collect()} == {"s:a": 0.0, "s:b": 1.0, "s:c": 2.0}
    got = {r.target_s: r.frame_id for r in frames.image_sequence(images, plan).collect()}
    assert got == {0.0: "s:a", 0.4: "s:b", 1.2: "s:c"}
    src = spark.createDataFrame([("a", True, True, True), ("b", True, True, False), ("c", True, False, False)], "survey_id string, has_video boolean, has_frames boolean, has_decoder boolean")
    assert {r.survey_id: r.source for r in frames.frame_source(src).collect()} == {"a": "video", "b": "frames", "c": "none"}
    with pytest.raises(RuntimeError):
        frames.video_frames()


def test_archives_are_read_by_their_directory(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED) as z:
            for i in range(20):
                z.writestr(f"train/xml/{k}_{i}.xml", f"<a>{k}{i}</a>" * 50)
                z.writestr(f"train/img/{k}_{i}.jpg", b"\0" * 100)
    e = archive.list_entries(spark, [str(tmp_path / f"{k}.zip") for k in range(2)], "train/xml/", (".XML",))
    assert e.count() == 40
    got = {r.name: (r.content, r.error) for r in archive.read_entries(e, 3).collect()}
    assert got["train/xml/1_7.xml"] == (b"<a>17</a>" * 50, None) and len(got) == 40
    odd = e.limit(1).withColumn("name", F.lit("nowhere"))
    assert archive.read_entries(odd).first().error


def test_bundle_files_and_contract(spark, tmp_path):
    root = tmp_path / "bundles"
    a = bundle.write_skeleton(str(root), "sv-1", "2026-08-18T10:42:11Z", 5, [{"t": 1, "lat": 1, "lon": 1}])
    open(f"{a}/notes.txt", "w").write("x")
    open(f"{a}/locations.jsonl", "ab").write(b'{"t": 2, "lat": 1, "lon": "\xff"}\n')
    b = bundle.write_skeleton(str(root), "sv-2", "2026-08-18T10:42:11Z", 5, [])
    __import__("os").remove(f"{b}/locations.jsonl")
    got = {(r.survey_id, r.severity, r.message) for r in bundle.file_issues(spark, str(root)).collect()}
    assert got == {("sv-1", "warning", "unknown file notes.txt"), ("sv-1", "error", "locations.jsonl isn't UTF-8"), ("sv-2", "error", "locations.jsonl is missing")}
    assert bundle.build_manifest(False)["files"] == ["route.json", "locations.jsonl", "device.json"] and "ended_at" not in bundle.build_route("r", "a", 1, "1")
    fixes = spark.createDataFrame([(1.6, 1.0, 2.0, -1.0, 0.0, None)], "t double, lat double, lon double, accuracy_m double, speed_mps double, heading_deg double")
    for _ in range(2):
        bundle.append_locations(fixes, str(tmp_path / "log"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()] == [{"t": 2, "lat": 1.0, "lon": 2.0, "speed_mps": 0.0}] * 2
    one = spark.range(1).select(misc.describe_storage(F.lit(120 * 1024 * 1024 * 9 + 5)).alias("few"), misc.survey_id_of(F.lit(datetime(2024, 1, 2)), F.lit("ab")).alias("ok"), misc.survey_id_of(F.lit(datetime(2024, 1, 2)), F.lit("a/b")).alias("bad")).first()
    assert (one.few.minutes, one.few.ok, one.ok, one.bad) == (9, False, "survey_2024-01-02T00-00-00-000Z_ab", None)


def test_networks(spark, tmp_path):
    seg = demo.demo_roads(spark)
    osm.save_network_json(seg, str(tmp_path / "net"))
    assert osm.load_network_json(spark, str(tmp_path / "net")).exceptAll(seg.select(*osm.load_network_json(spark, str(tmp_path / "net")).columns)).count() == 0
    s, w, n, e = osm.bbox_around(40.0, 44.0, 1000.0)
    assert s < 39.992 and n > 40.008 and e - w > n - s
    d = spark.createDataFrame([("a", demo.START[0], demo.START[1], 5.0, "interpolated_phone_gps"), ("b", demo.START[0], demo.START[1], 5.0, "manual_correction"), ("c", 0.5, 0.5, 5.0, "interpolated_phone_gps")], "defect_id string, lat double, lon double, uncertainty_m double, location_method string")
    m = roads.match_defects(d, seg)
    assert {r.defect_id: (r.match_reason, r.way_id, r.location_method) for r in m.collect()} == {"a": ("matched", "way/1", "road_segment_matched"), "b": ("skipped_manual", None, "manual_correction"), "c": ("no_candidates", None, "interpolated_phone_gps")}
    assert {r.reason: r.n for r in roads.match_counts(m).collect()} == {"matched": 1, "matched_named": 1, "skipped_manual": 1, "no_candidates": 1}


def test_the_whole_way_with_sampling_and_streets(spark, tmp_path):
    fixes = demo.demo_drive(spark)
    n = fixes.count()
    assert n > 280 and 1800 < track.track_distance(track.clean_track(fixes)).first().distance_m < 3000
    f = spark.range(0, n * 4).select(F.format_string("f%05d", "id").alias("frame_id"), F.lit("demo").alias("survey_id"), (F.lit(demo.T0) + F.col("id") * 250).alias("t_epoch_ms"), (F.col("id") / 4).alias("video_time_s"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.when(F.col("id") % 9 == 0, "rejected").otherwise("accepted").alias("quality"))
    det = detect.fake_detector(f.where("quality <> 'rejected'")).withColumn("detection_id", F.concat(F.lit("x"), "frame_id"))
    surveys = spark.createDataFrame([("demo", demo.T0, datetime(2026, 8, 18), None)], "survey_id string, recording_start_epoch_ms long, started_at timestamp, ended_at timestamp")
    out = process(fixes, f, det, PipelineConfig(), surveys, demo.demo_roads(spark))
    run = out["run"].first()
    assert run.n_decoded == n * 4 and 0 < run.n_sampled < run.n_decoded and run.n_detections > 0 and json.loads(run.config)["min_confidence"] == 0.25
    note = out["sampling_notes"].first()
    assert note.n_stationary > 50 and any("stood still" in x for x in note.notes)
    streets = {r.way_id: r for r in out["streets"].collect()}
    assert streets["way/1"].surveyed_m > 300 and "way/9" not in streets and out["per_km"].first().per_km > 0
    ids = [r.defect_id for r in out["matched"].orderBy("first_seen", "cluster_id").collect()]
    assert ids == [f"def_{i + 1:05d}" for i in range(len(ids))] and len(ids) > 3
    assert json.loads(run_json(out["run"]).first().value)["survey_id"] == "demo"
    persist({"defects": out["defects"]}, str(tmp_path))
    assert store.read_table(spark, str(tmp_path / "defects")).count() == len(ids)
    boxes = evidence_boxes(out, det, f)
    assert boxes.count() == len(ids) and boxes.where("crop_x2 > crop_x1").count() == len(ids)
    text = rollup.report_text(out["streets"], rollup.network_totals(out["streets"], out["coverage"], demo.demo_roads(spark)))
    assert "km driven" in text and json.loads(rollup.report_json(out["streets"]).first().value)["way_id"]


def test_short_limits_are_noted(spark):
    fixes = track.clean_track(demo.demo_drive(spark))
    s = spark.createDataFrame([("demo", demo.T0, 20.0), ("none", demo.T0, 3.0)], "survey_id string, recording_start_epoch_ms long, duration_s double")
    c = track.SamplingConfig(max_frames=5)
    got = {r.survey_id: r for r in track.sampling_notes(s, fixes, track.sampling_plan(s, fixes, c), c).collect()}
    assert got["demo"].n_planned == 5 and "cut off at 5 frames" in got["demo"].notes and got["none"].mode == "fixed_fps"


def test_model_output_and_regions(spark):
    o = spark.createDataFrame([("f", [[0.0, 0.0, 5.0, 5.0], [1.0, 1.0, 1.0, 9.0], [0.0, 0.0, 2.0, 2.0], [0.0, 0.0, 3.0, 3.0]], [4, 1, 9, 2], [0.9, 0.9, 0.9, 0.1])], "frame_id string, boxes array<array<double>>, labels array<int>, scores array<double>")
    assert [(r.damage_class, r.x2) for r in detect.boxes_of_model(o).collect()] == [("pothole", 5.0)]
    c = spark.createDataFrame([("i", "train", 0.9, 0.0, 0.0, 5.0, 5.0), ("i", "cat", 0.9, 0.0, 0.0, 5.0, 5.0), ("i", "person", 0.1, 0.0, 0.0, 5.0, 5.0)], "image_id string, label string, score double, x1 double, y1 double, x2 double, y2 double")
    assert [(r.kind, r.confidence) for r in detect.coco_regions(c).collect()] == [("vehicle", 0.9)]
    img = np.arange(30 * 40 * 3, dtype=np.uint8).reshape(30, 40, 3)
    im = spark.createDataFrame([("i", img.tobytes(), 30, 40, 3)], "image_id string, data binary, height int, width int, channels int")
    r = spark.createDataFrame([("i", "person", 1.0, 10.0, 10.0, 20.0, 20.0)], detect.REGION)
    assert detect.scripted_regions(im, r).count() == 1 and detect.null_regions(im).count() == 0
    b = spark.createDataFrame([("d", "i", 12.0, 12.0, 30.0, 25.0, 8, 8, 36, 28)], "defect_id string, image_id string, x1 double, y1 double, x2 double, y2 double, crop_x1 long, crop_y1 long, crop_x2 long, crop_y2 long")
    e = {x.kind: np.frombuffer(x.data, np.uint8).reshape(x.height, x.width, 3) for x in pixels.evidence(im, b, r.select("image_id", "x1", "y1", "x2", "y2")).collect()}
    assert e["frame"].shape == (30, 40, 3) and e["crop"].shape == (20, 28, 3) and (e["crop"] == e["frame"][8:28, 8:36]).all() and (e["frame"][12:18, 12:18] != img[12:18, 12:18]).any() and (e["context"][12, 15] == (220, 30, 30)).all()

    def broken():
        raise ValueError("no model")

    with pytest.raises(Exception, match="no model"):
        detect.find_regions(im, broken).collect()


def test_more_rules(spark):
    d = spark.createDataFrame([("low", "other", "probable", "pothole", 0.5, 1, 2, 1), ("low", "human", "probable", "pothole", 0.5, 1, 2, 3)], "severity string, severity_source string, status string, damage_class string, confidence double, observation_count int, first int, last int").withColumns({"first_seen": F.timestamp_seconds("first"), "last_seen": F.timestamp_seconds("last")})
    assert [r.violations for r in schema.validate(d, "defects").collect()] == [["severity_without_source", "last_before_first"], []]
    m = spark.createDataFrame([(True, []), (False, [])], "distribution_allowed boolean, training_data_licenses array<string>")
    assert [r.violations for r in schema.validate(m, "model_versions").collect()] == [["distribution_without_licenses"], []]
    for bad in (lambda: schema.check_road_region(horizon=0.96), lambda: schema.check_road_region(far=(0.7, 0.6)), lambda: schema.check_redaction(min_block_px=1)):
        with pytest.raises(ValueError):
            bad()
    schema.check_road_region()
    schema.check_redaction()


def test_ordered_streams(spark, tmp_path):
    kind = "survey_id string, record_id string, seq long, ts timestamp, lat double, lon double, speed_mps double, accuracy_m double"
    order = [0, 2, 1, 3, 4, 6, 5, 7, 8, 9]
    rows = [("s", f"r{k}", k, datetime(2024, 1, 1, 0, 0, i), 0.0, 0.00002 * i + (0.01 if i > 6 else 0.0), 5.0 if i != 3 else 0.0, float(i)) for k, i in enumerate(order)]
    rows += [("s", "z", 99, datetime(2024, 1, 1, 0, 0, 4), 0.0, 0.5, 5.0, 1.0), ("s", "end", 100, datetime(2024, 1, 1, 1, 0, 0), 0.0, 0.0, 5.0, 1.0), ("s", "end2", 101, datetime(2024, 1, 1, 2, 0, 0), 0.0, 0.0, 5.0, 1.0)]
    for k, part in enumerate((rows[:10], rows[11:12], rows[12:])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        __import__("time").sleep(1.1)
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "all"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
        return [r for r in spark.table(name).collect() if r[1] < 1_704_067_260_000] if mode == "append" and name != "best" else spark.table(name).collect()

    live = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(tracks.ordered_fixes(live(), late="1 minute"), "ordered")
    assert [round(r.lon / 0.00002) % 500 for r in got] == list(range(10)) and sum(r.reordered for r in got) == 2
    p = run(tracks.distance_pieces(live(), late="1 minute"), "pieces")
    assert {r.piece for r in p} == {0, 1} and sum(r.metres for r in p) == pytest.approx(8 * 2.2239, abs=0.01)
    s = run(tracks.spaced(live(), late="1 minute"), "spaced_out")
    assert s[0].metres is None and all(r.metres >= 2.5 for r in s[1:]) and len(s) == 6
    every = spark.readStream.schema(kind).parquet(str(tmp_path / "all"))
    best = {r.ts: r.record_id for r in run(tracks.most_accurate(every), "best", "update")}
    assert best[datetime(2024, 1, 1, 0, 0, 4)] == "z" and len(best) == 12
