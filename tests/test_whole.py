"""Queries keep every row that tells where it belongs."""

from pyspark.sql import functions as F

from wayline.operators import training
from wayline.plans import survey


def annotations(spark, folder, rows):
    box = "array<struct<rdd_code: string, xmin: int, ymin: int, xmax: int, ymax: int>>"
    spark.createDataFrame(rows, f"image_id string, country string, image_index long, boxes {box}").write.parquet(f"{folder}/annotations.parquet")
    return str(folder)


def test_manifest_counts_every_image(spark, tmp_path):
    one = [("D40", 0, 0, 5, 5)]
    rows = [("Norvia_001", "Norvia", 1, one), ("Norvia_001", "Norvia", 1, one), ("Norvia_002", None, 2, one), ("Norvia_003", " NORVIA\t", 3, []), ("norvia_4", "norvia", None, one * 2), ("Quorra_1-copy", None, None, []), ("odd", None, None, one)]
    got = {r.country: (r.n_images, r.n_negative, r.n_boxes) for r in survey.split_manifest(spark, annotations(spark, tmp_path, rows)).collect()}
    assert got == {"Norvia": (4, 1, 4), "Quorra": (1, 1, 0), "unknown": (1, 0, 1)}


def test_recordings_that_were_never_closed_are_sampled(spark, tmp_path):
    t0, d = 1_787_049_731_000, str(tmp_path)
    rows = [("closed", t0, 0, 10), ("fixes", t0, 0, None), ("frames", t0, 0, None), ("early", t0 + 99_000, 0, None), ("nothing", t0, 0, None)]
    s = spark.createDataFrame(rows, "survey_id string, recording_start_epoch_ms long, a long, b long")
    s.select("survey_id", "recording_start_epoch_ms", F.timestamp_seconds("a").alias("started_at"), F.timestamp_seconds("b").alias("ended_at")).write.parquet(f"{d}/surveys.parquet")
    fixes = [(f"{k}{i}", k, t0 + i * 1000, 40.0, 44.0 + i * 0.000118, 5.0, 10.0, 90.0) for k in ("closed", "fixes", "early") for i in range(21)]
    fixes += [("poor", "fixes", t0 + 60_000, 40.0, 44.0, 99.0, None, None), ("poor2", "frames", t0 + 60_000, None, 44.0, 5.0, None, None)]
    spark.createDataFrame(fixes, "record_id string, survey_id string, t long, lat double, lon double, accuracy_m double, speed_mps double, heading_deg double").write.parquet(f"{d}/location_records.parquet")
    frames = [("f1", "fixes", t0 + 90_000), ("f2", "frames", t0 + 5000), ("f3", "frames", t0 + 4000)]
    spark.createDataFrame(frames, "frame_id string, survey_id string, t_epoch_ms long").write.parquet(f"{d}/frames.parquet")
    even = {r.survey_id: r["count"] for r in survey.sample_fixed_interval(spark, d).groupBy("survey_id").count().collect()}
    assert even == {"closed": 21, "fixes": 41, "frames": 11, "early": 1}
    spaced = {r.survey_id: (r.n, r.last) for r in survey.sample_by_distance(spark, d).groupBy("survey_id").agg(F.count("*").alias("n"), F.max("t_epoch_ms").alias("last")).collect()}
    assert set(spaced) == set(even) and spaced["closed"][1] == t0 + 10_000 and spaced["fixes"][1] == t0 + 20_000


def test_contiguous_splits_keep_every_image_in_its_country(spark, tmp_path):
    rows = [(f"Norvia_{i:03d}", ("Norvia", " NORVIA", None)[i % 3], None if i % 5 == 0 else i, []) for i in range(25)] + [("odd", None, None, [])]
    got = {r.image_id: (r.country, r.split) for r in survey.split_contiguous(spark, annotations(spark, tmp_path, rows)).collect()}
    assert got == {f"Norvia_{i:03d}": ("Norvia", "train" if i < 17 else "val" if i < 21 else "test") for i in range(25)} | {"odd": ("unknown", "test")}


def test_validation_ends_where_train_and_validation_do(spark):
    for n, end in ((5, 4), (25, 21), (319, 271)):
        f = spark.range(n).select(F.format_string("s%03d", "id").alias("survey_id"))
        assert training.survey_splits(f).where("split <> 'test'").count() == end


def test_labels_of_one_class_share_tracks_and_defects(spark, tmp_path):
    d, t0 = str(tmp_path), 1_787_049_731_000
    labels = ["pothole", "Pothole", "pothole ", "D40", "d40", "POTHOLE\t"]
    frames = [(f"f{i}", "s", t0 + i * 500, 1920, 1080, "accepted") for i in range(len(labels))]
    spark.createDataFrame(frames, "frame_id string, survey_id string, t_epoch_ms long, width int, height int, quality string").write.parquet(f"{d}/frames.parquet")
    boxes = [(f"d{i}", f"f{i}", c, 0.9, 900.0, 700.0, 1000.0, 800.0) for i, c in enumerate(labels)]
    spark.createDataFrame(boxes, "detection_id string, frame_id string, damage_class string, confidence double, x1 double, y1 double, x2 double, y2 double").write.parquet(f"{d}/detections.parquet")
    fixes = [(f"r{i}", "s", t0 + i * 1000, 40.0, 44.0, 5.0, 0.0, 90.0) for i in range(5)]
    spark.createDataFrame(fixes, "record_id string, survey_id string, t long, lat double, lon double, accuracy_m double, speed_mps double, heading_deg double").write.parquet(f"{d}/location_records.parquet")
    assert {r.track_no for r in survey.tracking_greedy(spark, d).collect()} == {1}
    assert [(r.damage_class, r.observation_count) for r in survey.process_defects(spark, d).collect()] == [("pothole", 1)]
