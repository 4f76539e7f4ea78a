import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wayline.operators import dataset, retention, reviews, rollup
from wayline.sources import export

DEFECT = "defect_id string, status string, damage_class string, severity string, severity_source string, lat double, lon double, location_method string, uncertainty_m double, confidence double, survey_ids array<string>, first_seen timestamp, model_id string, observation_count long, processing_run_id string, representative_frame_id string"
REVIEW = "review_id string, defect_id string, action string, reviewer string, reviewed_at timestamp, damage_class string, severity string, lat double, lon double, note string"
T0 = datetime(2024, 1, 1)


def defects(spark, n=3, **change):
    row = {"status": "probable", "damage_class": "pothole", "severity": "unassessed", "severity_source": "other", "lat": 40.0, "lon": 44.0, "location_method": "interpolated_phone_gps", "uncertainty_m": 5.0, "confidence": 0.5, "survey_ids": ["s"], "first_seen": T0, "model_id": "det", "observation_count": 1, "processing_run_id": "r", "representative_frame_id": "f"} | change
    return spark.createDataFrame([(f"d{i}", *row.values()) for i in range(n)], DEFECT)


def log(spark, *rows):
    full = []
    for k, (defect, action, value) in enumerate(rows):
        v = {"damage_class": None, "severity": None, "lat": None, "lon": None, "note": None} | value
        full.append((f"r{k}", defect, action, "me", T0 + timedelta(days=20 * k), *v.values()))
    return spark.createDataFrame(full, REVIEW)


def test_six_actions_and_what_they_found(spark):
    d = defects(spark)
    r = log(
        spark, ("d0", "approve", {}), ("d0", "change_class", {"damage_class": "alligator_crack"}), ("d0", "change_severity", {"severity": "high"}), ("d0", "add_note", {"note": "wet"}), ("d0", "reject", {}),
        ("d1", "adjust_location", {"lat": 41.0, "lon": 45.0}), ("d1", "change_class", {}), ("d1", "adjust_location", {"lat": 99.0, "lon": 0.0}), ("nobody", "approve", {}), ("d1", "paint", {}),
    )
    good, refused = reviews.split_reviews(d, r.union(r.where("review_id = 'r0'")))
    assert {(x.review_id, x.problem) for x in refused.collect()} == {("r6", "damage_class_required"), ("r7", "location_required"), ("r8", "unknown_defect"), ("r9", "unknown_action"), ("r0", "duplicate_id")}
    s = {x.defect_id: x for x in reviews.apply_reviews(d, good).collect()}
    assert (s["d0"].status, s["d0"].damage_class, s["d0"].severity, s["d0"].severity_source, s["d0"].n_reviews, s["d0"].class_corrected) == ("rejected", "alligator_crack", "high", "human", 5, True)
    assert (s["d1"].status, s["d1"].lat, s["d1"].location_method, s["d1"].uncertainty_m) == ("verified", 41.0, "manual_correction", 2.0)
    assert (s["d2"].status, s["d2"].n_reviews, s["d2"].updated_at) == ("probable", 0, None)
    for bucket in ("day", "year"):
        w = {x.review_id: x for x in reviews.review_log(d, good, bucket).collect()}
        assert (w["r0"].previous.status, w["r1"].previous.status, w["r1"].previous.damage_class, w["r4"].previous.status, w["r4"].new.status) == ("probable", "verified", "pothole", "verified", "rejected")
        assert w["r3"].new.status is None and w["r3"].previous.status is None and w["r2"].previous.severity == "unassessed" and w["r5"].previous.lat == 40.0


def test_lists(spark):
    d = defects(spark, 30).withColumns({"severity": F.when(F.col("defect_id") < "d15", "high").otherwise("low"), "model_id": F.lit("fake-1")})
    assert reviews.list_defects(d, severity="low", limit=10).count() == 10 and reviews.list_defects(d, severity="low", limit=10, severity_after_limit=True).count() < 10
    assert reviews.list_defects(d, survey_id="s").count() == 30 and reviews.list_defects(d, survey_id="_").count() == 0 and reviews.list_defects(d, min_confidence=0.6).count() == 0
    obs = spark.createDataFrame([("d1", f"o{i}", T0 + timedelta(seconds=i), [f"x{i}a", f"x{i}b"]) for i in range(15)], "defect_id string, observation_id string, observed_at timestamp, detection_ids array<string>")
    q = {r.defect_id: r.detection_ids for r in reviews.queue(d, obs).collect()}
    assert q["d1"] == [f"x{i}{c}" for i in range(10) for c in "ab"] and q["d2"] == []
    p = reviews.provenance(d).first()
    assert (p.models, p.synthetic, p.warnings) == (["fake-1"], True, ["synthetic_detector", "none_verified"])
    m = reviews.map_view(d, limit=30)
    assert m["page"].first().truncated and m["totals"].where("dimension = 'severity'").count() == 2
    x = reviews.details(d, obs, log(spark, ("d1", "approve", {})), "d1").first()
    assert len(x.observations) == 15 and x.reviews[0].action == "approve"
    with pytest.raises(ValueError):
        reviews.counts({"secrets": d})
    assert rollup.summarize(d, 2.0).where("dimension = 'total'").first().n_per_km == 15.0


def test_reviewed_dataset(spark, tmp_path):
    status = F.element_at(F.array(*map(F.lit, ["verified", "rejected", "probable", "repaired", "verified", "verified"])), (F.substring("defect_id", 2, 1).cast("int") + 1))
    d = defects(spark, 6).withColumns({"status": status, "damage_class": F.lit("alligator_crack")})
    obs = spark.createDataFrame([("d0", ["a", "b"]), ("d5", ["c"])], "defect_id string, detection_ids array<string>")
    det = spark.createDataFrame([("a", "f", 1.9, 2.0, 30.5, 40.0), ("b", "other", 1.0, 2.0, 3.0, 4.0), ("c", "f", 1.0, 2.0, 3.0, 4.0)], "detection_id string, frame_id string, x1 double, y1 double, x2 double, y2 double")
    images = spark.createDataFrame([(f"d{i}", 100, 80) for i in range(5)], "defect_id string, width int, height int")
    records, outcomes = dataset.reviewed_records(d, obs, det, images, log(spark, ("d0", "change_class", {"damage_class": "alligator_crack"})))
    assert {r.defect_id: r.outcome for r in outcomes.collect()} == {"d0": "positive", "d1": "negative", "d2": "unreviewed", "d3": "other_status", "d4": "no_box", "d5": "no_image"}
    r = {x.image_id: x for x in records.collect()}
    assert r["d0"].corrected and [tuple(b) for b in r["d0"].boxes] == [("", "alligator_crack", 1, 2, 30, 40)] and r["d1"].boxes == []
    m = dataset.manifest(records, outcomes).first()
    assert (m.image_count, m.annotation_count, m.negative_image_count, m.skipped_no_box) == (2, 1, 1, 1) and m.warning
    dataset.write_dataset(records, outcomes, str(tmp_path / "set"))
    assert {r.split for r in spark.read.json(str(tmp_path / "set/splits")).collect()} == {"train"}


def test_retention(spark, tmp_path):
    for name in ("a/video.MP4", "a/frames/f1.jpg", "a/frames/new.jpg", "a/evidence/e.jpg", "a/frames.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
        if "new" not in name:
            os.utime(tmp_path / name, (1_600_000_000, 1_600_000_000))
    dry = retention.apply_retention(spark, str(tmp_path))
    assert sorted(e["kind"] for e in dry) == ["frames", "raw_video"] and not any(e["deleted"] for e in dry) and (tmp_path / "a/video.MP4").exists()
    done = retention.apply_retention(spark, str(tmp_path), delete=True)
    assert all(e["deleted"] for e in done) and not (tmp_path / "a/video.MP4").exists() and (tmp_path / "a/frames/new.jpg").exists() and (tmp_path / "a/evidence/e.jpg").exists()
    lines = [json.loads(x) for x in (tmp_path / retention.LOG).read_text().splitlines()]
    assert len(lines) == 2 and all(set(x) == {"deleted_at", "path", "kind", "age_days", "size_bytes"} for x in lines)
    assert retention.apply_retention(spark, str(tmp_path / "nowhere")) == []
    files = spark.createDataFrame([("x/v.mp4", datetime(2024, 1, 1), 7), ("x/w.mp4", datetime(2024, 1, 31), 7)], "path string, modified_at timestamp, size_bytes long")
    assert [tuple(r) for r in retention.totals(retention.find_expired(files, datetime(2024, 1, 31, tzinfo=timezone.utc))).collect()] == [("raw_video", 1, 7)]


def test_redaction_totals(spark):
    images = spark.createDataFrame([("a",), ("b",)], "image_id string")
    regions = spark.createDataFrame([("a", "person"), ("a", "vehicle"), ("a", "person")], "image_id string, kind string")
    t = retention.summarize_reports(retention.redaction_reports(images, regions, "scripted-1")).first()
    assert (t.n_images, t.n_images_with_regions, t.n_regions, t.n_persons, t.n_vehicles, t.detectors) == (2, 1, 3, 2, 1, ["scripted-1"])


def test_export_columns_and_sidecar(spark, tmp_path):
    d = defects(spark, 1)
    rows = export.csv_rows(d)
    assert rows.columns == list(export.COLUMNS) and len(export.COLUMNS) == 22
    r = rows.first()
    assert (r.latitude, r.road_name, r.trend, r.survey_ids, r.first_seen) == (40.0, "", "unknown", "s", "2024-01-01T00:00:00.000000Z")
    export.write_csv(d, str(tmp_path / "c"), ["owed"])
    assert (tmp_path / "c/ATTRIBUTION.txt").read_text() == "owed\n"
    export.write_csv(d, str(tmp_path / "c"))
    assert not (tmp_path / "c/ATTRIBUTION.txt").exists()
    doc = json.loads(export.feature_collection(d, ["owed"]))
    assert doc["header"] == {"schema_version": 1, "feature_count": 1, "attribution": ["owed"]}
