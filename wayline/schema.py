"""Schemas, fixed values and row-level validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: On-the-wire values, fixed.
ENUMS = {
    "damage_class": ("longitudinal_crack", "transverse_crack", "alligator_crack", "pothole"),
    "severity": ("unassessed", "low", "medium", "high"),
    "severity_source": ("ai", "human", "geometric_estimate", "other"),
    "status": ("probable", "verified", "rejected", "repaired", "reopened"),
    "location_method": ("phone_gps", "interpolated_phone_gps", "road_segment_matched", "ground_projected", "manual_correction"),
    "frame_quality": ("accepted", "degraded", "rejected"),
    "sampling_mode": ("fixed_fps", "fixed_interval", "distance"),
    "region_kind": ("person", "vehicle"),
    "redaction_method": ("mosaic", "solid"),
}

_POINT = "struct<lat: double, lon: double, method: string, uncertainty_m: double, altitude_m: double>"
SCHEMAS = {
    "fixes": "survey_id string, t_epoch_ms long, lat double, lon double, accuracy_m double, speed_mps double, heading_deg double, altitude_m double",
    "surveys": "survey_id string, schema_version int, started_at timestamp, ended_at timestamp, recording_start_epoch_ms long, video_path string, device map<string,string>, app_version string, notes string",
    "frames": f"frame_id string, survey_id string, video_time_s double, t_epoch_ms long, width int, height int, image_path string, observation_location {_POINT}, speed_mps double, heading_deg double, quality string, quality_scores map<string,double>",
    "detections": "detection_id string, frame_id string, survey_id string, damage_class string, confidence double, x1 double, y1 double, x2 double, y2 double, model_id string, track_id string",
    "tracks": "track_id string, survey_id string, damage_class string, detection_ids array<string>, first_frame_id string, last_frame_id string, first_t long, last_t long, max_confidence double, mean_confidence double",
    "defect_observations": f"observation_id string, defect_id string, survey_id string, track_id string, detection_ids array<string>, observed_at timestamp, confidence double, location {_POINT}, representative_frame_id string",
    "defects": f"defect_id string, damage_class string, location {_POINT}, road struct<source: string, segment_id: string, name: string, match_distance_m: double, heading_delta_deg: double>, confidence double, severity string, severity_source string, status string, trend string, observation_count long, survey_ids array<string>, first_seen timestamp, last_seen timestamp, representative_frame_id string, representative_image_path string, model_id string, processing_run_id string, created_at timestamp, updated_at timestamp",
    "reviews": "review_id string, defect_id string, action string, reviewer string, reviewed_at timestamp, previous_value string, new_value string, note string",
    "model_versions": "model_id string, architecture string, training_dataset_ids array<string>, training_data_licenses array<string>, distribution_allowed boolean, classes array<string>, input_resolution int, metrics map<string,double>, created_at timestamp",
    "processing_runs": "run_id string, survey_id string, started_at timestamp, duration_s double, config map<string,string>, frames_decoded long, frames_sampled long, frames_rejected long, detections long, detections_outside_road long, tracks long, defects long, errors array<string>, warnings array<string>",
    "dataset_versions": "dataset_id string, name string, license string, image_count long, annotation_count long, class_map map<string,string>, split_routes map<string,array<string>>, content_hash string",
    "road_segments": "segment_id string, way_id string, seg_ord long, a_lat double, a_lon double, b_lat double, b_lon double, name string, highway string, oneway boolean",
    "annotations": "image_id string, file_name string, width int, height int, country string, image_index long, boxes array<struct<rdd_code: string, xmin: int, ymin: int, xmax: int, ymax: int>>",
}


def _in(c: str, lo: float, hi: float) -> Column:
    return F.col(c).isNull() | (F.col(c).between(lo, hi) & ~F.isnan(F.col(c).cast("double")))


def rules(entity: str) -> list[tuple[str, Column]]:
    """(rule, what must hold) of an entity."""
    point = [("lat_range", _in("lat", -90, 90)), ("lon_range", _in("lon", -180, 180)), ("uncertainty_negative", _in("uncertainty_m", 0, float("inf")))]
    return {
        "cluster_candidates": [*point, ("confidence_range", _in("confidence", 0, 1))],
        "detections": [("degenerate_box", (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))), ("negative_box", (F.col("x1") >= 0) & (F.col("y1") >= 0)), ("confidence_range", _in("confidence", 0, 1))],
        "surveys": [("ends_before_start", F.col("ended_at").isNull() | (F.col("ended_at") >= F.col("started_at"))), ("unsafe_id", F.col("survey_id").rlike(r"^[A-Za-z0-9._-]+$"))],
        "frames": [("negative_time", F.col("video_time_s") >= 0), ("lat_range", _in("obs_lat", -90, 90)), ("lon_range", _in("obs_lon", -180, 180)), ("unknown_quality", F.col("quality").isin(*ENUMS["frame_quality"]))],
        "defects": [
            ("severity_without_source", (F.col("severity") == "unassessed") | (F.col("severity_source") != "other")), ("last_before_first", F.col("last_seen") >= F.col("first_seen")), ("confidence_range", _in("confidence", 0, 1)), ("observation_count", F.col("observation_count") >= 0),
            *[(f"unknown_{c}", F.col(c).isin(*ENUMS[c])) for c in ("damage_class", "severity", "severity_source", "status")],
        ],
        "model_versions": [("distribution_without_licenses", ~F.col("distribution_allowed") | (F.size("training_data_licenses") > 0))],
        "reviews": [("incomplete", F.col("review_id").isNotNull() & F.col("defect_id").isNotNull() & F.col("reviewed_at").isNotNull())],
        "road_refs": [("match_distance_negative", _in("match_distance_m", 0, float("inf"))), ("heading_delta_range", _in("heading_delta_deg", 0, 180))],
        "regions": [("inverted", (F.col("x2") >= F.col("x1")) & (F.col("y2") >= F.col("y1"))), ("confidence_range", _in("confidence", 0, 1)), ("unknown_kind", F.col("kind").isin(*ENUMS["region_kind"]))],
        "location_records": [("lat_range", _in("lat", -90, 90)), ("lon_range", _in("lon", -180, 180)), ("t_missing", F.col("t").isNotNull())],
    }[entity]


def validate(df: DataFrame, entity: str) -> DataFrame:
    """df with `violations`, the names of all rules a row breaks (a rule on a null counts as broken unless it allows it)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules(entity)]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def unknown_columns(df: DataFrame, entity: str) -> list[str]:
    """Columns that the entity doesn't have; any is an error to a strict reader."""
    from pyspark.sql.types import StructType

    known = set(StructType.fromDDL(SCHEMAS[entity]).fieldNames())
    return [c for c in df.columns if c not in known]


def check_road_region(horizon: float = 0.45, bonnet: float = 0.05, near: tuple[float, float] = (0.0, 1.0), far: tuple[float, float] = (0.35, 0.65)) -> None:
    """Fractions in order, and a band between horizon and bonnet."""
    if not all(0.0 <= x <= 1.0 for x in (horizon, bonnet, *near, *far)) or near[0] >= near[1] or far[0] >= far[1] or horizon >= 1.0 - bonnet:
        raise ValueError("the road region is empty or not in order")


def check_redaction(blocks_across: int = 4, min_block_px: int = 8, margin: float = 0.15) -> None:
    if blocks_across < 1 or min_block_px < 2 or margin < 0:
        raise ValueError("redaction needs a block across, blocks of two pixels and a margin of 0 or more")
