"""Surveys end to end: fixes and detections in, defects by street out, for any number of surveys in one plan."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators import store
from wayline.operators.chunks import numbered
from wayline.operators.clustering import ClusteringConfig, cluster, defects_of
from wayline.operators.detect import keep_detections
from wayline.operators.roads import MatchingConfig, match_counts, match_defects
from wayline.operators.rollup import coverage_by_way, defects_per_km, street_report
from wayline.operators.track import SamplingConfig, TrackConfig, clean_track, durations, locate, sampling_notes, sampling_plan, track_distance, track_stats
from wayline.operators.tracking import TrackingConfig, summarize_tracks, track_detections
from wayline.session import checkpoint
from wayline.sources.export import crop_rectangle


@dataclass(frozen=True)
class PipelineConfig:
    min_confidence: float = 0.25
    analyse_degraded: bool = True
    scope: tuple[str, ...] = ("survey_id",)
    track: TrackConfig = field(default_factory=TrackConfig)
    sampling: SamplingConfig = field(default_factory=SamplingConfig)
    tracking: TrackingConfig = field(default_factory=TrackingConfig)
    clustering: ClusteringConfig = field(default_factory=ClusteringConfig)
    matching: MatchingConfig = field(default_factory=MatchingConfig)

    def as_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)


def observations_of(tracked: DataFrame, located: DataFrame, min_length: int = 1) -> DataFrame:
    """Tracks of min_length detections or more as candidates for clustering: the place of the frame of each track's best
    detection; unpositioned tracks are left out."""
    tracks = summarize_tracks(tracked, ["survey_id", "track_no", "damage_class"], min_length)
    best = tracked.select(F.col("detection_id").alias("best_detection_id"), F.col("frame_id").alias("representative_frame_id"))
    rows = tracks.join(best, "best_detection_id").join(located.select(F.col("frame_id").alias("representative_frame_id"), "lat", "lon", "uncertainty_m"), "representative_frame_id")
    return rows.select(
        F.concat_ws(":", "survey_id", F.format_string("trk%05d", "track_no")).alias("observation_id"), "survey_id", F.timestamp_millis("first_t").alias("observed_at"), "damage_class",
        F.col("max_confidence").alias("confidence"), "lat", "lon", "uncertainty_m", "representative_frame_id", "best_detection_id",
    )


def sampled(plan: DataFrame, frames: DataFrame, tolerance_ms: int = 250) -> DataFrame:
    """The frames of `frames` that are nearest to a time of the plan, within the tolerance; by buckets of it, so that the
    join is one on equal keys."""
    wide = tolerance_ms + 1
    want = plan.select("survey_id", F.col("t_epoch_ms").alias("want"), F.explode(F.array(*[F.floor(F.col("t_epoch_ms") / wide) + k for k in (-1, 0, 1)])).alias("b"))
    near = frames.select("survey_id", "frame_id", F.col("t_epoch_ms").alias("t"), F.floor(F.col("t_epoch_ms") / wide).alias("b")).join(want, ["survey_id", "b"]).where(F.abs(F.col("t") - F.col("want")) <= tolerance_ms)
    chosen = near.groupBy("survey_id", "want").agg(F.min_by("frame_id", F.struct(F.abs(F.col("t") - F.col("want")), "t", "frame_id")).alias("frame_id")).select("frame_id").distinct()
    return frames.join(chosen, "frame_id", "left_semi")


def with_ids(defects: DataFrame) -> DataFrame:
    """defects with defect_id: def_00001 and on, in the order of (first_seen, cluster_id)."""
    return numbered(defects, ["first_seen", "cluster_id"], "_n").withColumn("defect_id", F.format_string("def_%05d", F.col("_n") + 1)).drop("_n")


def process(fixes: DataFrame, frames: DataFrame, detections: DataFrame, config: PipelineConfig = PipelineConfig(), surveys: DataFrame | None = None, segments: DataFrame | None = None) -> dict[str, DataFrame]:
    """fixes (location_records), frames (frame_id, survey_id, t_epoch_ms, width, height, quality) and raw detections to
    track, stats, located frames, tracked detections, observations, defects and a run row for each survey.

    With `surveys` frames are sampled first by config.sampling, and the plan and its notes are given; with `segments`
    defects are matched to streets, and the street report is given. Nothing runs before an action but the rounds that
    find clusters and the numbering of defects.
    """
    c = config
    track = clean_track(fixes, config=c.track)
    out: dict[str, DataFrame] = {"track": track, "stats": track_stats(fixes, config=c.track), "distance": track_distance(track)}
    chosen = frames
    if surveys is not None:
        lasting = durations(surveys, fixes, frames, c.track)
        out["plan"] = sampling_plan(lasting, track, c.sampling)
        out["sampling_notes"] = sampling_notes(lasting, track, out["plan"], c.sampling)
        chosen = sampled(out["plan"], frames)
    usable = chosen.where((F.col("quality") == "accepted") | (F.lit(c.analyse_degraded) & (F.col("quality") == "degraded")))
    at = locate(track, usable.select("frame_id", "survey_id", F.col("t_epoch_ms").alias("t")), "frame_id", c.track)
    judged = keep_detections(detections.join(usable.select("frame_id", "survey_id", "width", "height"), "frame_id"), c.min_confidence)
    kept = judged.where("reason is null").drop("reason", "width", "height", "survey_id")
    tracked = track_detections(usable, kept, c.tracking)
    seen = observations_of(tracked, at, c.tracking.min_length)
    clustered = cluster(seen, c.clustering, list(c.scope))
    defects = defects_of(clustered, c.clustering)
    out |= {"located": at, "tracked": tracked, "observations": seen, "clustered": clustered, "defects": defects}
    reasons = judged.groupBy("survey_id").agg(F.count("*").alias("n_detections"), F.count_if(F.col("reason") == "outside_road").alias("n_outside_road"), F.count_if(F.col("reason") == "low_confidence").alias("n_low_confidence"))
    decoded = frames.groupBy("survey_id").agg(F.count("*").alias("n_decoded"), F.count_if(F.col("quality") == "rejected").alias("n_rejected"))
    sampled_n = chosen.groupBy("survey_id").agg(F.count("*").alias("n_sampled"))
    observed = seen.groupBy("survey_id").agg(F.count("*").alias("n_observations"))
    run = decoded
    for part in (sampled_n, reasons, observed):
        run = run.join(part, "survey_id", "left")
    out["run"] = run.na.fill(0).join(out["distance"].select("survey_id", "distance_m"), "survey_id", "left").withColumn("config", F.lit(c.as_json()))
    if segments is not None:
        named = with_ids(defects).withColumns({"location_method": F.lit("interpolated_phone_gps"), "status": F.lit("probable"), "survey_id": F.get("survey_ids", 0)})
        matched = match_defects(named, segments, config=c.matching)
        driven = at.join(usable.select("frame_id", "t_epoch_ms", "video_time_s"), "frame_id").select("frame_id", "survey_id", "t_epoch_ms", "video_time_s", "lat", "lon", "uncertainty_m", "heading_deg")
        cover = checkpoint(coverage_by_way(driven, segments, c.matching))
        out |= {"matched": matched, "match_counts": match_counts(matched), "coverage": cover, "streets": street_report(matched, cover, segments)}
        out["per_km"] = defects_per_km(named, out["distance"])
    return out


def run_json(run: DataFrame) -> DataFrame:
    """(survey_id, value): each survey's run as JSON."""
    return run.select("survey_id", F.to_json(F.struct(*run.columns)).alias("value"))


def persist(out: dict[str, DataFrame], folder: str) -> None:
    """The results as tables below folder; each replaces its last version by one rename."""
    for name, df in out.items():
        store.replace_table(df, f"{folder.rstrip('/')}/{name}")


def evidence_boxes(out: dict[str, DataFrame], detections: DataFrame, frames: DataFrame) -> DataFrame:
    """(defect_id, image_id, x1..y2, crop_x1..crop_y2) of a second pass over images: the best box of each defect's own
    track on its representative frame, with the crop around it."""
    first = out["clustered"].select("cluster_id", "representative_frame_id", "best_detection_id")
    mine = with_ids(out["defects"]).select("defect_id", "cluster_id", "representative_frame_id").join(first, ["cluster_id", "representative_frame_id"])
    one = mine.groupBy("defect_id").agg(F.min(F.struct("representative_frame_id", "best_detection_id")).alias("m")).select("defect_id", F.col("m.representative_frame_id").alias("image_id"), F.col("m.best_detection_id").alias("detection_id"))
    boxes = one.join(detections.select("detection_id", "x1", "y1", "x2", "y2"), "detection_id").join(frames.select(F.col("frame_id").alias("image_id"), "width", "height"), "image_id")
    return crop_rectangle(boxes).drop("width", "height", "detection_id")
