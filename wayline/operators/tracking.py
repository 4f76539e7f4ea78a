"""Greedy tracking of boxes over frames, and what tracks become."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TrackingConfig:
    min_iou: float = 0.15
    max_gap_s: float = 2.0
    max_missed: int = 2
    min_length: int = 1
    same_class: bool = True


def box_iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


class Tracker:
    """Open tracks of one survey; frames come in order of time. Plain state, so that streams can hold it too."""

    def __init__(self, config: TrackingConfig = TrackingConfig(), state: dict | None = None):
        self.c = config
        self.n, self.open = (state["n"], state["open"]) if state else (0, [])

    def state(self) -> dict:
        return {"n": self.n, "open": self.open}

    def frame(self, t: int, boxes: list[tuple]) -> list[int]:
        """boxes: (class, x1, y1, x2, y2). The track number of each; an empty frame ages the open tracks."""
        c = self.c
        live = [tr for tr in self.open if (t - tr["t"]) / 1000.0 <= c.max_gap_s]
        pairs = sorted(
            ((-v, i, j) for i, tr in enumerate(live) for j, b in enumerate(boxes) if (not c.same_class or b[0] == tr["cls"]) and (v := box_iou(tr["box"], b[1:])) >= c.min_iou),
            key=lambda p: p[0],
        )
        by_track: dict[int, int] = {}
        by_box: dict[int, int] = {}
        for _, i, j in pairs:
            if i not in by_track and j not in by_box:
                by_track[i], by_box[j] = j, i
        for i, tr in enumerate(live):
            if i in by_track:
                tr.update(box=tuple(boxes[by_track[i]][1:]), t=t, missed=0)
            else:
                tr["missed"] += 1
        out = [live[by_box[j]]["no"] if j in by_box else 0 for j in range(len(boxes))]
        self.open = [tr for tr in live if tr["missed"] <= c.max_missed]
        for j, b in enumerate(boxes):
            if j not in by_box:
                self.n += 1
                out[j] = self.n
                self.open.append({"no": self.n, "cls": b[0], "box": tuple(b[1:]), "t": t, "missed": 0})
        return out


def track_detections(frames: DataFrame, detections: DataFrame, config: TrackingConfig = TrackingConfig()) -> DataFrame:
    """(detection_id, survey_id, frame_id, t_epoch_ms, damage_class, confidence, track_no): every detection with the
    number of its track in its survey.

    `frames` are the accepted ones (survey_id, frame_id, t_epoch_ms); those without detections age tracks. Order within
    a frame is that of detection_id. Survey by survey: each streams through one task in order of time and holds its open
    tracks only.
    """
    boxes = detections.select("frame_id", "detection_id", "damage_class", "confidence", "x1", "y1", "x2", "y2")
    rows = frames.select("survey_id", "frame_id", "t_epoch_ms").join(boxes, "frame_id", "left").repartition("survey_id").sortWithinPartitions("survey_id", "t_epoch_ms", "frame_id", "detection_id")
    schema = "detection_id string, survey_id string, frame_id string, t_epoch_ms long, damage_class string, confidence double, track_no long"

    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        survey, frame, t, tracker = None, None, 0, None
        held: list[tuple] = []  # (detection_id, class, confidence, box) of the frame

        def step() -> list[tuple]:
            if frame is None:
                return []
            nos = tracker.frame(t, [(c, *box) for _, c, _, box in held])
            return [(i, survey, frame, t, c, conf, n) for (i, c, conf, _), n in zip(held, nos)]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            out = []
            for s, f, at, i, c, conf, *box in zip(*(col.to_pylist() for col in batch.columns)):
                if (s, f) != (survey, frame):
                    out += step()
                    held = []
                    if s != survey:
                        tracker = Tracker(config)
                    survey, frame, t = s, f, at
                if i is not None:
                    held.append((i, c, conf, box))
            yield batch_of(out)
        yield batch_of(step())

    return rows.select("survey_id", "frame_id", "t_epoch_ms", "detection_id", "damage_class", "confidence", "x1", "y1", "x2", "y2").mapInArrow(run, schema)


def summarize_tracks(tracked: DataFrame, key: list[str], min_length: int = 1) -> DataFrame:
    """One row for each track: its length, first and last frame and time, maximum and mean confidence and the best
    detection (highest confidence, then the earliest, then the smallest id)."""
    order = F.struct("t_epoch_ms", "detection_id")
    best = F.min_by("detection_id", F.struct(-F.col("confidence"), "t_epoch_ms", "detection_id"))
    out = tracked.groupBy(*key).agg(
        F.count("*").alias("n_detections"), F.min("t_epoch_ms").alias("first_t"), F.max("t_epoch_ms").alias("last_t"),
        F.min_by("frame_id", order).alias("first_frame_id"), F.max_by("frame_id", order).alias("last_frame_id"),
        F.max("confidence").alias("max_confidence"), F.avg("confidence").alias("mean_confidence"), best.alias("best_detection_id"),
    )
    return out.where(F.col("n_detections") >= min_length)
