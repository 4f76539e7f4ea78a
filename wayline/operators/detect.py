"""The seam for detectors, and detectors that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.functions.misc import stable_unit

RAW = "frame_id string, damage_class string, confidence double, x1 double, y1 double, x2 double, y2 double"
CLASSES = ("longitudinal_crack", "transverse_crack", "alligator_crack", "pothole")


def run_detector(frames: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """RAW boxes of frames: `load` is called once in each task and returns a function from a batch of frames to boxes.
    Order doesn't matter, so frames need no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for pdf in batches:
            yield predict(pdf)

    return frames.mapInPandas(run, RAW)


def fake_detector(frames: DataFrame, rate: float = 0.3, seed: str = "0") -> DataFrame:
    """RAW: at most one box a frame, by hashes of the frame id; 0.08 by 0.06 of the frame, in its lower 60 percent."""
    u = lambda part: stable_unit(F.lit(seed), F.col("frame_id"), F.lit(part))
    hit = frames.where(u("hit") < rate)
    cls = F.element_at(F.array(*map(F.lit, CLASSES)), (F.floor(u("class") * len(CLASSES)) + 1).cast("int"))
    x, y = u("x") * 0.92 * F.col("width"), (0.4 + u("y") * 0.54) * F.col("height")
    return hit.select("frame_id", cls.alias("damage_class"), (0.3 + 0.7 * u("confidence")).alias("confidence"), x.alias("x1"), y.alias("y1"), (x + 0.08 * F.col("width")).alias("x2"), (y + 0.06 * F.col("height")).alias("y2"))


def scripted_detector(frames: DataFrame, script: DataFrame) -> DataFrame:
    return frames.select("frame_id").join(script, "frame_id").select(*[f.split()[0] for f in RAW.split(", ")])


def null_detector(frames: DataFrame) -> DataFrame:
    return frames.sparkSession.createDataFrame([], RAW)


def model_detector(*_, **__):
    raise RuntimeError("this detector needs a trained model and its runtime, which aren't part of this package")


def detect_report(detections: DataFrame, min_confidence: float = 0.25, limit: int | None = None) -> DataFrame:
    """Detections from the threshold on, surest first; the first `limit` of them, if asked for."""
    rows = detections.where(F.col("confidence") >= min_confidence).orderBy(F.desc("confidence"), "frame_id", "x1", "y1")
    return rows if limit is None else rows.limit(limit)


def boxes_of_model(output: DataFrame, min_score: float = 0.25, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """RAW of a detection model's output (frame_id, boxes array<array<double>>, labels array<int>, scores array<double>):
    labels count from 1; boxes below the score, with an unknown label or without area are dropped."""
    each = output.select("frame_id", F.inline(F.arrays_zip("boxes", "labels", "scores")))
    cls = F.get(F.array(*map(F.lit, classes)), F.col("labels") - 1)
    x = [F.get("boxes", k) for k in range(4)]
    rows = each.where((F.col("scores") >= min_score) & F.col("labels").between(1, len(classes)))
    return rows.select("frame_id", cls.alias("damage_class"), F.col("scores").alias("confidence"), *[c.alias(n) for c, n in zip(x, ("x1", "y1", "x2", "y2"))]).where("x2 > x1 and y2 > y1")


# --- regions that must not be seen: people and vehicles

REGION = "image_id string, kind string, confidence double, x1 double, y1 double, x2 double, y2 double"


def find_regions(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """REGION rows of images (image_id, data, height, width, channels): `load` is called once in each task. A failure
    fails the job: no image may pass for one without regions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = load()
        for pdf in batches:
            yield find(pdf)

    return images.mapInPandas(run, REGION)


def scripted_regions(images: DataFrame, script: DataFrame) -> DataFrame:
    return images.select("image_id").join(script, "image_id").select(*[f.split()[0] for f in REGION.split(", ")])


def null_regions(images: DataFrame) -> DataFrame:
    """States that images need no redaction."""
    return images.sparkSession.createDataFrame([], REGION)


def coco_regions(output: DataFrame, min_score: float = 0.3) -> DataFrame:
    """REGION of the output (image_id, label, score, x1..y2) of a model of the COCO classes: people and vehicles."""
    from wayline.functions.misc import COCO_REGIONS

    kinds = F.create_map(*[F.lit(x) for kv in COCO_REGIONS.items() for x in kv])
    rows = output.withColumn("kind", F.try_element_at(kinds, F.col("label"))).where(F.col("kind").isNotNull() & (F.col("score") >= min_score) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return rows.select("image_id", "kind", F.col("score").alias("confidence"), "x1", "y1", "x2", "y2")


def keep_detections(detections: DataFrame, min_confidence: float = 0.25, **region) -> DataFrame:
    """detections (with width, height) that are sure enough and on the road, with `reason` for those that aren't, so
    that nothing goes uncounted: null, low_confidence or outside_road."""
    inside = geo.region_accepts("x1", "y1", "x2", "y2", "width", "height", **region)
    return detections.withColumn("reason", F.when(F.col("confidence") < min_confidence, "low_confidence").when(~inside, "outside_road"))
