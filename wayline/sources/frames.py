"""Where frames come from: no pixels at all, a folder of images, or a video where a decoder is installed."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of images that can stand for a video's frames; a fixed value.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp")


def synthetic_frames(plan: DataFrame, durations: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """(frame_id, survey_id, video_time_s, width, height) for the times of `plan` (survey_id, video_time_s) that lie
    within the duration_s of their survey; frames without pixels, named by survey and time."""
    rows = plan.join(durations.select("survey_id", "duration_s"), "survey_id").where(F.col("video_time_s") <= F.col("duration_s"))
    return rows.select(F.concat("survey_id", F.lit(":f"), F.format_string("%.3f", "video_time_s")).alias("frame_id"), "survey_id", "video_time_s", F.lit(width).alias("width"), F.lit(height).alias("height"))


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(survey_id, path, size_bytes) of the images below root/<survey>/..., at any depth; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size_bytes"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    inside = F.regexp_extract("path", r"([^/]+)/(?:frames/)?[^/]+$", 1)
    return files.where(suffix.isin(*IMAGE_SUFFIXES)).select(inside.alias("survey_id"), "path", "size_bytes")


def image_times(images: DataFrame, durations: DataFrame | None = None, fps: float = 1.0) -> DataFrame:
    """images (survey_id, path) with index, frame_id and video_time_s: in the order of their paths, evenly from 0 to the
    survey's duration_s, or at `fps` where there is none. The order within a survey is that of its number, by windows
    over ranges of the path."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("survey_id")
    rows = images.withColumns({"index": F.row_number().over(w.orderBy("path")) - 1, "n": F.count("*").over(w)})
    rows = rows.join(durations.select("survey_id", "duration_s"), "survey_id", "left") if durations is not None else rows.withColumn("duration_s", F.lit(None).cast("double"))
    span = F.coalesce("duration_s", F.greatest(F.lit(0.0), (F.col("n") - 1) / F.lit(fps)))
    step = F.when(F.col("n") > 1, span / (F.col("n") - 1)).otherwise(F.lit(0.0))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return rows.withColumns({"video_time_s": F.round(F.col("index") * step, 6), "frame_id": F.concat("survey_id", F.lit(":"), stem)}).drop("n", "duration_s")


def nearest_unused(times: list[float], targets: list[float]) -> list[int | None]:
    """For each target in rising order the index of the nearest of the times (rising) that no earlier target has taken,
    the earlier one if two are as near; None when none is left. Neighbours that are free are found by linked lists."""
    n = len(times)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    free = [True] * n

    def left(i: int) -> int:
        path = []
        while i >= 0 and not free[i]:
            path.append(i)
            i = before[i]
        for k in path:
            before[k] = i
        return i

    def right(i: int) -> int:
        path = []
        while i < n and not free[i]:
            path.append(i)
            i = after[i]
        for k in path:
            after[k] = i
        return i

    out: list[int | None] = []
    for t in targets:
        at = bisect.bisect_left(times, t)
        lo, hi = left(at - 1) if at else -1, right(at) if at < n else n
        if lo < 0 and hi >= n:
            out.append(None)
            continue
        k = hi if lo < 0 else lo if hi >= n else (lo if abs(times[lo] - t) <= abs(times[hi] - t) else hi)
        if k == lo and lo >= 0:
            # of images at one time the first
            while k > 0 and times[k - 1] == times[k] and free[k - 1]:
                k -= 1
        free[k] = False
        out.append(k)
    return out


def image_sequence(images: DataFrame, plan: DataFrame) -> DataFrame:
    """(frame_id, survey_id, target_s, video_time_s, path): for each time of `plan` (survey_id, video_time_s), in order,
    the nearest image of `images` (as image_times gives them) that isn't taken; a plan denser than the images doesn't
    use one twice. Survey by survey, as each choice depends on those before."""
    schema = "frame_id string, survey_id string, target_s double, video_time_s double, path string"

    def run(key: tuple, have: pa.Table, want: pa.Table) -> pa.Table:
        have = have.sort_by([("video_time_s", "ascending"), ("index", "ascending")])
        targets = sorted(want.column("video_time_s").to_pylist())
        chosen = nearest_unused(have.column("video_time_s").to_pylist(), targets)
        pairs = [(t, k) for t, k in zip(targets, chosen) if k is not None]
        got = have.take(pa.array([k for _, k in pairs], pa.int64()))
        return pa.table({"frame_id": got.column("frame_id"), "survey_id": got.column("survey_id"), "target_s": pa.array([t for t, _ in pairs], pa.float64()), "video_time_s": got.column("video_time_s"), "path": got.column("path")})

    have = images.select("survey_id", "frame_id", "video_time_s", "index", "path")
    return have.groupBy("survey_id").cogroup(plan.select("survey_id", F.col("video_time_s").cast("double").alias("video_time_s")).groupBy("survey_id")).applyInArrow(run, schema)


def video_frames(*_, **__):
    raise RuntimeError("decoding video needs PyAV on every worker, which isn't part of this package; extract frames into frames/ first")


def frame_source(bundle: DataFrame) -> DataFrame:
    """bundle (survey_id, has_video, has_frames, has_decoder) with `source`: the video where it can be decoded, else the
    folder of frames, else none."""
    source = F.when(F.col("has_video") & F.col("has_decoder"), "video").when(F.col("has_frames"), "frames").otherwise("none")
    return bundle.withColumn("source", source)
