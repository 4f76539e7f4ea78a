"""Retention: files that are past their age, their deletion with a log, and what redaction did."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.misc import file_kind

LOG = "RETENTION_LOG.jsonl"


@dataclass(frozen=True)
class RetentionPolicy:
    raw_video_days: int = 30
    frames_days: int = 90
    evidence_days: int | None = None  # evidence lives as long as its defect


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_at, size_bytes) of all files below root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"))


def find_expired(files: DataFrame, now: datetime, policy: RetentionPolicy = RetentionPolicy()) -> DataFrame:
    """(path, kind, age_days, size_bytes) of the files whose age has reached the limit of their kind."""
    kind = file_kind(F.col("path"))
    age = (F.lit(now.timestamp()) - F.unix_micros(F.col("modified_at").cast("timestamp")) / 1e6) / 86_400.0
    limit = F.when(F.col("kind") == "raw_video", policy.raw_video_days).otherwise(policy.frames_days)
    return files.withColumn("kind", kind).where("kind is not null").withColumn("age_days", age).where(F.col("age_days") >= limit).select("path", "kind", "age_days", "size_bytes")


def totals(expired: DataFrame) -> DataFrame:
    """(kind, n_files, size_bytes) of what is due."""
    return expired.groupBy("kind").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"))


def apply_retention(spark: SparkSession, root: str, delete: bool = False, now: datetime | None = None, policy: RetentionPolicy = RetentionPolicy(), log: str | None = None) -> list[dict]:
    """What is due below root, with `deleted` and `error`. Nothing is deleted unless `delete` says so; each deletion is
    logged before it is done, by path, kind, size and age. Files stream to the driver one at a time."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(root)):
        return []
    moment = now or datetime.now(timezone.utc)
    due = find_expired(list_files(spark, root), moment, policy).orderBy("path")
    out = []
    for r in due.toLocalIterator():
        entry = {**r.asDict(), "deleted": False, "error": None}
        if delete:
            record = {"deleted_at": moment.astimezone(timezone.utc).isoformat().replace("+00:00", "Z"), "path": r.path, "kind": r.kind, "age_days": round(r.age_days, 2), "size_bytes": r.size_bytes}
            append_log(spark, log or f"{root.rstrip('/')}/{LOG}", record)
            try:
                entry["deleted"] = bool(fs.delete(hadoop(r.path), False))
            except Exception as e:  # one file's failure must not keep the others
                entry["error"] = str(e)[:200]
        out.append(entry)
    return out


def append_log(spark: SparkSession, path: str, record: dict) -> None:
    """Adds one JSON line; to a local file in place, elsewhere by the file system's append."""
    local = path.removeprefix("file://") if path.startswith("file:") else path
    line = json.dumps(record) + "\n"
    if "://" not in local and not local.startswith("file:"):
        with open(local, "a", encoding="utf-8") as f:
            f.write(line)
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.append(where) if fs.exists(where) else fs.create(where)
    try:
        stream.write(bytearray(line.encode()))
    finally:
        stream.close()


# --- what redaction did


def redaction_reports(images: DataFrame, regions: DataFrame, detector_id: str, method: str = "mosaic") -> DataFrame:
    """(image_id, detector_id, method, regions): for each image the kinds of the regions that were blocked out."""
    own = regions.groupBy("image_id").agg(F.array_sort(F.collect_list("kind")).alias("regions"))
    return images.select("image_id").join(own, "image_id", "left").select("image_id", F.lit(detector_id).alias("detector_id"), F.lit(method).alias("method"), F.coalesce("regions", F.array().cast("array<string>")).alias("regions"))


def count_of(kind: str):
    """How many regions of a kind a report has."""
    return F.size(F.filter("regions", lambda k: k == kind))


def summarize_reports(reports: DataFrame) -> DataFrame:
    """One row: images, those with regions, regions by kind, and the detectors and methods used."""
    return reports.agg(
        F.count("*").alias("n_images"), F.count_if(F.size("regions") > 0).alias("n_images_with_regions"), F.coalesce(F.sum(F.size("regions")), F.lit(0)).alias("n_regions"),
        F.coalesce(F.sum(count_of("person")), F.lit(0)).alias("n_persons"), F.coalesce(F.sum(count_of("vehicle")), F.lit(0)).alias("n_vehicles"),
        F.array_sort(F.collect_set("detector_id")).alias("detectors"), F.array_sort(F.collect_set("method")).alias("methods"),
    )
