"""A training set from reviewed defects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import misc
from wayline.operators.training import survey_splits
from wayline.session import checkpoint


def reviewed_records(defects: DataFrame, observations: DataFrame, detections: DataFrame, images: DataFrame, reviews: DataFrame, include_negatives: bool = True, country: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """(records, outcomes).

    records: (image_id, file_name, width, height, country, survey_id, source_status, corrected, boxes), one row for each
    verified defect with a box on its representative frame, and for each rejected one, which has none. A box has the
    class of the defect, which is the reviewer's, not that of the model. outcomes: (defect_id, outcome) of all defects:
    positive, negative, unreviewed, other_status, negatives_left_out, no_image or no_box; the first that applies.

    `images` (defect_id, width, height) are those there are; observations have detection_ids, detections x1 to y2.
    """
    seen = observations.select("defect_id", F.explode("detection_ids").alias("detection_id")).distinct()
    on = seen.join(detections.select("detection_id", F.col("frame_id").alias("_frame"), "x1", "y1", "x2", "y2"), "detection_id")
    verified = defects.where("status = 'verified'").select("defect_id", "representative_frame_id", F.col("damage_class").alias("_class"))
    here = on.join(verified, "defect_id").where("representative_frame_id is null or _frame = representative_frame_id")
    whole = [F.col(c).cast("int").alias(n) for c, n in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))]
    boxes = here.groupBy("defect_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("detection_id", F.lit("").alias("rdd_code"), F.col("_class").alias("damage_class"), *whole))), lambda b: b.dropFields("detection_id")).alias("boxes"))
    corrected = reviews.where("action = 'change_class'").select("defect_id").distinct().withColumn("corrected", F.lit(True))
    rows = defects.join(images.select("defect_id", "width", "height", F.lit(True).alias("_image")), "defect_id", "left").join(boxes, "defect_id", "left").join(corrected, "defect_id", "left")
    status = F.col("status")
    outcome = (
        F.when(status == "probable", "unreviewed").when(~status.isin("verified", "rejected"), "other_status").when((status == "rejected") & ~F.lit(include_negatives), "negatives_left_out")
        .when(F.col("_image").isNull(), "no_image").when((status == "verified") & F.col("boxes").isNull(), "no_box").when(status == "verified", "positive").otherwise("negative")
    )
    rows = rows.withColumn("outcome", outcome)
    first = F.col("survey_id") if "survey_id" in defects.columns else F.get("survey_ids", 0)
    empty = F.array().cast("array<struct<rdd_code: string, damage_class: string, xmin: int, ymin: int, xmax: int, ymax: int>>")
    records = rows.where("outcome in ('positive', 'negative')").select(
        F.col("defect_id").alias("image_id"), F.concat("defect_id", F.lit(".jpg")).alias("file_name"), "width", "height", F.lit(country).alias("country"), F.coalesce(first, F.lit("unknown")).alias("survey_id"),
        F.col("status").alias("source_status"), (F.coalesce("corrected", F.lit(False)) & (F.col("outcome") == "positive")).alias("corrected"), F.when(F.col("outcome") == "positive", F.col("boxes")).otherwise(empty).alias("boxes"),
    )
    return records, rows.select("defect_id", "outcome")


def with_splits(records: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """records with the split of their survey; with one survey all are for training."""
    return records.join(survey_splits(records, train, val), "survey_id", "left")


def manifest(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: what the set holds, what was left out and why, and a hash of its content."""
    one = records.agg(
        F.count("*").alias("image_count"), F.coalesce(F.sum(F.size("boxes")), F.lit(0)).alias("annotation_count"), F.count_if(F.col("source_status") == "rejected").alias("negative_image_count"),
        F.count_if("corrected").alias("corrected_count"), F.countDistinct("survey_id").alias("survey_count"), misc.content_hash(F.concat_ws("|", "image_id", record_text())).alias("content_hash"),
    )
    why = outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(f"skipped_{o}") for o in ("unreviewed", "no_image", "no_box")])
    return one.join(F.broadcast(why)).withColumn("warning", F.when(F.col("survey_count") < 2, "one survey only; everything is for training"))


def record_text():
    """The boxes of a record as text."""
    return F.array_join(F.transform("boxes", lambda b: F.concat(b["damage_class"], F.lit(":"), F.concat_ws(",", b["xmin"], b["ymin"], b["xmax"], b["ymax"]))), ";")


def write_dataset(records: DataFrame, outcomes: DataFrame, folder: str) -> None:
    """annotations, splits and manifest as JSON lines in folders below `folder`."""
    records = checkpoint(records)
    split = with_splits(records)
    records.drop("survey_id").write.mode("errorifexists").json(f"{folder}/annotations")
    split.select("image_id", "survey_id", "split").write.mode("errorifexists").json(f"{folder}/splits")
    manifest(records, outcomes).write.mode("errorifexists").json(f"{folder}/manifest")
