"""Image annotations: Pascal VOC files, JSON lines, and joins with the images there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.misc import RDD_CODES, rdd_class
from wayline.schema import SCHEMAS

_VOC = "filename string, size struct<width: string, height: string>, object array<struct<name: string, bndbox: struct<xmin: string, ymin: string, xmax: string, ymax: string>>>"


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, width, height, boxes, error) of VOC files. Unknown codes are dropped, coordinates cut to
    whole numbers and to the image; boxes with a coordinate that is missing or no number, or without area, are dropped.
    A file that isn't XML, or tells no size above 0, has error set and no boxes."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.from_xml("value", _VOC, {"mode": "PERMISSIVE"}).alias("x"))
    num = lambda c: F.expr(f"cast(try_cast({c} as double) as int)")
    rows = raw.select(F.regexp_replace("f", r"\.xml$", "").alias("image_id"), F.coalesce("x.filename", "f").alias("file_name"), num("x.size.width").alias("width"), num("x.size.height").alias("height"), F.col("x.object").alias("o"))
    rows = rows.withColumn("error", ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)))
    sides = (("xmin", "width"), ("ymin", "height"), ("xmax", "width"), ("ymax", "height"))
    whole = lambda b, k: b["bndbox"][k].try_cast("double").cast("int")
    kind = "array<struct<name: string, bndbox: struct<xmin: string, ymin: string, xmax: string, ymax: string>>>"
    known = F.filter(F.coalesce("o", F.array().cast(kind)), lambda b: b["name"].isin(*RDD_CODES) & whole(b, "xmin").isNotNull() & whole(b, "ymin").isNotNull() & whole(b, "xmax").isNotNull() & whole(b, "ymax").isNotNull())
    boxes = F.transform(known, lambda b: F.struct(b["name"].alias("rdd_code"), *[F.greatest(F.lit(0), F.least(whole(b, k), F.col(side))).alias(k) for k, side in sides]))
    ok = F.filter(boxes, lambda b: ~F.col("error") & (b["xmax"] > b["xmin"]) & (b["ymax"] > b["ymin"]))
    return rows.select("image_id", "file_name", "width", "height", ok.alias("boxes"), "error")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["annotations"]).option("mode", "FAILFAST").json(path)


def flat_boxes(annotations: DataFrame) -> DataFrame:
    """One row for each box, with its class."""
    rows = annotations.select("image_id", "country", "image_index", "width", "height", F.posexplode("boxes").alias("box_no", "b"))
    return rows.select("image_id", "country", "image_index", "width", "height", "box_no", "b.*", rdd_class(F.col("b.rdd_code")).alias("damage_class"))


def scaled_boxes(annotations: DataFrame, longest: int) -> DataFrame:
    """annotations scaled so that no side exceeds `longest`; boxes under a pixel wide or high are dropped."""
    k = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest("width", "height"))
    return annotations.withColumn("k", k).withColumn("boxes", F.filter(F.transform("boxes", lambda b: F.struct(b["rdd_code"].alias("rdd_code"), *[(b[c] * F.col("k")).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])), lambda b: (b["xmax"] - b["xmin"] >= 1) & (b["ymax"] - b["ymin"] >= 1))).drop("k")


def with_images(annotations: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations that have an image, those that have none)."""
    return annotations.join(images, "image_id", "left_semi"), annotations.join(images, "image_id", "left_anti")
