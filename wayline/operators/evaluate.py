"""Scoring detections against ground truth."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geo


def pairwise_iou(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(image_id, damage_class, pred_id, gt_id, score, iou) of all boxes of one image and class that overlap."""
    g = truth.select("image_id", "damage_class", F.col("box_id").alias("gt_id"), *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    both = predictions.select("image_id", "damage_class", F.col("box_id").alias("pred_id"), "score", "x1", "y1", "x2", "y2").join(g, ["image_id", "damage_class"])
    return both.select("image_id", "damage_class", "pred_id", "gt_id", "score", geo.iou("x1", "y1", "x2", "y2", "g_x1", "g_y1", "g_x2", "g_y2").alias("iou")).where("iou > 0")


def _claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps in the order in which predictions claim boxes, in; the claims, out. Holds the claims of one image and
    class."""
    now, used, last = None, set(), None
    for batch in batches:
        keep = []
        for k, (image, cls, pred, gt) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
            if (image, cls) != now:
                now, used, last = (image, cls), set(), None
            if pred == last or gt in used:
                continue
            used.add(gt)
            last = pred
            keep.append(k)
        yield batch.take(pa.array(keep, pa.int64())).select(["image_id", "damage_class", "pred_id", "gt_id"])


def match_boxes(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, damage_class, box_id, score, hit): in order of falling score (then box id) each prediction claims
    the unused box of its image and class with the largest overlap (then the smaller id), a hit from `threshold` on.

    Only overlaps from the threshold on can be claims; they are found by a join in the JVM, and where neither the
    prediction nor the box has another, that is the claim. The few others stream through one sorted pass.
    """
    cols = ["image_id", "damage_class", "box_id", "score"]
    near = pairwise_iou(predictions, truth).where(F.col("iou") >= threshold).repartition("image_id", "damage_class")
    one = lambda c: F.count("*").over(Window.partitionBy("image_id", "damage_class", c))
    near = near.withColumn("alone", (one("pred_id") == 1) & (one("gt_id") == 1))
    contested = near.where("not alone").select("image_id", "damage_class", "pred_id", "gt_id", "score", "iou").sortWithinPartitions("image_id", "damage_class", F.desc("score"), "pred_id", F.desc("iou"), "gt_id")
    key = ["image_id", "damage_class", "pred_id"]
    claims = near.where("alone").select(*key).unionByName(contested.mapInArrow(_claim, "image_id string, damage_class string, pred_id string, gt_id string").select(*key))
    hits = claims.withColumnRenamed("pred_id", "box_id").withColumn("hit", F.lit(True))
    return predictions.select(*cols).join(hits, ["image_id", "damage_class", "box_id"], "left").select(*cols, F.coalesce("hit", F.lit(False)).alias("hit"))


def class_scores(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """(damage_class, tp, fp, fn, precision, recall, f1); null where a denominator is 0. Every class with a prediction
    or a true box has a row."""
    p = matched.groupBy("damage_class").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    g = truth.groupBy("damage_class").agg(F.count("*").alias("gt"))
    both = p.join(g, "damage_class", "full_outer").na.fill(0, ["tp", "fp", "gt"])
    both = both.withColumn("fn", F.col("gt") - F.col("tp")).withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", "gt"))
    return both.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("gt")


def average_precision(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """(damage_class, ap): area under the precision envelope over all points; null for a class without truth.

    The running counts are windows over one class. They run in two levels, over ranges of the score and within them, so
    that a class may hold a third of all predictions.
    """
    gt = truth.groupBy("damage_class").agg(F.count("*").alias("gt"))
    part = F.least(F.floor(F.col("score") * 1000), F.lit(1000)).cast("int")
    rows = matched.withColumn("part", part)
    own = Window.partitionBy("damage_class", "part").orderBy(F.desc("score"), "image_id", "box_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("damage_class", "part").agg(F.count_if("hit").alias("s_tp"), F.count("*").alias("s_n"))
    upto = Window.partitionBy("damage_class").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("damage_class", "part", F.coalesce(F.sum("s_tp").over(upto), F.lit(0)).alias("b_tp"), F.coalesce(F.sum("s_n").over(upto), F.lit(0)).alias("b_n"))
    run = rows.join(before, ["damage_class", "part"]).join(gt, "damage_class").withColumn("tp", F.col("b_tp") + F.sum(F.col("hit").cast("long")).over(own)).withColumn("n", F.col("b_n") + F.count("*").over(own))
    run = run.withColumn("precision", F.col("tp") / F.col("n"))
    behind = Window.partitionBy("damage_class", "part").orderBy("score", F.desc("image_id"), F.desc("box_id")).rowsBetween(Window.unboundedPreceding, 0)
    later = run.groupBy("damage_class", "part").agg(F.max("precision").alias("m"))
    after = later.select("damage_class", "part", F.max("m").over(Window.partitionBy("damage_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    run = run.join(after, ["damage_class", "part"]).withColumn("envelope", F.greatest(F.max("precision").over(behind), F.col("after")))
    area = run.where("hit").groupBy("damage_class").agg(F.sum(F.col("envelope") / F.col("gt")).alias("ap"))
    classes = gt.select("damage_class").union(matched.select("damage_class")).distinct()
    return classes.join(gt, "damage_class", "left").join(area, "damage_class", "left").select("damage_class", F.when(F.col("gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def scores(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """class_scores with the average precision `ap` of each class."""
    return class_scores(matched, truth).join(average_precision(matched, truth), "damage_class")


def totals(by_class: DataFrame, split: str = "test") -> DataFrame:
    """One row over the classes of scores(): macro_f1 and map50, means of what is not null, and the sums of tp, fp and
    fn. A result on the training split says nothing about a model and is refused."""
    if split == "train":
        raise ValueError("scores on the training split are no evaluation")
    mean = lambda c, name: F.avg(c).alias(name)
    return by_class.agg(mean("f1", "macro_f1"), mean("ap", "map50"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")], F.count("*").alias("n_classes"))


def report(by_class: DataFrame) -> str:
    """The scores as a text table; as many lines as classes."""
    show = lambda x: "n/a" if x is None else f"{x:.3f}"
    rows = [f"{r.damage_class:<20} {r.tp:>7} {r.fp:>7} {r.fn:>7} {show(r.precision):>6} {show(r.recall):>6} {show(r.f1):>6} {show(r.ap):>6}" for r in by_class.orderBy("damage_class").collect()]
    t = totals(by_class).first()
    return "\n".join([f"{'class':<20} {'tp':>7} {'fp':>7} {'fn':>7} {'prec':>6} {'rec':>6} {'f1':>6} {'ap':>6}", *rows, f"macro F1 {show(t.macro_f1)}, mAP@0.5 {show(t.map50)}"])
