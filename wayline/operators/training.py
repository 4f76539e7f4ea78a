"""Splits by blocks of a numbering and by survey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.operators.chunks import numbered

NAMES = ("train", "val", "test")


def _check(train: float, val: float) -> None:
    if not (0 < train < 1 and 0 <= val < 1 and train + val < 1):
        raise ValueError("fractions must leave something for training and for test")


def _split(rank, n, train: float, val: float, least: int = 0, joint: bool = True):
    a = F.greatest(F.floor(n * train), F.lit(least))
    b = F.greatest(a, F.floor(n * (train + val))) if joint else a + F.floor(n * val)
    return F.when(rank < a, NAMES[0]).when(rank < b, NAMES[1]).otherwise(NAMES[2])


def contiguous_splits(images: DataFrame, group: str, order: list[str], train: float = 0.7, val: float = 0.15, joint: bool = False) -> DataFrame:
    """images with `split`: in each group the first part of the order trains, the next validates, the rest tests, so
    that neighbours in the numbering stay together. Ranks are row numbers in the group; the sort spills. With `joint` validation
    ends at floor(n * (train + val)), else at floor(n * train) + floor(n * val)."""
    _check(train, val)
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(*order)) - 1
    return images.withColumns({"_rank": rank, "_n": F.count("*").over(w)}).withColumn("split", _split(F.col("_rank"), F.col("_n"), train, val, joint=joint)).drop("_rank", "_n")


def survey_splits(frames: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(survey_id, split): whole surveys, in the order of their ids; at least one trains, a single one does."""
    _check(train, val)
    ids = numbered(frames.where("survey_id is not null").select("survey_id").distinct(), ["survey_id"], "rank")
    total = ids.agg(F.count("*").alias("n"))
    ranked = ids.join(F.broadcast(total))
    return ranked.select("survey_id", F.when(F.col("n") == 1, NAMES[0]).otherwise(_split(F.col("rank"), F.col("n"), train, val, 1)).alias("split"))
