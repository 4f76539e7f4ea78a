"""Cutting long sequences into bounded pieces, so that no source and no order is ever one task's load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.session import checkpoint


def with_chunks(df: DataFrame, t: Column, width_ms: int, halo_ms: int) -> DataFrame:
    """df with a column `chunk`: each row once in the chunk of its time, floor(t / width), and once more in a
    neighbour whose edge is at most halo_ms away (the halo must be shorter than the chunk)."""
    own = F.floor(t / width_ms).cast("long")
    first = F.floor((t - halo_ms) / width_ms).cast("long")
    last = F.floor((t + halo_ms) / width_ms).cast("long")
    near = F.when((first < own) & (last > own), F.array(own, first, last)).when(first < own, F.array(own, first)).when(last > own, F.array(own, last)).otherwise(F.array(own))
    return df.withColumn("chunk", F.explode(near))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its place (from 0) in an order that must be total: sorted by ranges, each range's rows counted, and only
    these counts, one for each partition, added up in one task."""
    rows = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at")
