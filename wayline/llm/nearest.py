"""Matching records by nearest time.

Every right row becomes the interval of times to which it is nearest: bounded by the midpoints to its neighbours and
by the tolerance. Sources are cut into buckets of time; right rows are copied to a neighbouring bucket within the
tolerance of its edge, which is all that decides the bucket's times. Intervals and left rows meet in an equi-join on
(entity, bucket) refined by the interval; one exchange on these keys serves the neighbours and the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.operators.chunks import with_chunks


def nearest_in_time(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_entity: str, right_entity: str, left_t: str, right_t: str, tolerance: int, bucket: int | None = None) -> DataFrame:
    """(left_id, right_id, distance): for each left row the nearest right row of its entity, at most `tolerance` away.

    Times are whole numbers. Of two equally near right rows the earlier wins, of equal times the smaller id. Rows with
    a null id, entity or time take no part; repeated equal rows give one row, a left id with several times one for each. Left rows without a partner are left
    out; empty tables give no rows.
    """
    bucket = bucket or max(60_000, 8 * tolerance)

    def rows(df: DataFrame, id_col: str, entity: str, t: str) -> DataFrame:
        known = df.where(F.col(id_col).isNotNull() & F.col(entity).isNotNull() & F.col(t).isNotNull())
        return known.select(F.col(id_col).alias("id"), F.col(entity).alias("entity"), F.col(t).cast("long").alias("t"))

    near = with_chunks(rows(right, right_id, right_entity, right_t), F.col("t"), bucket, tolerance).repartition("entity", "chunk")
    single = near.groupBy("entity", "chunk", "t").agg(F.min("id").alias("right_id"))
    w = Window.partitionBy("entity", "chunk").orderBy("t")
    before, after = F.lag("t").over(w), F.lead("t").over(w)
    # 2t of the left must lie in (before + t, t + after]: at the midpoint the earlier wins
    intervals = single.select(
        "entity", "chunk", "right_id", F.col("t").alias("right_t"),
        F.greatest(F.col("t") - tolerance, F.coalesce(F.floor((before + F.col("t")) / 2).cast("long") + 1, F.col("t") - tolerance)).alias("first"),
        F.least(F.col("t") + tolerance, F.coalesce(F.floor((F.col("t") + after) / 2).cast("long"), F.col("t") + tolerance)).alias("last"),
    )
    seek = rows(left, left_id, left_entity, left_t).withColumnsRenamed({"id": "left_id", "t": "left_t"}).withColumn("chunk", F.floor(F.col("left_t") / bucket).cast("long"))
    seek = seek.repartition("entity", "chunk").dropDuplicates(["entity", "chunk", "left_id", "left_t"])
    met = seek.join(intervals, ["entity", "chunk"]).where(F.col("left_t").between(F.col("first"), F.col("last")))
    return met.select("left_id", "right_id", F.abs(F.col("left_t") - F.col("right_t")).alias("distance"))
