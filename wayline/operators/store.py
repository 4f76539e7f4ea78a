"""Keyed tables on Parquet: last write wins, partial updates, append-only logs, versions."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERSION = 2


def last_write(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by `order`, which must be unique within a key. An aggregate, so rows are combined
    before the shuffle and a hot key is no burden."""
    rest = [c for c in df.columns if c not in key]
    first = [F.col(c) for c in order]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*first)).alias("s"))
    return picked.select(*[F.col(c) if c in key else F.col(f"s.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """`old` with the rows of `new`: new keys are added, columns of known keys replaced, but for those in `keep`. Both
    hold a key once."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    has = F.col(f"b.{key[0]}").isNotNull()
    was = F.col(f"a.{key[0]}").isNotNull()
    cols = []
    for c in old.columns:
        if c in key:
            cols.append(F.coalesce(f"a.{c}", f"b.{c}").alias(c))
        elif c in keep:
            cols.append(F.when(was, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            cols.append(F.when(has, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return a.join(b, on, "full_outer").select(*cols)


def append_only(log: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(log with the new rows whose key it doesn't have, refused rows). Of new rows with one key the first by all
    columns is taken, the others are refused."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*new.columns))
    rows = new.withColumn("_rank", rank).join(log.select(key, F.lit(True).alias("_known")).distinct(), key, "left")
    taken = F.col("_known").isNull() & (F.col("_rank") == 1)
    return log.unionByName(rows.where(taken).select(*new.columns)), rows.where(~taken).select(*new.columns)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and leads nowhere."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


POINTER = "_CURRENT"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = where.getFileSystem(conf)
    return hadoop, fs, hadoop.FileContext.getFileContext(fs.getUri(), conf)


def _current(spark: SparkSession, path: str) -> str | None:
    hadoop, fs, _ = _files(spark, path)
    at = hadoop.Path(f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytearray(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a new version of the table below `path`, then has the pointer file name it by one atomic rename: readers
    see one version or the other, and df may read the table it replaces. The version before stays for those who are
    reading it; older ones go."""
    spark = df.sparkSession
    was, now = _current(spark, path), f"data-{uuid.uuid4().hex}"
    df.withColumn("_schema_version", F.lit(VERSION)).write.parquet(f"{path}/{now}")
    hadoop, fs, context = _files(spark, path)
    draft = hadoop.Path(f"{path}/{POINTER}-{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(now.encode()))
    stream.close()
    rename = getattr(hadoop, "Options$Rename")
    over = spark._sc._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context.rename(draft, hadoop.Path(f"{path}/{POINTER}"), over)
    for entry in fs.listStatus(hadoop.Path(path)):
        name = entry.getPath().getName()
        if name.startswith("data-") and name not in (was, now):
            fs.delete(entry.getPath(), True)


def read_table(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A table; refused if written by a newer version, columns that an older one lacks are null."""
    now = _current(spark, path)
    if now is None:
        raise FileNotFoundError(f"no table at {path}")
    df = spark.read.option("mergeSchema", "true").parquet(f"{path}/{now}")
    newest = df.agg(F.max("_schema_version")).first()[0]
    if newest is not None and newest > VERSION:
        raise ValueError(f"{os.path.basename(path)} has version {newest}, newer than {VERSION}")
    df = df.drop("_schema_version")
    return df.withColumns({c: F.lit(None).cast(t) for c, t in (columns or {}).items() if c not in df.columns})


def current_state(log: DataFrame, key: str, at: str, tiebreak: str, attributes: list[str]) -> DataFrame:
    """The fold of an append-only log: for each key the last non-null value of every attribute, by (at, tiebreak)."""
    order = F.struct(at, tiebreak)
    return log.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in attributes], F.count("*").alias("n_entries"), F.max(at).alias("last_at"))
