"""Session, table access and the folder for checkpoints."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "wayline", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings every module expects: UTC, AQE, Arrow."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    settle(spark)
    if not getattr(spark.sparkContext, "_wayline_shipped", False):
        ship_package(spark)
        spark.sparkContext._wayline_shipped = True
    return spark


#: Spark 4.1 takes a union of equally partitioned tables for partitioned likewise and drops the exchange behind it, but
#: lets AQE coalesce each of them by itself, so that rows of one key end up in different tasks. Off, exchanges stay.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def settle(spark: SparkSession) -> SparkSession:
    """The session with what every operator relies on."""
    spark.conf.set(UNION_PARTITIONING, "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoint(): what the session names in spark.checkpoint.dir; a fresh temporary folder
    only for local masters that name none. A cluster without a shared folder is an error."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wayline-checkpoint-")
    sc.setCheckpointDir(named)
    return named


#: Tables that checkpoint() has written and that are still there, by the name of their folder.
_written: dict[str, SparkSession] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """df written as a table to the checkpoint folder and read back: lineage cut, kept through the loss of executors.

    A table rather than DataFrame.checkpoint(), whose result inherits the estimated size of its plan: a join's estimate
    is the product of its sides', so that it squares with every self-join of a loop until its digits fill the driver.
    Loops release() what they no longer read; what is left goes when the process ends.
    """
    spark = settle(df.sparkSession)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wayline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.unregister(drop_checkpoints)
        atexit.register(drop_checkpoints)
    _written[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._checkpoint_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Deletes tables that checkpoint() has given; others are left alone. Nothing may read them afterwards."""
    for df in tables:
        _delete(getattr(df, "_checkpoint_path", None))


def drop_checkpoints() -> None:
    """Deletes all that checkpoint() has written and nobody released."""
    for path in list(_written):
        _delete(path)


def _delete(path: str | None) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark._jsc.sc().isStopped() else spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone; the folder's owner cleans up then
        pass


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the workers, for sessions whose executors don't have it installed."""
    import pathlib
    import zipfile

    here = pathlib.Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="wayline-package-"), f"{here.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in here.rglob("*.py"):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(target)
