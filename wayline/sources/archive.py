"""Zip archives read by their directory: names are listed first, and only the entries asked for are read."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "archive string, name string, at long, compressed_bytes long, size_bytes long, method int"


def list_entries(spark: SparkSession, archives: list[str], prefix: str = "", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """ENTRY of the files in archives (paths that every worker can open), by prefix and suffix of their names. Reads the
    central directories only, Zip64 ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ENTRY.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with zipfile.ZipFile(path) as z:
                    rows = [(path, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type) for i in z.infolist() if not i.is_dir()]
                cols = list(zip(*rows)) if rows else [[] for _ in names]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    out = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(max(1, len(archives))).mapInArrow(run, ENTRY)
    if prefix:
        out = out.where(F.col("name").startswith(prefix))
    if suffixes:
        ends = F.lit(False)
        for s in suffixes:
            ends |= F.lower("name").endswith(s.lower())
        out = out.where(ends)
    return out


def read_entries(entries: DataFrame, tasks: int = 64) -> DataFrame:
    """entries with `content`, each checked against its checksum; an entry that can't be read has content null and an
    error. Entries are spread over tasks and read there in the order in which they lie in their archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, z = None, None
        try:
            for batch in batches:
                content, error = [], []
                for archive, name in zip(batch.column("archive").to_pylist(), batch.column("name").to_pylist()):
                    try:
                        if archive != path:
                            if z is not None:
                                z.close()
                            path, z = archive, zipfile.ZipFile(archive)
                        content.append(z.read(name))
                        error.append(None)
                    except (OSError, KeyError, zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                        content.append(None)
                        error.append(str(e)[:200])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary()), pa.array(error, pa.string())], names=[*batch.schema.names, "content", "error"])
        finally:
            if z is not None:
                z.close()

    rows = entries.select(*[f.split()[0] for f in ENTRY.split(", ")])
    return rows.repartition(tasks, "archive", F.floor(F.col("at") / (64 << 20))).sortWithinPartitions("archive", "at").mapInArrow(run, ENTRY + ", content binary, error string")
