"""Repeated consecutive events in sequences.

A range partitioning by (entity, time, id) puts each entity's events in order into one or several neighbouring
partitions, however many it has. Each sorted partition streams through a state machine in Arrow batches; it holds one
open run and emits finished ones. The first and the last run of a partition may go on beyond it: these few rows, at
most two a partition, are joined by window functions.

With numeric tolerances a run ends where a value leaves the tolerance around the run's first event, so that where a
run begins depends on all before it: then entities are hashed to partitions instead and each streams through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.misc import damage_class  # noqa: F401
from wayline.session import checkpoint

RUN = "entity string, value string, first_id string, last_id string, t0 long, t1 long, n long, opens boolean, closes boolean, part int"
_TYPES = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.bool_(), pa.bool_(), pa.int32()]


def _machine(gap: int, tolerances: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        now: list | None = None  # entity, value, first_id, last_id, t0, t1, n, opens
        anchor: list[float | None] = []
        opens = True
        for batch in batches:
            if not batch.num_rows:
                continue
            entity, value, ids = (batch.column(k) for k in range(3))
            t = batch.column(3).to_numpy()
            e = entity.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            v = value.fill_null("\x00null").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cut = np.concatenate(([True], (e[1:] != e[:-1]) | (v[1:] != v[:-1]) | (np.diff(t) > gap)))
            if tolerances:
                nums = [batch.column(4 + k).to_pylist() for k in range(len(tolerances))]

                def near(i: int, to: list) -> bool:
                    return all((a is None) == (b is None) and (a is None or abs(a - b) <= tol) for a, b, tol in zip((c[i] for c in nums), to, tolerances))

            goes_on = now is not None and now[0] == entity[0].as_py() and now[1] == value[0].as_py() and t[0] - now[5] <= gap
            if tolerances:
                held = anchor if goes_on else None
                for i in range(len(t)):
                    if cut[i] and not (i == 0 and goes_on) or not near(i, held):
                        cut[i], held = True, [c[i] for c in nums]
                        goes_on = goes_on and i > 0
                anchor = held
            start = np.flatnonzero(cut)
            stop = np.append(start[1:], len(t))
            out = []
            first, last = ids.take(pa.array(start)).to_pylist(), ids.take(pa.array(stop - 1)).to_pylist()
            names, values = entity.take(pa.array(start)).to_pylist(), value.take(pa.array(start)).to_pylist()
            for k in range(len(start)):
                a, b = start[k], stop[k]
                if k == 0 and goes_on:
                    now[3], now[5], now[6] = last[0], int(t[b - 1]), now[6] + int(b - a)
                    continue
                if now is not None:
                    out.append((*now, False, part))
                now = [names[k], values[k], first[k], last[k], int(t[a]), int(t[b - 1]), int(b - a), opens]
                opens = False
            yield _batch(out)
        if now is not None:
            yield _batch([(*now, True, part)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in RUN.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, _TYPES)], names=names)


def collapse_runs(events: DataFrame, entity: list[str], t: str, id_col: str, value: Column, max_gap: int, tolerances: dict[str, float] | None = None) -> DataFrame:
    """(*entity, value, first_id, last_id, t0, t1, n, duration): the maximal runs of events of one entity with equal
    value, numbers within the tolerances of the run's first event, and at most max_gap from each event to the next.

    Order is (t, id). Events of one id and time count once (the one with the smallest value); a null value equals only
    null, a null number only null. Events with a null id, time or part of the entity are left out. No events give no
    runs. Entity columns come back as strings.
    """
    tol = tolerances or {}
    known = F.col(id_col).isNotNull() & F.col(t).isNotNull()
    for c in entity:
        known &= F.col(c).isNotNull()
    sep = "\x1f"
    rows = events.where(known).select(
        F.concat_ws(sep, *[F.col(c).cast("string") for c in entity]).alias("entity"), value.cast("string").alias("value"), F.col(id_col).cast("string").alias("id"), F.col(t).cast("long").alias("t"),
        *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(tol)],
    )
    rest = [c for c in rows.columns if c not in ("entity", "id", "t")]
    rows = rows.groupBy("entity", "id", "t").agg(F.min(F.struct(*rest)).alias("s")).select("entity", "s.value", "id", "t", *[f"s.x{k}" for k in range(len(tol))])
    order = ["entity", "t", "id"]
    spread = rows.repartition("entity") if tol else rows.repartitionByRange(*order)
    # written, as whole and cut runs are read from it
    pieces = checkpoint(spread.sortWithinPartitions(*order).mapInArrow(_machine(max_gap, list(tol.values())), RUN))
    # join the runs that a partition's edge has cut; all others pass by
    w = Window.partitionBy("entity").orderBy("t0", "first_id", "part")
    edge = pieces.withColumn("whole", ~(F.col("opens") | F.col("closes")))
    goes_on = F.lag("closes").over(w) & F.col("opens") & F.lag("value").over(w).eqNullSafe(F.col("value")) & (F.col("t0") - F.lag("t1").over(w) <= max_gap)
    cut = edge.where("not whole").withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = cut.groupBy("entity", "run").agg(
        F.first("value").alias("value"), F.min_by("first_id", F.struct("t0", "first_id")).alias("first_id"), F.max_by("last_id", F.struct("t1", "last_id")).alias("last_id"),
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n"),
    )
    fields = ["entity", "value", "first_id", "last_id", "t0", "t1", "n"]
    every = (edge.where("whole").select(*fields)).unionByName(joined.select(*fields)) if not tol else edge.select(*fields)
    parts = F.split("entity", sep)
    return every.select(*[parts[k].alias(c) for k, c in enumerate(entity)], *fields[1:], (F.col("t1") - F.col("t0")).alias("duration"))
