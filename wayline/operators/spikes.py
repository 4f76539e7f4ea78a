"""Implausible readings: impossible values, spikes and stuck values, against what is normal for their source.

A local-level Kalman filter runs over the readings of each (source, chunk of time with a halo before and behind it).
Its noises are those of the source: from robust variances of the differences over one and over two readings. A reading
whose standardised innovation exceeds the threshold is flagged and doesn't update the state. One to `longest` flagged
readings, after which the readings are back at the forecast, are a candidate for a spike; more of them mean that the
level has moved, and the filter starts anew with the first of them. Where the running variance of the innovations
vanishes, the reading no longer changes: it may be stuck. What neither flags nor vanishes is never reported; an exact
rule then decides on the candidates.

A rule relative to the source's median is decided after the filter, on the few candidates, so that the readings
themselves are never joined with the sources. Runs of equal readings may be longer than any chunk: chunks give off the
runs they hold whole and the first and last run they see; windows over these few rows join them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geo
from wayline.operators.chunks import with_chunks
from wayline.operators.trips import running_median
from wayline.session import checkpoint


@dataclass(frozen=True)
class Field:
    name: str
    low: float  # below it a value is impossible
    high: float  # above it, too
    limit: float  # a spike is off by this much; in medians of the source if relative
    low_open: bool = False  # low itself is impossible
    high_open: bool = False
    relative: bool = False
    period: float = 0.0  # of a circular reading
    strict: bool = True  # off by more than the limit, not just as much

    def impossible(self) -> Column:
        v = F.col(self.name).cast("double")
        return F.isnan(v) | ((v <= self.low) if self.low_open else (v < self.low)) | ((v >= self.high) if self.high_open else (v > self.high))


FIELDS = (
    Field("accuracy_m", 0.0, float("inf"), 5.0, low_open=True, relative=True, strict=False),
    Field("speed_mps", 0.0, 100.0, 8.0),
    Field("heading_deg", 0.0, 360.0, 60.0, high_open=True, period=360.0),
)


@dataclass(frozen=True)
class SpikeConfig:
    fields: tuple[Field, ...] = FIELDS
    longest: int = 3  # fixes of a spike
    near_ms: int = 10_000  # from each to the next in and around a spike
    agree: float = 0.5  # the readings around a spike differ by at most this share of the limit
    threshold: float = 4.0  # standardised innovations above it are flagged
    least_share: float = 0.4  # of the limit (of the median, if relative, twice as much): nearer to the forecast nothing is flagged
    forget: float = 0.25  # of the running variance of the innovations
    vanished: float = 1e-6  # as a share of the least flagged innovation, squared
    stuck_readings: int = 60
    stuck_gap_ms: int = 120_000
    moves_m: float = 200.0  # how far from where a stuck run begins the source gets
    fast_mps: float = 45.0  # no vehicle jumps so fast; between two such jumps
    stray_fixes: int = 7  # so few fixes are strays and don't count as movement
    chunk_ms: int = 7_200_000
    halo_ms: int = 180_000


def _off(d: np.ndarray, period: float) -> np.ndarray:
    return d - period * np.round(d / period) if period else d


def noises(t: np.ndarray, v: np.ndarray, period: float, least: float, c: SpikeConfig) -> tuple[float, float]:
    """(r, q) of a local level: the variance of a reading, and of the level's change in a second. Differences over one
    reading have the variance q h + 2 r, over two 2 q h + 2 r; both by medians, so that spikes don't count. The level is
    never taken for steadier than a reading, which keeps the filter awake on sources that hardly change."""
    e = (0.01 * least) ** 2

    def var(k: int) -> tuple[float, float]:
        h = t[k:] - t[:-k]
        near = h <= k * c.near_ms / 1000.0
        if not near.any():
            return 0.0, 1.0
        return (1.4826 * float(np.median(np.abs(_off(v[k:] - v[:-k], period)[near])))) ** 2, float(np.median(h[near]))

    if len(t) < 4:
        return e, e
    (one, h1), (two, h2) = var(1), var(2)
    q = max(0.0, two - one) / max(h2 - h1, 0.1)
    r = max(e, (one - q * h1) / 2.0)
    return r, max(q, r)


def kalman(t: list[float], v: list[float], r: float, q: float, least: float, period: float, c: SpikeConfig) -> tuple[list[tuple[int, int]], np.ndarray]:
    """([first, behind last] of each run of one to `longest` flagged readings that ends at the forecast, mask of the
    readings at which the variance of the innovations has vanished). t in seconds, rising."""
    n, found, flat = len(t), [], bytearray(len(t))
    if not n:
        return found, np.zeros(0, bool)
    near, longest, square, floor, forget = c.near_ms / 1000.0, c.longest, c.threshold**2, least * least, c.forget
    gone = floor * c.vanished
    level, p, scale, since, i = v[0], r, floor, -1, 1
    while i < n:
        gap = t[i] - t[i - 1]
        d = v[i] - level
        if period:
            d -= period * round(d / period)
        e = d * d
        p += q * gap
        if gap > near:  # nothing is forecast over a gap
            level, p, since = v[i], r, -1
        else:
            s = p + r
            if e > square * s and e > floor:
                if since < 0:
                    since = i
                elif i - since >= longest:  # the level has moved
                    i = since
                    level, p, scale, since = v[i], r, floor, -1
                    i += 1
                    continue
                i += 1
                continue
            if since >= 0:
                found.append((since, i))
                since = -1
            g = p / s
            level += g * d
            p *= 1.0 - g
        scale += forget * ((e if e < floor else floor) - scale)
        if scale < gone:
            flat[i] = 1
        i += 1
    return found, np.frombuffer(flat, np.uint8).astype(bool)


def spike_runs(v: np.ndarray, flagged: list[tuple[int, int]], period: float, behind: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(first, behind last, least distance from the readings before and after, distance between those two) of every
    stretch of the flagged runs that lies between two readings which are near in time. behind[i]: reading i + 1 is."""
    out = []
    for a, b in flagged:
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                if i == 0 or j >= len(v) or not behind[i - 1 : j].all():
                    continue
                off = np.abs(_off(np.concatenate((v[i:j] - v[i - 1], v[i:j] - v[j], v[i - 1 : i] - v[j])), period))
                out.append((i, j, float(off[:-1].min()), float(off[-1])))
    return out


PIECE = "source string, field_name string, kind string, value double, t0 long, t1 long, n long, opens boolean, closes boolean, flat boolean, stand double, apart double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, far_m double, ids array<string>"
NAMES = [f.split()[0] for f in PIECE.split(", ")]
KINDS = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), *[pa.bool_()] * 3, *[pa.float64()] * 9, pa.list_(pa.string())]


class _Track:
    """Places of the source, in metres in space."""

    def __init__(self, rows: pa.Table, c: SpikeConfig):
        self.c = c
        t, la, lo = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("t", "lat", "lon"))
        ok = np.isfinite(la) & np.isfinite(lo)
        ok[ok] = (np.abs(la[ok]) <= 90) & (np.abs(lo[ok]) <= 180) & ~((la[ok] == 0) & (lo[ok] == 0))
        self.t, at = np.unique(t[ok], return_index=True)
        self.la, self.lo = la[ok][at], lo[ok][at]

    def moved(self, t0: int, t1: int) -> list[float | None]:
        """Where the source is at its first and at its last fix in [t0, t1], and how far it gets from the first;
        stray fixes aside. Nulls without a fix."""
        i, j = np.searchsorted(self.t, t0), np.searchsorted(self.t, t1, side="right")
        k = slice(max(0, i - 20), j + 20)
        t, la, lo = self.t[k], self.la[k], self.lo[k]
        inside = (t >= t0) & (t <= t1)
        if not inside.any():
            return [None] * 7
        a, b = np.radians(la), np.radians(lo)
        xyz = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)]) * geo.EARTH_RADIUS_M
        # strays are cut off by jumps that no vehicle makes, few at a time; medians of nine fixes outvote the others
        jump = np.sqrt((np.diff(xyz) ** 2).sum(axis=0)) > self.c.fast_mps * np.maximum(np.diff(t) / 1000.0, 1.0)
        part = np.concatenate(([0], np.cumsum(jump)))
        calm = np.bincount(part)[part] > self.c.stray_fixes
        if not (calm & inside).any():
            calm[:] = True
        p = np.stack([running_median(e[calm], 4) for e in xyz])[:, inside[calm]]
        return [*p[:, 0].tolist(), *p[:, -1].tolist(), float(np.sqrt(((p - p[:, :1]) ** 2).sum(axis=0)).max())]


def _pieces(key: tuple[pa.Scalar, ...], rows: pa.Table, c: SpikeConfig) -> pa.Table:
    rows = rows.sort_by([("t", "ascending"), ("id", "ascending")])
    src, lo_ms = key[0].as_py(), key[1].as_py() * c.chunk_ms
    hi_ms = lo_ms + c.chunk_ms
    t_all = rows.column("t").to_numpy()
    core_rows = (t_all >= lo_ms) & (t_all < hi_ms)
    ids = rows.column("id").combine_chunks()
    out: list[tuple] = []
    track = None
    for f in c.fields if core_rows.any() else ():
        v_all = rows.column(f.name).to_numpy(zero_copy_only=False)
        valid = rows.column(f.name).is_valid().to_numpy()
        good = valid & np.isfinite(v_all)
        good[good] = ((v_all[good] > f.low) if f.low_open else (v_all[good] >= f.low)) & ((v_all[good] < f.high) if f.high_open else (v_all[good] <= f.high))
        t, at = np.unique(t_all[good], return_index=True)
        v, known = v_all[good][at], valid & core_rows
        if not len(t):
            continue
        least = float(np.median(v)) * 2 * c.least_share if f.relative else f.limit * c.least_share
        sec = (t - t[0]) / 1000.0
        flagged, flat = kalman(sec.tolist(), v.tolist(), *noises(sec, v, f.period, least, c), least, f.period, c)
        for a, b, stand, apart in spike_runs(v, flagged, f.period, np.diff(t) <= c.near_ms):
            if not f.relative and (apart > c.agree * f.limit or stand < f.limit or (f.strict and stand == f.limit)):
                continue
            chosen = np.flatnonzero(known & np.isin(t_all, t[a:b]))
            if len(chosen):
                out.append((src, f.name, "spike", None, 0, 0, len(chosen), False, False, True, stand, apart, *[None] * 7, ids.take(pa.array(chosen)).to_pylist()))
        a0, b0 = np.searchsorted(t, lo_ms), np.searchsorted(t, hi_ms)
        if a0 == b0:
            continue
        ct, cv, cf = t[a0:b0], v[a0:b0], flat[a0:b0]
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(cv) != 0) | (np.diff(ct) > c.stuck_gap_ms)) + 1, [len(ct)]))
        edge = (cuts[:-1] == 0) | (cuts[1:] == len(ct))
        for k in np.flatnonzero(edge | (np.diff(cuts) >= c.stuck_readings)):
            a, b = cuts[k], cuts[k + 1]
            vanished = bool(cf[a:b].any())
            if not (edge[k] or vanished):
                continue
            track = track or _Track(rows, c)
            place = track.moved(ct[a], ct[b - 1])
            i, j = np.searchsorted(t_all, ct[a]), np.searchsorted(t_all, ct[b - 1], side="right")
            chosen = i + np.flatnonzero(known[i:j])
            if len(chosen) != b - a:
                chosen = chosen[np.isin(t_all[chosen], ct[a:b])]
            out.append((src, f.name, "stuck", float(cv[a]), int(ct[a]), int(ct[b - 1]), int(b - a), bool(a == 0), bool(b == len(ct)), vanished, None, None, *place, ids.take(pa.array(chosen)).to_pylist()))
    cols = list(zip(*out)) if out else [[] for _ in NAMES]
    return pa.table({n: pa.array(list(col), k) for n, col, k in zip(NAMES, cols, KINDS)})


#: Bits of a double that are dropped where values are counted by ranges: 1,024 ranges for each power of two.
RANGE_BITS = 42


def exact_medians(df: DataFrame, source: str, value: str) -> DataFrame:
    """(source, median) of all non-null values, the lower middle one; values must not be negative.

    Values are counted, then the counts by ranges of values. Only a source's ranges, whose number the range of its
    values bounds and not that of its rows, are put in order together; then the distinct values of the one range that
    holds the middle.
    """
    counts = checkpoint(df.groupBy(F.col(source).alias("source"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    # the bits of doubles of one sign are in the order of the doubles; log2 of the exponent and a linear rest are as good
    power = F.floor(F.log2(F.greatest("v", F.lit(1e-300))))
    part = (power * 1024 + F.floor((F.col("v") / F.pow(F.lit(2.0), power) - 1.0) * 1024)).cast("long")
    ranged = counts.withColumn("part", part)
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("source", "part").agg(F.sum("n").alias("in_part"))
    sums = sums.withColumn("upto", F.sum("in_part").over(upto)).withColumn("half", (F.sum("in_part").over(Window.partitionBy("source")) + 1) / 2)
    middle = sums.where((F.col("upto") >= F.floor("half")) & (F.col("upto") - F.col("in_part") < F.floor("half"))).select("source", "part", (F.floor("half") - F.col("upto") + F.col("in_part")).alias("nth"))
    w = Window.partitionBy("source").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.join(middle, ["source", "part"]).withColumn("upto", F.sum("n").over(w))
    return within.where(F.col("upto") >= F.col("nth")).groupBy("source").agg(F.min("v").alias("median"))


def implausible(fixes: DataFrame, id_col: str, source: str, t: str, lat: str, lon: str, config: SpikeConfig = SpikeConfig()) -> DataFrame:
    """Distinct (id, field_name, reason) of the readings that are impossible, a spike or stuck.

    Null readings are never flagged, rows without an id can't be. Without a t or a source only impossible values
    count. Rows of one source and t count as one reading, that of the smallest id that has a sound one, and all of them
    are flagged together; repeated equal rows change nothing. Ties and equal values are part of the stuck rule. A
    source without a sound accuracy has no median and no relative spikes. No rows give no rows; columns other than the
    named ones are ignored.
    """
    c = config
    sound = fixes.where(F.col(id_col).isNotNull())
    each = F.filter(
        F.array(*[F.when(f.impossible(), F.lit(f.name)) for f in c.fields]), lambda x: x.isNotNull()
    )
    impossible = sound.select(F.col(id_col).cast("string").alias("id"), F.explode(each).alias("field_name"), F.lit("impossible").alias("reason"))
    timed = sound.where(F.col(t).isNotNull() & F.col(source).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(source).cast("string").alias("source"), F.col(t).cast("long").alias("t"),
        *[F.col(f.name).cast("double").alias(f.name) for f in c.fields], F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"),
    )

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _pieces(key, rows, c)

    pieces = checkpoint(with_chunks(timed, F.col("t"), c.chunk_ms, c.halo_ms).groupBy("source", "chunk").applyInArrow(work, PIECE))
    spike = pieces.where("kind = 'spike'")
    plain = spike.where(~F.col("field_name").isin([f.name for f in c.fields if f.relative])).select("ids", "field_name")
    for f in c.fields:
        if f.relative:
            # the candidates of a relative rule, now that the medians are known
            own = spike.where(F.col("field_name") == f.name).join(exact_medians(timed.where(F.col(f.name).isNotNull() & ~f.impossible()), "source", f.name), "source")
            limit = F.col("median") * f.limit
            far = (F.col("stand") > limit) if f.strict else (F.col("stand") >= limit)
            plain = plain.union(own.where((limit > 0) & far & (F.col("apart") <= limit * c.agree)).select("ids", "field_name"))
    spike = plain.select(F.explode("ids").alias("id"), "field_name", F.lit("spike").alias("reason"))
    w = Window.partitionBy("source", "field_name").orderBy("t0")
    joined = (
        (F.lag("value").over(w) == F.col("value")) & F.lag("closes").over(w) & F.col("opens") & (F.col("t0") - F.lag("t1").over(w) <= c.stuck_gap_ms)
    )
    run = pieces.where("kind = 'stuck'").withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    run = run.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("source", "field_name", "run")
    here = F.col("x0").isNotNull()
    first = F.min_by(F.struct(*[F.col(f"{k}0").alias(k) for k in "xyz"]), F.when(here, F.col("t0"))).over(whole)
    run = run.withColumns({"readings": F.sum("n").over(whole), "vanished": F.bool_or("flat").over(whole), "first": first})
    away = lambda e: F.sqrt(sum(F.pow(F.col(f"{k}{e}") - F.col(f"first.{k}"), 2) for k in "xyz"))
    run = run.withColumn("moved", F.max(F.greatest("far_m", away(0), away(1))).over(whole))
    stuck = run.where((F.col("readings") >= c.stuck_readings) & F.col("vanished") & (F.col("moved") > c.moves_m))
    stuck = stuck.select(F.explode("ids").alias("id"), "field_name", F.lit("stuck").alias("reason"))
    return impossible.unionByName(spike).unionByName(stuck).distinct()
