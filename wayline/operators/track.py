"""Cleaning, as-of location and distance sampling of GPS tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geo
from wayline.session import settle

FIX = ("survey_id", "t", "lat", "lon", "accuracy_m", "speed_mps", "heading_deg")


@dataclass(frozen=True)
class TrackConfig:
    max_accuracy_m: float = 25.0
    max_gap_s: float = 10.0
    default_accuracy_m: float = 10.0
    default_speed_mps: float = 13.9
    trusted_drift_s: float = 1.0
    bucket_ms: int = 3_600_000


def drop_reason(lat="lat", lon="lon", accuracy="accuracy_m", t="t", config: TrackConfig = TrackConfig()) -> Column:
    """Why a fix is dropped, null if it is kept; the first that applies. A null accuracy is kept."""
    lat, lon, acc = F.col(lat), F.col(lon), F.col(accuracy)
    return (
        F.when(F.col(t).isNull() | lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon), F.lit("malformed"))
        .when(~(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)), F.lit("out_of_range"))
        .when(acc.isNotNull() & (F.isnan(acc) | (acc > config.max_accuracy_m)), F.lit("low_accuracy"))
    )


def clean_track(fixes: DataFrame, seq: str = "record_id", config: TrackConfig = TrackConfig()) -> DataFrame:
    """Kept fixes, one for each (survey, t): the most accurate (null counts as worst), then the smallest seq."""
    kept = fixes.where(drop_reason(config=config).isNull() & F.col("survey_id").isNotNull())
    best = F.min(F.struct(F.coalesce("accuracy_m", F.lit(float("inf"))).alias("worst"), F.col(seq).alias("seq"), *[F.col(c) for c in FIX[2:]]))
    return kept.groupBy("survey_id", "t").agg(best.alias("b")).select("survey_id", "t", *[f"b.{c}" for c in FIX[2:]])


def track_stats(fixes: DataFrame, seq: str = "record_id", config: TrackConfig = TrackConfig()) -> DataFrame:
    """For each survey: what was read, dropped by reason, deduplicated and kept, and whether fixes came out of order."""
    why = fixes.where(F.col("survey_id").isNotNull()).withColumn("why", drop_reason(config=config))
    n = lambda r: F.count_if(F.col("why") == r).alias(f"dropped_{r}")
    counts = why.groupBy("survey_id").agg(F.count("*").alias("total_input"), n("malformed"), n("out_of_range"), n("low_accuracy"), F.count_if(F.col("why").isNull()).alias("sound"))
    w = Window.partitionBy("survey_id").orderBy(seq)
    order = why.where("why is null").withColumn("back", F.col("t") < F.lag("t").over(w)).groupBy("survey_id").agg(F.coalesce(F.bool_or("back"), F.lit(False)).alias("reordered"), F.countDistinct("t").alias("kept"))
    out = counts.join(order, "survey_id", "left")
    return out.select("survey_id", "total_input", "dropped_malformed", "dropped_out_of_range", "dropped_low_accuracy", (F.col("sound") - F.coalesce("kept", F.lit(0))).alias("deduplicated"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("reordered", F.lit(False)).alias("reordered"))


def track_distance(track: DataFrame) -> DataFrame:
    """For each survey: fixes, first and last t, and metres from fix to fix."""
    w = Window.partitionBy("survey_id").orderBy("t")
    hop = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return track.withColumn("hop", hop).groupBy("survey_id").agg(F.count("*").alias("n_fixes"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.coalesce(F.sum("hop"), F.lit(0.0)).alias("distance_m"))


def locate(track: DataFrame, queries: DataFrame, key: str, config: TrackConfig = TrackConfig()) -> DataFrame:
    """(key, survey_id, t, lat, lon, method, uncertainty_m, speed_mps, heading_deg, gap_s, is_trustworthy, warning): where the
    device was at the times `t` of `queries`, interpolated between the fix before and the one at or after, or clamped
    to the track's ends.

    Windows run within (survey, hour); what lies beyond the hour comes from a small table of each hour's first and last
    fix, so that no survey is one task. Surveys without a fix give no rows.
    """
    c = config
    bucket = F.floor(F.col("t") / c.bucket_ms).cast("long")
    fix = F.struct("t", *FIX[2:])
    a_fix = track.select("survey_id", "t", bucket.alias("bucket"), fix.alias("fix"))
    seek = queries.where(F.col("t").isNotNull()).select(F.col(key).alias("key"), "survey_id", F.col("t").cast("long").alias("t")).withColumn("bucket", bucket)
    ends = a_fix.groupBy("survey_id", "bucket").agg(F.min("fix").alias("first"), F.max("fix").alias("last"))
    hours = ends.join(seek.select("survey_id", "bucket").distinct(), ["survey_id", "bucket"], "full_outer")
    up, down = Window.partitionBy("survey_id").orderBy("bucket"), Window.partitionBy("survey_id").orderBy(F.desc("bucket"))
    past = lambda c_, w: F.last(c_, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.select("survey_id", "bucket", past("last", up).alias("carry_a"), past("first", down).alias("carry_b"))
    rows = a_fix.select("survey_id", "bucket", "t", F.lit(1).alias("is_fix"), F.lit(None).cast(seek.schema["key"].dataType).alias("key"), "fix").unionByName(
        seek.select("survey_id", "bucket", "t", F.lit(0).alias("is_fix"), "key", F.lit(None).cast(a_fix.schema["fix"].dataType).alias("fix"))
    )
    asc = Window.partitionBy("survey_id", "bucket").orderBy("t", "is_fix")
    desc = Window.partitionBy("survey_id", "bucket").orderBy(F.desc("t"), F.desc("is_fix"))
    near = rows.select("survey_id", "bucket", "t", "is_fix", "key", past("fix", asc).alias("a"), past("fix", desc).alias("b")).where("is_fix = 0")
    near = near.join(hours, ["survey_id", "bucket"]).select("key", "survey_id", "t", F.coalesce("a", "carry_a").alias("a"), F.coalesce("b", "carry_b").alias("b")).where("a is not null or b is not null")
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    # at the first fix and before it, at the last and after it: clamped. At the last fix b is that fix and nothing follows.
    last_t = near.select("key", "survey_id", "t", "a", "b").join(track.groupBy("survey_id").agg(F.max(fix).alias("z")), "survey_id")
    clamp = F.when(a.isNull(), b).when(t >= F.col("z.t"), F.col("z"))
    s = last_t.withColumn("c", clamp)
    cl = F.col("c")
    drift = F.abs(cl["t"] - t) / 1000.0
    span = (b["t"] - a["t"]) / 1000.0
    al = (t - a["t"]) / (b["t"] - a["t"])
    apart = geo.haversine_m(a["lat"], a["lon"], b["lat"], b["lon"])
    acc = lambda f: F.coalesce(f["accuracy_m"], F.lit(c.default_accuracy_m))
    speed0 = F.when(F.coalesce(cl["speed_mps"], F.lit(0.0)) == 0.0, F.lit(c.default_speed_mps)).otherwise(cl["speed_mps"])
    heading = F.when(a["heading_deg"].isNotNull() & b["heading_deg"].isNotNull(), geo.interpolate_bearing(a["heading_deg"], b["heading_deg"], al)).otherwise(
        F.coalesce(a["heading_deg"], b["heading_deg"], F.when(apart >= 1.0, geo.initial_bearing_deg(a["lat"], a["lon"], b["lat"], b["lon"])))
    )
    speed = F.when(a["speed_mps"].isNotNull() & b["speed_mps"].isNotNull(), geo.interpolate(a["speed_mps"], b["speed_mps"], al)).otherwise(F.coalesce(a["speed_mps"], b["speed_mps"], F.when(span > 0, apart / span)))
    ends_ = cl.isNotNull()
    pick = lambda x, y: F.when(ends_, x).otherwise(y)
    return s.select(
        F.col("key").alias(key), "survey_id", "t",
        pick(cl["lat"], geo.interpolate(a["lat"], b["lat"], al)).alias("lat"), pick(cl["lon"], geo.interpolate_lon(a["lon"], b["lon"], al)).alias("lon"),
        pick(F.lit("phone_gps"), F.lit("interpolated_phone_gps")).alias("method"),
        pick(acc(cl) + speed0 * drift, F.round(geo.interpolate(acc(a), acc(b), al) + 0.25 * apart * 4.0 * al * (1.0 - al), 3)).alias("uncertainty_m"),
        pick(cl["speed_mps"], speed).alias("speed_mps"), pick(cl["heading_deg"], heading).alias("heading_deg"),
        pick(drift, span).alias("gap_s"), pick(drift <= c.trusted_drift_s, span <= c.max_gap_s).alias("is_trustworthy"),
        pick(F.format_string("%.1f s beyond the track, at its nearest fix", drift), F.when(span > c.max_gap_s, F.format_string("interpolated over a gap of %.1f s", span))).alias("warning"),
    )


@dataclass(frozen=True)
class SamplingConfig:
    mode: str = "distance"  # fixed_fps, fixed_interval or distance
    spacing_m: float = 2.5
    fps: float = 4.0
    interval_s: float = 0.5
    min_speed_mps: float = 1.0
    min_step_s: float = 0.1
    max_frames: int | None = None


def durations(surveys: DataFrame, fixes: DataFrame, frames: DataFrame, config: TrackConfig = TrackConfig()) -> DataFrame:
    """(survey_id, recording_start_epoch_ms, duration_s): from started_at to ended_at. A recording that was never closed
    lasts from its start to its last kept fix, without one to its last frame; null if it has neither."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kept = fixes.where(drop_reason(config=config).isNull()).select("survey_id", F.col("t").alias("fix_t"), F.lit(None).cast("long").alias("frame_t"))
    seen = kept.unionByName(frames.select("survey_id", F.lit(None).cast("long").alias("fix_t"), F.col("t_epoch_ms").alias("frame_t")))
    last = seen.groupBy("survey_id").agg(F.coalesce(F.max("fix_t"), F.max("frame_t")).alias("last_t"))
    span = F.greatest((F.col("last_t") - F.col("recording_start_epoch_ms")) / 1000.0, F.when(F.col("last_t").isNotNull(), F.lit(0.0)))
    duration = F.when(F.col("ended_at").isNotNull(), (micros("ended_at") - micros("started_at")) / 1e6).otherwise(span)
    return surveys.join(last, "survey_id", "left").select("survey_id", "recording_start_epoch_ms", duration.alias("duration_s"))


def time_grid(surveys: DataFrame, step_s: float, max_frames: int | None = None) -> DataFrame:
    """(survey_id, index, video_time_s, t_epoch_ms): a frame time every step_s from 0 to duration_s. Needs survey_id,
    recording_start_epoch_ms and duration_s."""
    n = F.floor((F.col("duration_s") + 1e-9) / step_s).cast("long")
    n = F.least(n, F.lit(max_frames - 1)) if max_frames else n
    grid = surveys.where("duration_s >= 0").select("survey_id", "recording_start_epoch_ms", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("index"))
    at = F.col("index") * step_s
    return grid.select("survey_id", "index", F.round(at, 6).alias("video_time_s"), F.bround(F.col("recording_start_epoch_ms") + at * 1000.0, 0).cast("long").alias("t_epoch_ms"))


def sampling_notes(surveys: DataFrame, track: DataFrame, plan: DataFrame, config: SamplingConfig = SamplingConfig()) -> DataFrame:
    """(survey_id, n_grid, n_stationary, n_untrustworthy, n_planned, mode, notes): what the plan of each survey left out
    and why. Untrustworthy places are counted whether or not the device stood still."""
    step = 1.0 / config.fps if config.mode != "fixed_interval" else config.interval_s
    grid = time_grid(surveys, step)
    planned = plan.groupBy("survey_id").agg(F.count("*").alias("n_planned"))
    fixes = track.groupBy("survey_id").agg(F.count("*").alias("n_fixes"))
    at = locate(track, grid.select("survey_id", F.col("index").alias("k"), F.col("t_epoch_ms").alias("t")), "k")
    seen = at.groupBy("survey_id").agg(F.count_if(F.coalesce(F.col("speed_mps") < config.min_speed_mps, F.lit(False))).alias("n_stationary"), F.count_if(~F.col("is_trustworthy")).alias("n_untrustworthy"))
    rows = grid.groupBy("survey_id").agg(F.count("*").alias("n_grid")).join(seen, "survey_id", "left").join(planned, "survey_id", "left").join(fixes, "survey_id", "left").na.fill(0)
    short = F.lit(config.mode == "distance") & (F.col("n_fixes") < 2)
    say = lambda when, text, *cols: F.when(when, F.format_string(text, *cols))
    notes = F.array_compact(F.array(
        say(short, "%d fixes are too few to measure distance; a fixed rate is used", "n_fixes"), say(F.lit(config.mode == "distance") & ~short & (F.col("n_stationary") > 0), "%d times at which the device stood still are left out", "n_stationary"),
        say(~short & (F.col("n_untrustworthy") > 0), "%d times lie where the track can't be trusted", "n_untrustworthy"), say(F.lit(config.max_frames is not None) & (F.col("n_planned") >= F.lit(config.max_frames or 0)), "cut off at %d frames", "n_planned"),
    ))
    return rows.select("survey_id", "n_grid", "n_stationary", "n_untrustworthy", "n_planned", F.when(short, "fixed_fps").otherwise(config.mode).alias("mode"), notes.alias("notes"))


PLAN = "survey_id string, index long, video_time_s double, t_epoch_ms long, distance_from_previous_m double"


class _Walk:
    """The frame times of one survey by distance. Fixes come in order of time, in pieces of any size; what is held are
    the last fix, the last time that was given and the place in the grid."""

    def __init__(self, c: SamplingConfig, survey: str, start: int, duration: float):
        self.c, self.survey, self.start, self.step = c, survey, start, 1.0 / c.fps
        self.n = int(math.floor((duration + 1e-9) / self.step)) + 1 if duration is not None and duration >= 0 else 0
        self.at, self.given, self.last, self.fix, self.begun = 0, 0, None, None, False
        self.out: list[tuple] = []

    def times(self, first: int, behind: int) -> np.ndarray:
        return np.round(self.start + np.arange(first, behind) * self.step * 1000.0).astype(np.int64)

    def until(self, t: int) -> int:
        """The first grid point behind those with a time of at most t."""
        k = min(self.n, max(self.at, int(math.floor((t - self.start) / (self.step * 1000.0))) + 2))
        near = self.times(max(self.at, k - 4), k)
        return k - int((near > t).sum())

    def still(self, behind: int, lat: float, lon: float, speed: float | None) -> None:
        """Grid points up to `behind`, all at one place."""
        k = self.at
        self.at = max(self.at, behind)
        if speed is not None and speed < self.c.min_speed_mps:
            return
        while k < behind:
            was = self.given
            self.visit(k, lat, lon)
            # where one was given, or is too near, so are all that follow; only the time step may still be short
            if self.last is not None and self.given == was and self.far(lat, lon) < self.c.spacing_m:
                return
            k += 1

    def far(self, lat: float, lon: float) -> float:
        p1, p2 = math.radians(self.last[1]), math.radians(lat)
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon - self.last[2]) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))

    def visit(self, k: int, lat: float, lon: float) -> None:
        c, v, gone = self.c, round(k * self.step, 6), None
        if c.max_frames and self.given >= c.max_frames:
            return
        if self.last is not None:
            gone = self.far(lat, lon)
            if gone < c.spacing_m or v - self.last[0] < c.min_step_s:
                return
        self.out.append((self.survey, self.given, v, int(self.times(k, k + 1)[0]), None if gone is None else round(gone, 3)))
        self.given, self.last = self.given + 1, (v, lat, lon)

    def fixes(self, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray) -> None:
        """Fixes with rising t; speed is NaN where it isn't known."""
        if not self.begun:
            self.begun = True
            self.still(self.until(int(t[0])), lat[0], lon[0], None if np.isnan(speed[0]) else float(speed[0]))
        else:
            t, lat, lon, speed = (np.append(x, y) for x, y in zip(self.fix, (t, lat, lon, speed)))
        self.fix = t[-1], lat[-1], lon[-1], speed[-1]
        first, behind = self.at, self.until(int(t[-1]) - 1)  # the last fix itself is where the track may end
        for a in range(first, behind, 65_536):
            g = self.times(a, min(behind, a + 65_536))
            b = np.searchsorted(t, g, side="left")
            i = b - 1
            al = (g - t[i]) / (t[b] - t[i])
            east = np.mod(lon[b] - lon[i] + 540.0, 360.0) - 180.0
            plain = np.abs(lon[b] - lon[i]) <= 180.0
            la = lat[i] + (lat[b] - lat[i]) * al
            lo = np.where(plain, lon[i] + (lon[b] - lon[i]) * al, np.mod(lon[i] + east * al + 540.0, 360.0) - 180.0)
            p, q = np.radians(lat[i]), np.radians(lat[b])
            apart = 2 * geo.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon[b] - lon[i]) / 2) ** 2)))
            one, two = speed[i], speed[b]
            with np.errstate(invalid="ignore", divide="ignore"):
                fast = np.where(~np.isnan(one) & ~np.isnan(two), one + (two - one) * al, np.where(~np.isnan(one), one, np.where(~np.isnan(two), two, apart / ((t[b] - t[i]) / 1000.0))))
            for k in np.flatnonzero(~(fast < self.c.min_speed_mps)).tolist():
                self.visit(a + k, la[k], lo[k])
        self.at = max(first, behind)

    def end(self) -> None:
        if self.begun:
            _, lat, lon, speed = self.fix
            self.still(self.n, lat, lon, None if np.isnan(speed) else float(speed))


def _walk(c: SamplingConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(survey_id, t, start, duration, lat, lon, speed) in order: for each survey a row without t, then its fixes."""
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
        names = [f.split()[0] for f in PLAN.split(", ")]
        walk: _Walk | None = None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [batch.num_rows]))
            t, lat, lon, speed = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 4, 5, 6))
            for a, b in zip(cuts[:-1], cuts[1:]):
                survey = batch.column(0)[int(a)].as_py()
                if walk is None or walk.survey != survey:
                    if walk is not None:
                        walk.end()
                        yield done(walk.out)
                    walk = _Walk(c, survey, batch.column(2)[int(a)].as_py() or 0, batch.column(3)[int(a)].as_py())
                    a += int(np.isnan(t[a]))
                if a < b and walk.n:
                    walk.fixes(t[a:b].astype(np.int64), lat[a:b], lon[a:b], speed[a:b])
                    yield done(walk.out)
                    walk.out = []
        if walk is not None:
            walk.end()
            yield done(walk.out)

    return run


def sampling_plan(surveys: DataFrame, track: DataFrame, config: SamplingConfig = SamplingConfig()) -> DataFrame:
    """Frame times by config.mode. Distance mode walks a time grid, leaves out times at which the speed is known and
    low, and emits the first and each one that is spacing_m or more and min_step_s or more from the last emitted;
    surveys of fewer than two fixes fall back to the grid.

    What is emitted depends on all before it, so each survey streams through one task in order, with constant memory.
    Only fixes are shuffled: the task makes the grid, and places its times between the fixes as locate() does.
    """
    c = config
    step = c.interval_s if c.mode == "fixed_interval" else 1.0 / c.fps
    bare = lambda g: g.select("survey_id", "index", "video_time_s", "t_epoch_ms", F.lit(None).cast("double").alias("distance_from_previous_m"))
    if c.mode != "distance":
        return bare(time_grid(surveys, step, c.max_frames))
    settle(track.sparkSession)
    enough = track.groupBy("survey_id").agg(F.count("*").alias("n")).where("n >= 2").select("survey_id")
    fallback = time_grid(surveys.join(enough, "survey_id", "left_anti"), step, c.max_frames)
    none = lambda kind: F.lit(None).cast(kind)
    heads = surveys.where("duration_s >= 0").join(enough, "survey_id", "left_semi").select("survey_id", none("long").alias("t"), F.col("recording_start_epoch_ms").cast("long").alias("start"), F.col("duration_s").cast("double").alias("duration"), none("double").alias("lat"), none("double").alias("lon"), none("double").alias("speed"))
    # to the walk NaN means unknown; a reading that is no number is known not to be low
    speed = F.when(F.isnan("speed_mps"), float("inf")).otherwise(F.col("speed_mps").cast("double"))
    fixes = track.join(heads.select("survey_id"), "survey_id", "left_semi").select("survey_id", "t", none("long").alias("start"), none("double").alias("duration"), "lat", "lon", speed.alias("speed"))
    rows = heads.unionByName(fixes).repartition("survey_id").sortWithinPartitions("survey_id", F.asc_nulls_first("t"))
    return rows.mapInArrow(_walk(c), PLAN).unionByName(bare(fallback))
