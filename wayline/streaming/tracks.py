"""Streaming forms of the ordered operators: they give on a stream what the batch operators give on its table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayline.operators.tracking import Tracker, TrackingConfig


def window_counts(fixes: DataFrame, event_time: str = "ts", width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Fixes and mean speed by survey and window; rows later than the watermark are dropped."""
    rows = fixes.withWatermark(event_time, late)
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return rows.groupBy(w.alias("w"), "survey_id").agg(F.count("*").alias("n_fixes"), F.avg("speed_mps").alias("mean_speed_mps")).select("survey_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_fixes", "mean_speed_mps")


def sessions(fixes: DataFrame, event_time: str = "ts", gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    rows = fixes.withWatermark(event_time, late)
    return rows.groupBy(F.session_window(event_time, gap).alias("w"), "survey_id").agg(F.count("*").alias("n_fixes")).select("survey_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n_fixes")


def deduplicated(fixes: DataFrame, event_time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first fix of each (survey, t) within the watermark."""
    return fixes.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["survey_id", "t"])


def latest_state(log: DataFrame, key: str, at: str, attributes: list[str]) -> DataFrame:
    """The running fold of an append-only log; for output mode update or complete."""
    return log.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in attributes], F.max(at).alias("last_at"))


def track_stream(frames: DataFrame, config: TrackingConfig = TrackingConfig(), idle_ms: int | None = None) -> DataFrame:
    """(survey_id, frame_id, detection_id, track_no) of a stream of frames (survey_id, frame_id, t_epoch_ms, boxes
    array<struct<detection_id, damage_class, x1, y1, x2, y2>>). The open tracks of a survey are its state; with idle_ms
    it ends when no frame has come for that long (the query then never runs out of batches by itself). Frames of a micro-batch are put in order of time; a frame that is older than the
    last one of an earlier batch can't be tracked any more and is left out."""
    out = "survey_id string, frame_id string, detection_id string, track_no long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {"n": 0, "open": [], "last": -1}
        tracker = Tracker(config, {"n": held["n"], "open": [{**t, "box": tuple(t["box"])} for t in held["open"]]})
        rows, last = [], held["last"]
        pdf = pd.concat(list(batches)).sort_values(["t_epoch_ms", "frame_id"], kind="stable")
        for r in pdf.itertuples(index=False):
            if r.t_epoch_ms < last:
                continue
            last = int(r.t_epoch_ms)
            boxes = sorted(([] if r.boxes is None else list(r.boxes)), key=lambda b: b["detection_id"])
            nos = tracker.frame(last, [(b["damage_class"], b["x1"], b["y1"], b["x2"], b["y2"]) for b in boxes])
            rows += [(key[0], r.frame_id, b["detection_id"], n) for b, n in zip(boxes, nos)]
        state.update((json.dumps({**tracker.state(), "last": last}),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in out.split(", ")])

    return frames.groupBy("survey_id").applyInPandasWithState(step, out, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def most_accurate(fixes: DataFrame, event_time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The most accurate fix (null counts as worst, then the smallest record_id) of each (survey, event time), given once
    the watermark has passed it; so duplicates that come late, in any order, count."""
    rows = fixes.withWatermark(event_time, late)
    rest = [c for c in fixes.columns if c not in ("survey_id", event_time)]
    best = F.min_by(F.struct(*rest), F.struct(F.coalesce("accuracy_m", F.lit(float("inf"))), "record_id"))
    return rows.groupBy("survey_id", event_time).agg(best.alias("b")).select("survey_id", event_time, "b.*")


def _ordered(rows: DataFrame, key: str, event_time: str, late: str, schema: str, start: dict, work) -> DataFrame:
    """Rows of each key in the order of their event time: rows wait in the state until the watermark has passed them,
    then `work(state, row)` gives what they lead to. Rows that the watermark has already passed are left out; what waits
    when a stream ends comes out with a later batch's watermark, by an event-time timer."""
    names = [f.split()[0] for f in schema.split(", ")]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"wait": [], "state": start, "last": -1}
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for pdf in batches:
                held["wait"] += [r for r in json.loads(pdf.to_json(orient="records", date_unit="ms")) if r["_ms"] > held["last"]]
        held["wait"].sort(key=lambda r: (r["_ms"], json.dumps(r, sort_keys=True)))
        ready = [r for r in held["wait"] if r["_ms"] <= mark]
        held["wait"] = held["wait"][len(ready) :]
        out = []
        for r in ready:
            out += [(k[0], *x) for x in work(held["state"], r)]
            held["last"] = r["_ms"]
        state.update((json.dumps(held),))
        if held["wait"]:
            state.setTimeoutTimestamp(max(held["wait"][0]["_ms"], mark) + 1)
        yield pd.DataFrame(out, columns=names)

    timed = rows.withWatermark(event_time, late).withColumn("_ms", F.unix_millis(event_time))
    return timed.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def _metres(a: list, b: list) -> float:
    import math

    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


def ordered_fixes(fixes: DataFrame, event_time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(survey_id, t, lat, lon, reordered): fixes in the order of their times; reordered tells those that came after a
    later one."""

    def work(state: dict, r: dict):
        back = r["seq"] < state["seq"] if state["seq"] is not None else False
        state["seq"] = max(r["seq"], state["seq"] or r["seq"])
        return [(r["_ms"], r["lat"], r["lon"], back)]

    return _ordered(fixes.select("survey_id", event_time, "lat", "lon", F.col("seq").cast("long").alias("seq")), "survey_id", event_time, late, "survey_id string, t long, lat double, lon double, reordered boolean", {"seq": None}, work)


def distance_pieces(fixes: DataFrame, event_time: str = "ts", gap_m: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """(survey_id, t, piece, metres): for each fix but a survey's first the metres from the one before; a new piece
    begins where they are more than gap_m, and the gap itself counts nothing."""

    def work(state: dict, r: dict):
        here, was = [r["lat"], r["lon"]], state["at"]
        state["at"] = here
        if was is None:
            return []
        d = _metres(was, here)
        if d > gap_m:
            state["piece"] += 1
            d = 0.0
        return [(r["_ms"], state["piece"], d)]

    return _ordered(fixes.select("survey_id", event_time, "lat", "lon"), "survey_id", event_time, late, "survey_id string, t long, piece long, metres double", {"at": None, "piece": 0}, work)


def spaced(fixes: DataFrame, event_time: str = "ts", spacing_m: float = 2.5, min_speed_mps: float = 1.0, min_step_s: float = 0.1, late: str = "10 minutes") -> DataFrame:
    """(survey_id, t, metres): the first fix and each one that is spacing_m and min_step_s or more from the last that was
    given; fixes at a known low speed are left out."""

    def work(state: dict, r: dict):
        if r["speed_mps"] is not None and r["speed_mps"] < min_speed_mps:
            return []
        here = [r["lat"], r["lon"]]
        d = None if state["at"] is None else _metres(state["at"], here)
        if d is not None and (d < spacing_m or r["_ms"] - state["t"] < min_step_s * 1000):
            return []
        state["at"], state["t"] = here, r["_ms"]
        return [(r["_ms"], d)]

    return _ordered(fixes.select("survey_id", event_time, "lat", "lon", "speed_mps"), "survey_id", event_time, late, "survey_id string, t long, metres double", {"at": None, "t": 0}, work)
