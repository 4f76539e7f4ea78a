"""Stops and trips from the position fixes of moving devices.

First pass, per (source, two-hour chunk with a halo): positions are projected to metres, fixes that jump away and back
are set aside, and each coordinate is denoised by exact one-dimensional total variation. Where the denoised path keeps
still it forms a plateau; plateaus become stays, everything between them moves. Second pass: a state machine over the
few pieces of each source in order of time joins stays across gaps and chunk edges, keeps those of the minimum
duration as stops and makes trips of the original paths between them. It reads its input as a sorted stream, so a
source of any length needs constant memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators.chunks import with_chunks

M_PER_DEG = math.pi * geo.EARTH_RADIUS_M / 180.0


@dataclass(frozen=True)
class StopConfig:
    place_m: float = 25.0  # how far from its place a stop may reach
    min_stop_s: float = 120.0
    break_s: float = 600.0  # fixes missing for longer, and another place: what was going on ends
    gap_s: float = 60.0  # denoising doesn't reach over longer gaps
    still_s: float = 6.0  # the denoised path keeps still if it moves at most still_m from still_s before to still_s after
    still_m: float = 6.0
    stray_m: float = 30.0  # a fix that jumps so far away from its surroundings, and back, is a stray
    stray_fixes: int = 7
    fast_mps: float = 45.0
    chunk_s: int = 7200
    halo_s: int = 600


def tv_denoise(y: list[float], lam: float) -> np.ndarray:
    """argmin over x of sum (x - y)^2 / 2 + lam * sum |x[i+1] - x[i]|, exactly (Condat 2013, direct algorithm)."""
    n = len(y)
    out = np.empty(n)
    if n == 0:
        return out
    k = k0 = low_end = high_end = 0
    low, high, u_low, u_high = y[0] - lam, y[0] + lam, lam, -lam
    last = n - 1
    while True:
        if k == last:
            if u_low < 0.0:
                out[k0 : low_end + 1] = low
                k = k0 = low_end = low_end + 1
                low, u_low = y[k], lam
                u_high = y[k] + lam - high
            elif u_high > 0.0:
                out[k0 : high_end + 1] = high
                k = k0 = high_end = high_end + 1
                high, u_high = y[k], -lam
                u_low = y[k] - lam - low
            else:
                out[k0:] = low + u_low / (k - k0 + 1)
                return out
            continue
        step = y[k + 1]
        if step + u_low < low - lam:
            out[k0 : low_end + 1] = low
            k = k0 = low_end = high_end = low_end + 1
            low, high, u_low, u_high = y[k], y[k] + 2 * lam, lam, -lam
        elif step + u_high > high + lam:
            out[k0 : high_end + 1] = high
            k = k0 = low_end = high_end = high_end + 1
            low, high, u_low, u_high = y[k] - 2 * lam, y[k], lam, -lam
        else:
            k += 1
            u_low += step - low
            u_high += step - high
            if u_low >= lam:
                low += (u_low - lam) / (k - k0 + 1)
                u_low, low_end = lam, k
            if u_high <= -lam:
                high += (u_high + lam) / (k - k0 + 1)
                u_high, high_end = -lam, k


def running_median(a: np.ndarray, half: int) -> np.ndarray:
    """Running median; the ends see their surroundings mirrored, so that a stray end stands out."""
    wide = np.pad(a, half, mode="reflect" if len(a) > half else "edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1), axis=1)


def runs(mask: np.ndarray) -> np.ndarray:
    """[first, behind last] of each run of True."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).reshape(-1, 2)


def stray_fixes(t: np.ndarray, x: np.ndarray, y: np.ndarray, c: StopConfig) -> np.ndarray:
    """Fixes in short runs that jump away from where the fixes around them are, and back: mask."""
    odd = np.zeros(len(t), bool)
    for half in (3, 7):
        mx, my = running_median(x, half), running_median(y, half)
        d = np.hypot(x - mx, y - my)
        calm = running_median(d, half) < c.stray_m * 0.4
        v = np.hypot(np.diff(x), np.diff(y)) / np.maximum(np.diff(t), 1e-3)
        fast = np.maximum(np.append(v, 0.0), np.append(0.0, v)) > c.fast_mps
        odd |= (d > c.stray_m) & (calm | fast)
    out = np.zeros(len(t), bool)
    for a, b in runs(odd):
        if b - a > c.stray_fixes:
            continue
        if a == 0 or b == len(t):
            out[a:b] = a != b and len(t) > 2 * (b - a) + 1
            continue
        span = max(t[b] - t[a - 1], 1e-3)
        direct = math.hypot(x[b] - x[a - 1], y[b] - y[a - 1])
        detour = max(np.hypot(x[a:b] - x[a - 1], y[a:b] - y[a - 1]).min(), np.hypot(x[a:b] - x[b], y[a:b] - y[b]).min())
        if direct <= c.place_m or (direct / span < c.fast_mps and detour > direct):
            out[a:b] = True
    return out


def _stays(t: np.ndarray, x: np.ndarray, y: np.ndarray, c: StopConfig) -> list[tuple[int, int]]:
    """(first, last) fixes of the plateaus of one stretch without gaps."""
    n = len(t)
    if n == 1:
        return [(0, 0)]
    noise = 1.4826 * np.median(np.hypot(np.diff(x, 2), np.diff(y, 2))) / 2.9 if n > 2 else 0.0
    lam = min(max(12.0 * noise, 20.0), 80.0)
    ux, uy = tv_denoise(x.tolist(), lam), tv_denoise(y.tolist(), lam)
    i = np.arange(n)
    before = np.minimum(np.searchsorted(t, t - c.still_s, side="left"), np.maximum(i - 1, 0))
    after = np.maximum(np.searchsorted(t, t + c.still_s, side="right") - 1, np.minimum(i + 1, n - 1))
    still = np.hypot(ux[after] - ux[before], uy[after] - uy[before]) <= c.still_m
    out: list[list[int]] = []
    for a, b in runs(still):
        cx, cy = np.median(x[a:b]), np.median(y[a:b])
        spread = np.hypot(x[a:b] - cx, y[a:b] - cy)
        r = min(max(2.5 * float(np.median(spread)), 6.0), 0.8 * c.place_m)
        far = np.hypot(ux - cx, uy - cy) > r
        inside = np.flatnonzero(~far[a:b])
        if not len(inside):
            continue
        a, b = a + inside[0], a + inside[-1]
        while a > 0 and not far[a - 1]:
            a -= 1
        while b < n - 1 and not far[b + 1]:
            b += 1
        if out and a <= out[-1][1] + 1:
            px, py = np.median(x[out[-1][0] : out[-1][1] + 1]), np.median(y[out[-1][0] : out[-1][1] + 1])
            if math.hypot(px - cx, py - cy) <= c.place_m:
                out[-1][1] = max(out[-1][1], b)
                continue
            a = out[-1][1] + 1
            if a > b:
                continue
        out.append([a, b])
    return [(a, b) for a, b in out]


PIECE = "source string, t0 long, t1 long, stay boolean, lat double, lon double, lat0 double, lon0 double, lat1 double, lon1 double, reach_m double, path_m double, fixes long"


def _chunk_pieces(key: tuple[pa.Scalar, ...], rows: pa.Table, c: StopConfig) -> pa.Table:
    names = [f.split()[0] for f in PIECE.split(", ")]
    rows = rows.sort_by("t")
    ms = rows.column("t").to_numpy()
    la, lo = rows.column("lat").to_numpy(), rows.column("lon").to_numpy()
    lo = lo[0] + np.mod(lo - lo[0] + 180.0, 360.0) - 180.0
    mid_la, mid_lo = float(np.median(la)), float(np.median(lo))
    y = (la - mid_la) * M_PER_DEG
    x = (lo - mid_lo) * M_PER_DEG * np.cos(np.radians(la))
    t = (ms - ms[0]) / 1000.0
    good = ~stray_fixes(t, x, y, c)
    ms, t, x, y, la, lo = (a[good] for a in (ms, t, x, y, la, lo))
    lo_ms, hi_ms = key[1].as_py() * c.chunk_s * 1000, (key[1].as_py() + 1) * c.chunk_s * 1000
    out: list[tuple] = []
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(t) > c.gap_s) + 1, [len(t)]))
    for s, e in zip(cuts[:-1], cuts[1:]):
        if e == s or ms[e - 1] < lo_ms or ms[s] >= hi_ms:
            continue
        marks = [(s + a, s + b + 1, True) for a, b in _stays(t[s:e], x[s:e], y[s:e], c)]
        at, parts = s, []
        for a, b, stay in marks:
            parts += [(at, a, False)] * int(a > at) + [(a, b, stay)]
            at = b
        parts += [(at, e, False)] * int(e > at)
        for a, b, stay in parts:
            a, b = a + np.searchsorted(ms[a:b], lo_ms), a + np.searchsorted(ms[a:b], hi_ms)
            if a >= b:
                continue
            hop = np.hypot(np.diff(x[a:b]), np.diff(y[a:b]))
            cl, co = (float(np.median(la[a:b])), float(np.median(lo[a:b]))) if stay else (la[a], lo[a])
            reach = float(np.hypot(x[a:b] - x[a], y[a:b] - y[a]).max())
            out.append((key[0].as_py(), int(ms[a]), int(ms[b - 1]), stay, cl, co, la[a], lo[a], la[b - 1], lo[b - 1], reach, float(hop.sum()), int(b - a)))
    cols = list(zip(*out)) if out else [[] for _ in names]
    kinds = {"source": pa.string(), "t0": pa.int64(), "t1": pa.int64(), "stay": pa.bool_(), "fixes": pa.int64()}
    return pa.table({n: pa.array(list(v), kinds.get(n, pa.float64())) for n, v in zip(names, cols)})


def _apart(a_lat: float, a_lon: float, b_lat: float, b_lon: float) -> float:
    dlon = (b_lon - a_lon + 180.0) % 360.0 - 180.0
    return math.hypot(b_lat - a_lat, dlon * math.cos(math.radians((a_lat + b_lat) / 2))) * M_PER_DEG


class _Piece:
    __slots__ = ("t0", "t1", "stay", "lat", "lon", "lat0", "lon0", "lat1", "lon1", "reach", "path", "fixes")

    def __init__(self, *values):
        for name, value in zip(self.__slots__, values):
            setattr(self, name, value)

    def start(self):
        return (self.lat, self.lon) if self.stay else (self.lat0, self.lon0)

    def end(self):
        return (self.lat, self.lon) if self.stay else (self.lat1, self.lon1)

    def join(self, p: _Piece, hop: float = 0.0) -> None:
        """p, later and at the same place, becomes part of this stay."""
        if p.stay and p.fixes > self.fixes:
            self.lat, self.lon = p.lat, p.lon
        self.t1, self.lat1, self.lon1 = p.t1, p.lat1, p.lon1
        self.path += p.path + hop
        self.fixes += p.fixes


class Machine:
    """Pieces of one source in, in order of time; (kind, t0, t1, distance, lat, lon, fixes) out."""

    def __init__(self, c: StopConfig):
        self.c, self.held, self.trip = c, [], None

    def push(self, p: _Piece) -> Iterator[tuple]:
        c = self.c
        if not self.held:
            self.held = [p]
            return
        last = self.held[-1]
        gap, d = (p.t0 - last.t1) / 1000.0, _apart(*last.end(), *p.start())
        if gap > c.break_s and d > c.place_m:
            yield from self.flush()
            yield from self.end()
            self.held = [p]
        elif gap > c.gap_s and d <= c.place_m:
            if last.stay and p.stay:
                last.join(p)
            elif last.stay:
                last.t1, last.lat1, last.lon1 = p.t0, p.lat0, p.lon0
                self.held.append(p)
            elif p.stay:
                p.t0, p.lat0, p.lon0 = last.t1, last.lat1, last.lon1
                self.held.append(p)
            else:
                self.held += [_Piece(last.t1, p.t0, True, last.lat1, last.lon1, last.lat1, last.lon1, p.lat0, p.lon0, d, 0.0, 0), p]
        elif last.stay and p.stay and d <= c.place_m:
            last.join(p)
        elif p.stay and not last.stay and len(self.held) > 1 and self.held[-2].stay and (p.t0 - self.held[-2].t1) <= 30_000 and last.reach <= 3 * c.place_m and _apart(*self.held[-2].end(), *p.start()) <= c.place_m:
            self.held.pop()
            self.held[-1].join(p, last.path)
        elif p.stay and not last.stay and len(self.held) == 1 and self.trip is None and last.reach <= c.place_m and d <= c.place_m and _apart(*last.start(), *p.start()) <= c.place_m:
            p.t0, p.lat0, p.lon0 = last.t0, last.lat0, last.lon0
            self.held = [p]
        else:
            self.held.append(p)
        while len(self.held) > 3:
            yield from self.out(self.held.pop(0))

    def flush(self) -> Iterator[tuple]:
        h = self.held
        if len(h) > 1 and h[-2].stay and not h[-1].stay and h[-1].reach <= self.c.place_m and max(_apart(*h[-2].end(), h[-1].lat0, h[-1].lon0), _apart(*h[-2].end(), h[-1].lat1, h[-1].lon1)) <= self.c.place_m:
            h[-2].join(h.pop())
        for p in h:
            yield from self.out(p)
        self.held = []

    def out(self, p: _Piece) -> Iterator[tuple]:
        """self.trip: what has gone on since the last stop, [t0, t1, metres, fixes, last lat, last lon]."""
        if self.trip is not None:
            self.trip[2] += _apart(self.trip[4], self.trip[5], p.lat0, p.lon0)
            self.trip[1] = p.t0
        if p.stay and p.t1 - p.t0 >= self.c.min_stop_s * 1000:
            if self.trip is not None and self.trip[1] > self.trip[0]:
                yield ("trip", self.trip[0], self.trip[1], self.trip[2], None, None, self.trip[3])
            yield ("stop", p.t0, p.t1, 0.0, p.lat, p.lon, p.fixes)
            self.trip = [p.t1, p.t1, 0.0, 0, p.lat1, p.lon1]
            return
        if self.trip is None:
            self.trip = [p.t0, p.t1, p.path, p.fixes, p.lat1, p.lon1]
        else:
            self.trip[1:] = [p.t1, self.trip[2] + p.path, self.trip[3] + p.fixes, p.lat1, p.lon1]

    def end(self) -> Iterator[tuple]:
        if self.trip is not None and self.trip[1] > self.trip[0]:
            yield ("trip", self.trip[0], self.trip[1], self.trip[2], None, None, self.trip[3])
        self.trip = None


RESULT = "source string, kind string, t0 long, t1 long, distance_m double, lat double, lon double, fixes long"


def stops_and_trips(fixes: DataFrame, source: str, t: str, lat: str, lon: str, order: str, config: StopConfig = StopConfig()) -> DataFrame:
    """(source, kind, t0, t1, distance_m, lat, lon, fixes): the stops and trips of each source; t in ms.

    Fixes without source or t and fixes without a usable position don't count; of several fixes at one t the one with
    the smallest `order` counts, so repeated rows change nothing. A stop has its place in lat, lon; a trip has nulls
    there. A source whose fixes never stay 120 s is one trip (more if it breaks), a source of one fix is nothing; no
    rows give no rows. Other columns are ignored.
    """
    c = config
    rows = fixes.where(F.col(source).isNotNull() & F.col(t).isNotNull() & geo.usable(lat, lon)).select(
        F.col(source).cast("string").alias("source"), F.col(t).cast("long").alias("t"), F.col(order).cast("string").alias("k"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")
    )
    # one exchange on (source, chunk) serves both the choice of one fix for each t and the denoising
    spread = with_chunks(rows, F.col("t"), c.chunk_s * 1000, c.halo_s * 1000).repartition("source", "chunk")
    single = spread.groupBy("source", "chunk", "t").agg(F.min(F.struct("k", "lat", "lon")).alias("p")).select("source", "chunk", "t", "p.lat", "p.lon")

    def denoise(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _chunk_pieces(key, table, c)

    pieces = single.groupBy("source", "chunk").applyInArrow(denoise, PIECE)

    def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m, out = None, None, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in range(8)]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            names = [f.split()[0] for f in RESULT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(cols, kinds)], names=names)

        for b in batches:
            for src, *piece in zip(*(col.to_pylist() for col in b.columns)):
                if src != now:
                    if m is not None:
                        out += [(now, *r) for r in (*m.flush(), *m.end())]
                    now, m = src, Machine(c)
                out += [(now, *r) for r in m.push(_Piece(*piece))]
            yield batch()
            out = []
        if m is not None:
            out += [(now, *r) for r in (*m.flush(), *m.end())]
            yield batch()

    return pieces.repartition("source").sortWithinPartitions("source", "t0").mapInArrow(machine, RESULT)
