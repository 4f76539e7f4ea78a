"""Single-link clustering with an extent cap.

The greedy rule is sequential, but what a candidate does depends only on the clusters around it: it joins one that has a
member within the largest merge radius, whose members lie within twice the extent of one another. So space is cut into
tiles with a halo of that reach, and each tile runs the rule over its own candidates and those of its halo, in their
order. The halo's decisions are its home tiles' of the round before, at first what the tile itself makes of them. Once a
round changes no decision all are those of the sequential rule: by induction over the order, each was made from the right
ones before it. A round is one exchange; tasks stream their tiles one after another.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators.trips import M_PER_DEG
from wayline.session import checkpoint, release


@dataclass(frozen=True)
class ClusteringConfig:
    merge_radius_m: float = 12.0
    same_class: bool = True
    scale_by_uncertainty: bool = True
    max_merge_radius_m: float = 30.0
    max_extent_m: float = 15.0
    default_uncertainty_m: float = 10.0
    tile_m: float = 2000.0

    def reach_m(self) -> float:
        return self.max_merge_radius_m if self.scale_by_uncertainty else self.merge_radius_m

    def halo_m(self) -> float:
        return (self.reach_m() + 2 * self.max_extent_m) * 1.02 + 1.0


def _metres(la: np.ndarray, lo: np.ndarray, lat: float, lon: float) -> np.ndarray:
    p, q = np.radians(la), math.radians(lat)
    h = np.sin((p - q) / 2) ** 2 + np.cos(p) * math.cos(q) * np.sin(np.radians(lo - lon) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


class _Cluster:
    """Members in growing arrays, so that taking one in is cheap."""

    __slots__ = ("n", "la", "lo", "w", "u")

    def __init__(self):
        self.n, self.u = 0, 0.0
        self.la, self.lo, self.w = np.empty(4), np.empty(4), np.empty(4)

    def add(self, la: float, lo: float, u: float) -> None:
        if self.n == len(self.la):
            self.la, self.lo, self.w = (np.resize(a, 2 * self.n) for a in (self.la, self.lo, self.w))
        self.la[self.n], self.lo[self.n], self.w[self.n] = la, lo, 1.0 / max(u, 0.5) ** 2
        self.n, self.u = self.n + 1, max(self.u, u)

    def nearest(self, la: float, lo: float) -> float:
        return float(_metres(self.la[: self.n], self.lo[: self.n], la, lo).min())

    def extent_with(self, la: float, lo: float, u: float) -> float:
        a, b, w = np.append(self.la[: self.n], la), np.append(self.lo[: self.n], lo), np.append(self.w[: self.n], 1.0 / max(u, 0.5) ** 2)
        w = w / w.sum()
        return float(_metres(a, b, float((w * a).sum()), float((w * b).sum())).max())


def greedy_clusters(ids: list[str], la: list[float], lo: list[float], u: list[float], cls: list, c: ClusteringConfig, known: list[str | None] | None = None) -> list[str]:
    """For each candidate, in their order of processing, the one that founded its cluster. known: decisions that are
    taken as they are, null for those to be made. Longitudes must not jump."""
    known = known or [None] * len(ids)
    clusters: dict[str, _Cluster] = {}
    order: dict[str, int] = {}
    cells: dict[tuple, dict[str, None]] = defaultdict(dict)
    step_la = c.reach_m() / M_PER_DEG * 1.001
    widest = max((abs(x) for x in la), default=0.0)
    step_lo = step_la / max(math.cos(math.radians(min(89.99, widest + step_la))), 1e-4)
    out = []
    for i, me in enumerate(ids):
        kind = cls[i] if c.same_class else None
        x, y = math.floor(lo[i] / step_lo), math.floor(la[i] / step_la)
        to = known[i]
        if to is None:
            near = {k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in cells.get((kind, x + dx, y + dy), ())}
            best, to = math.inf, me
            for k in sorted(near, key=order.__getitem__):
                m = clusters[k]
                d = m.nearest(la[i], lo[i])
                reach = min(c.merge_radius_m + u[i] + m.u, c.max_merge_radius_m) if c.scale_by_uncertainty else c.merge_radius_m
                if d <= reach and d < best and m.extent_with(la[i], lo[i], u[i]) <= c.max_extent_m:
                    best, to = d, k
        if to not in clusters:
            clusters[to], order[to] = _Cluster(), len(order)
        clusters[to].add(la[i], lo[i], u[i])
        cells[kind, x, y][to] = None
        out.append(to)
    return out


def _tiles(c: ClusteringConfig) -> tuple[Column, Column]:
    """(home, near): the tile of a position, and all tiles that have it in themselves or in their halo. Bands of
    latitude, each cut into as many tiles as are about tile_m wide there; they close around the globe."""
    side, halo = c.tile_m / M_PER_DEG, c.halo_m() / M_PER_DEG
    band = lambda la: F.floor((la + 90.0) / side).cast("long")
    around = lambda b: F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(F.lit(89.9), F.abs((b + 0.5) * side - 90.0)))) * 360.0 / side)).cast("long")
    place = lambda lo, n: F.floor((lo + 180.0) / 360.0 * n).cast("long")
    wide = F.least(F.lit(180.0), halo / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + halo)))))
    tile = lambda b, x: F.struct(b.alias("band"), F.pmod(x, around(b)).alias("x"))

    def row(b: Column) -> Column:
        n = around(b)
        first, last = place(F.col("lon") - wide, n), place(F.col("lon") + wide, n)
        return F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda x: tile(b, x))

    own = band(F.col("lat"))
    return tile(own, place(F.col("lon"), around(own))), F.array_distinct(F.flatten(F.transform(F.sequence(band(F.col("lat") - halo), band(F.col("lat") + halo)), row)))


DECIDED = "id string, founder string"


def _rule(c: ClusteringConfig):
    """Sorted rows (scope, tile, t, id, cls, lat, lon, u, home, known) to (id, founder) of those at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def decide() -> tuple[list, list]:
            ids, cls, la, lo, u, home, known = map(list, zip(*held))
            lo = [lo[0] + (x - lo[0] + 180.0) % 360.0 - 180.0 for x in lo]
            founders = greedy_clusters(ids, la, lo, u, cls, c, [None if h else k for h, k in zip(home, known)])
            mine = [k for k, h in enumerate(home) if h]
            return [ids[k] for k in mine], [founders[k] for k in mine]

        for batch in batches:
            out: tuple[list, list] = ([], [])
            for scope, band, x, *row in zip(*(col.to_pylist() for col in batch.columns)):
                if (scope, band, x) != now:
                    if held:
                        ids, founders = decide()
                        out[0].extend(ids)
                        out[1].extend(founders)
                    now, held = (scope, band, x), []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.string()) for o in out], names=["id", "founder"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.string()) for o in decide()], names=["id", "founder"])

    return run


def cluster(candidates: DataFrame, config: ClusteringConfig = ClusteringConfig(), scope: list[str] | None = None) -> DataFrame:
    """`candidates` (observation_id, survey_id, observed_at, damage_class, confidence, lat, lon, uncertainty_m,
    representative_frame_id) with usable positions, each with cluster_id: the observation that founded its cluster.

    Order is (observed_at, observation_id). A null uncertainty is config.default_uncertainty_m. `scope` names columns
    that clusters never span (for instance survey_id). observation_id is unique.
    """
    c = config
    rows = candidates.where(geo.usable("lat", "lon") & F.col("observation_id").isNotNull()).withColumn("u", F.coalesce("uncertainty_m", F.lit(c.default_uncertainty_m)))
    same = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in [*(["damage_class"] if c.same_class else []), *(scope or [])]]
    home, near = _tiles(c)
    lean = rows.select(F.concat_ws("\x1f", *same).alias("scope") if same else F.lit("").alias("scope"), F.col("observation_id").alias("id"), F.col("observed_at").alias("t"), "damage_class", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "u")
    spread = lean.withColumn("own", home).withColumn("tile", F.explode(near))
    spread = checkpoint(spread.select("scope", "tile.band", "tile.x", "t", "id", F.coalesce("damage_class", F.lit("")).alias("cls"), "lat", "lon", "u", (F.col("tile") == F.col("own")).alias("home")))

    def round_of(known: DataFrame) -> DataFrame:
        task = known.repartition("scope", "band", "x").sortWithinPartitions("scope", "band", "x", "t", "id")
        return checkpoint(task.select("scope", "band", "x", "id", "cls", "lat", "lon", "u", "home", "known").mapInArrow(_rule(c), DECIDED))

    now = round_of(spread.withColumn("known", F.lit(None).cast("string")))
    while True:
        after = round_of(spread.join(now.withColumnRenamed("founder", "known"), "id"))
        changed = after.join(now.withColumnRenamed("founder", "was"), "id").where("founder <> was").limit(1).count()
        release(now)
        now = after
        if not changed:
            break
    release(spread)
    return rows.drop("u").join(now.select(F.col("id").alias("observation_id"), F.col("founder").alias("cluster_id")), "observation_id")


def defects_of(clustered: DataFrame, config: ClusteringConfig = ClusteringConfig()) -> DataFrame:
    """One row for each cluster: weighted place, uncertainty (never better than the best single one), best confidence
    and its frame, surveys in order of first sight, first and last seen, count."""
    w = 1.0 / F.pow(F.greatest(F.coalesce("uncertainty_m", F.lit(config.default_uncertainty_m)), F.lit(0.5)), 2)
    u = F.coalesce("uncertainty_m", F.lit(config.default_uncertainty_m))
    rows = clustered.withColumn("w", w).withColumn("u", u)
    first = F.min(F.struct("observed_at", "observation_id"))
    # a cluster over the 180th meridian has its mean there, not at the other side of the globe
    turned = F.when(F.col("lon") < 0, F.col("lon") + 360.0).otherwise(F.col("lon"))
    mean = lambda x: F.sum(F.col("w") * x) / F.sum("w")
    lon = F.when(F.max("lon") - F.min("lon") > 180.0, geo.normalize_lon(mean(turned))).otherwise(mean(F.col("lon")))
    seen = F.array_sort(F.collect_list(F.struct("observed_at", "observation_id", "survey_id")))
    return rows.groupBy("cluster_id").agg(
        F.min_by("damage_class", F.struct("observed_at", "observation_id")).alias("damage_class"),
        (F.sum(F.col("w") * F.col("lat")) / F.sum("w")).alias("lat"), lon.alias("lon"),
        F.round(F.greatest(F.sqrt(1.0 / F.sum("w")), F.min("u")), 3).alias("uncertainty_m"), F.max("confidence").alias("confidence"),
        F.min_by("representative_frame_id", F.struct(-F.col("confidence"), "observed_at", "observation_id")).alias("representative_frame_id"),
        F.array_distinct(F.transform(seen, lambda s: s["survey_id"])).alias("survey_ids"), first["observed_at"].alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count("*").alias("observation_count"),
    )
