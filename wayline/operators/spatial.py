"""Points near points and points in regions.

Both joins use one plan. A bounded random sample of positions builds a quadtree on the driver; only its leaves (an
array of Morton codes, at most a few thousand numbers) travel to the tasks. Every point has one home leaf; reference
points and regions are copied to each further leaf that their box touches. Each leaf is one group: its reference side
is bulk loaded into an R-tree and probed, candidates are refined by exact geometry, and a pair is reported only where
its reference point (the smaller id's position, or the probing point) has its home, hence once.

A leaf that holds more than `block` rows is cut: near_pairs splits it into k parts by a hash of the id and runs each
unordered pair of parts as its own group; in_zones spreads its probing points. So no group grows with a hot place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators.rtree import RTree

#: Rows of the sample that shapes the quadtree; results don't depend on it.
SAMPLE_ROWS = 200_000
M_PER_DEG = np.pi * geo.EARTH_RADIUS_M / 180.0
#: Boxes are this much wider than the radius, against rounding.
SLACK = 1.0 + 1e-6


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of v (up to 26) at even places."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


@dataclass
class QuadTree:
    """Leaves of a quadtree over the map as sorted intervals of Morton codes at `depth` levels."""

    depth: int
    starts: np.ndarray  # uint64, first code of each leaf
    salts: np.ndarray  # int32, blocks that each leaf is cut into

    def cell(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = 1 << self.depth
        return (
            np.clip(((lon + 180.0) / 360.0 * n).astype(np.int64), 0, n - 1),
            np.clip(((lat + 90.0) / 180.0 * n).astype(np.int64), 0, n - 1),
        )

    def leaf(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        x, y = self.cell(lat, lon)
        code = _spread(x) | (_spread(y) << np.uint64(1))
        return (np.searchsorted(self.starts, code, side="right") - 1).astype(np.int32)

    def rectangles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the leaves: min lat, min lon, max lat, max lon."""
        ends = np.append(self.starts[1:], np.uint64(1) << np.uint64(2 * self.depth))
        side = np.sqrt((ends - self.starts).astype(np.float64))
        x = np.zeros(len(self.starts))
        y = np.zeros(len(self.starts))
        for bit in range(self.depth):
            x += ((self.starts >> np.uint64(2 * bit)) & np.uint64(1)).astype(np.float64) * (1 << bit)
            y += ((self.starts >> np.uint64(2 * bit + 1)) & np.uint64(1)).astype(np.float64) * (1 << bit)
        w, h = 360.0 / (1 << self.depth), 180.0 / (1 << self.depth)
        return y * h - 90.0, x * w - 180.0, (y + side) * h - 90.0, (x + side) * w - 180.0

    def touched(self, lat0, lon0, lat1, lon1) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) numbers of all leaves that meet boxes of degrees; longitudes may leave [-180, 180]."""
        a, b, c, d = self._rectangles
        box, leaf = [], []
        tree = self._tree
        for turn in (-360.0, 0.0, 360.0):
            for q, k in tree.probe(lon0 + turn, lat0, lon1 + turn, lat1):
                box.append(q)
                leaf.append(k)
        if not box:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        both = np.unique(np.stack([np.concatenate(box), np.concatenate(leaf)]), axis=1)
        return both[0], both[1].astype(np.int32)

    def __post_init__(self):
        self._rectangles = a, b, c, d = self.rectangles()
        self._tree = RTree(b, a, d, c)

    def __getstate__(self):
        return {"depth": self.depth, "starts": self.starts, "salts": self.salts}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()


def build_quadtree(points: DataFrame, lat: str, lon: str, margin_m: float, block: int) -> QuadTree:
    """From a random sample of at most about SAMPLE_ROWS usable positions. Leaves hold an estimated `block` / 4 rows
    where depth allows; the smallest are some ten margins high, so that a box seldom meets more than four."""
    depth = int(np.clip(np.floor(np.log2(180.0 * M_PER_DEG / max(10.0 * margin_m, 50.0))), 1, 24))
    pos = points.where(geo.usable(lat, lon)).select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    total = points.count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    rows = pos.sample(fraction=share, seed=7).toPandas() if share < 1 else pos.toPandas()
    shape = QuadTree(depth, np.zeros(1, np.uint64), np.ones(1, np.int32))
    x, y = shape.cell(rows["lat"].to_numpy(np.float64), rows["lon"].to_numpy(np.float64))
    codes = np.sort(_spread(x) | (_spread(y) << np.uint64(1)))
    most = max(8.0, share * block / 4)
    starts, stack = [], [(0, 0)]
    while stack:
        level, first = stack.pop()
        size = 1 << (2 * (depth - level))
        lo, hi = np.searchsorted(codes, [np.uint64(first), np.uint64(first + size - 1)], side="left")
        if level < depth and hi - lo > most:
            stack += [(level + 1, first + k * (size // 4)) for k in range(4)]
        else:
            starts.append(first)
    found = np.sort(np.array(starts, dtype=np.uint64))
    held = np.histogram(codes.astype(np.float64), bins=np.append(found.astype(np.float64), float(1 << (2 * depth))))[0]
    return QuadTree(depth, found, np.maximum(1, np.ceil(held / share / block)).astype(np.int32))


def _salt(ids: pa.Array, k: np.ndarray) -> np.ndarray:
    """A part below k for each id, the same for equal ids."""
    out = np.zeros(len(ids), np.int32)
    hot = np.flatnonzero(k > 1)
    if len(hot):
        out[hot] = [crc32(s.encode()) for s in ids.take(pa.array(hot)).to_pylist()] % k[hot].astype(np.int64)
    return out


def _box(lat: np.ndarray, lon: np.ndarray, radius_m: float):
    """Degrees around each position that hold the circle; the whole width where it reaches a pole."""
    dlat = np.full(len(lat), radius_m / M_PER_DEG * SLACK)
    top = np.abs(lat) + dlat
    ratio = np.sin(radius_m / geo.EARTH_RADIUS_M) / np.maximum(np.cos(np.radians(lat)), 1e-300)
    dlon = np.where((top >= 90.0) | (ratio >= 1.0), 180.0, np.degrees(np.arcsin(np.minimum(ratio, 1.0))) * SLACK)
    return lat - dlat, lon - dlon, lat + dlat, lon + dlon


def _metres(lat1, lon1, lat2, lon2) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _clean(points: DataFrame, id_col: str, lat: str, lon: str, *more) -> DataFrame:
    """The needed columns under fixed names, so that other columns can't clash; usable positions with an id only."""
    return points.where(geo.usable(lat, lon) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), *more, F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")
    )


def near_pairs(points: DataFrame, id_col: str, group_col: str, lat: str, lon: str, radius_m: float, block: int = 40_000) -> DataFrame:
    """All pairs of ids (id_a < id_b by byte) of different groups at most radius_m apart on the sphere.

    Rows with a null id or an unusable position take no part; a null group differs from every other group but not
    from another null. Repeated equal rows count once. An id at several positions pairs from each of them; pairs are
    distinct as long as an id has one position. No rows give no pairs.
    """
    tree = build_quadtree(points, lat, lon, radius_m, block)
    schema = "id string, grp string, lat double, lon double, home boolean, leaf int, part int, u int, v int"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            la, lo = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("lat", "lon"))
            home = tree.leaf(la, lo)
            s, w, n, e = _box(la, lo, radius_m)
            corners = [tree.leaf(np.clip(a, -90, 90), np.where(b < -180, b + 360, np.where(b > 180, b - 360, b))) for a in (s, n) for b in (w, e)]
            cell = 360.0 / (1 << tree.depth)
            wide = (e - w > cell) | (n - s > cell / 2)
            plain = np.flatnonzero(~wide)
            row = np.tile(plain, 4)
            leaf = np.concatenate([c[plain] for c in corners])
            if wide.any():
                which = np.flatnonzero(wide)
                b, k = tree.touched(s[which], w[which], n[which], e[which])
                row, leaf = np.append(row, which[b]), np.append(leaf, k)
            row, leaf = np.append(row, np.arange(len(la))), np.append(leaf, home)
            both = np.unique(row.astype(np.int64) * len(tree.starts) + leaf)
            row, leaf = both // len(tree.starts), (both % len(tree.starts)).astype(np.int32)
            k = tree.salts[leaf]
            part = _salt(batch.column("id").take(pa.array(row)), k)
            again = np.repeat(np.arange(len(row)), k)
            other = (np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)).astype(np.int32)
            row, leaf, part = row[again], leaf[again], part[again]
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(home[row] == leaf), pa.array(leaf), pa.array(part), pa.array(np.minimum(part, other)), pa.array(np.maximum(part, other))],
                names=["id", "grp", "lat", "lon", "home", "leaf", "part", "u", "v"],
            )

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if t.num_rows < 2:
            return
        u, v = key[1].as_py(), key[2].as_py()
        t = t.take(pc.sort_indices(t, [("id", "ascending"), ("home", "descending")]))
        la, lo = t.column("lat").to_numpy(), t.column("lon").to_numpy()
        ids = t.column("id").combine_chunks()
        code = ids.dictionary_encode().indices.to_numpy()  # sorted by byte, so codes compare as ids
        grp = t.column("grp").combine_chunks().fill_null("\x00").dictionary_encode().indices.to_numpy()
        home = t.column("home").to_numpy()
        part = t.column("part").to_numpy()
        lo0 = np.mod(lo - lo[0] + 180.0, 360.0) - 180.0  # the leaf lies around its first point, across the 180th meridian too
        tree_ = RTree(lo0, la, lo0, la)
        seek = np.flatnonzero(home)
        s, w, n, e = _box(la[seek], lo0[seek], radius_m)
        turns = (0.0, 360.0, -360.0) if (w < -180).any() or (e > 180).any() else (0.0,)
        for turn in turns:
            for q, k in tree_.probe(w + turn, s, e + turn, n):
                a = seek[q]
                keep = (code[a] < code[k]) & (grp[a] != grp[k])
                if u != v:  # pairs within a part belong to its own group
                    keep &= part[a] != part[k]
                a, k = a[keep], k[keep]
                keep = _metres(la[a], lo[a], la[k], lo[k]) <= radius_m
                both = np.unique(np.stack([code[a[keep]], code[k[keep]]]), axis=1) if keep.any() else np.zeros((2, 0), np.int64)
                if both.shape[1]:
                    first = np.unique(code, return_index=True)[1]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[both[0]])), ids.take(pa.array(first[both[1]]))], names=["id_a", "id_b"])

    rows = _clean(points, id_col, lat, lon, F.col(group_col).cast("string").alias("grp"))
    spread = rows.mapInArrow(assign, schema)
    return spread.groupBy("leaf", "u", "v").applyInArrow(pairs, "id_a string, id_b string")


def _rings(parts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lat, lon) of each ring that has three corners or more, unwrapped along its edges so that no edge is longer
    than half the way round; rings that don't close that way (around a pole) and broken corners are left out."""
    out = []
    for ring in parts:
        corners = [(c["lat"], c["lon"]) for c in ring or [] if c and c["lat"] is not None and c["lon"] is not None]
        if len(corners) < 3 or not np.isfinite(corners).all():
            continue
        la, lo = np.array(corners, np.float64).T
        if la[0] == la[-1] and lo[0] == lo[-1]:
            la, lo = la[:-1], lo[:-1]
        step = np.mod(np.diff(lo, append=lo[0]) + 180.0, 360.0) - 180.0
        if len(la) >= 3 and abs(step.sum()) < 1e-6:
            out.append((la, lo[0] + np.concatenate([[0.0], np.cumsum(step[:-1])])))
    return out


def _inside(la: np.ndarray, lo: np.ndarray, rings: list[tuple[np.ndarray, np.ndarray]], at: float) -> np.ndarray:
    """Even-odd rule over all rings; longitudes count around `at`."""
    odd = np.zeros(len(la), bool)
    x = at + np.mod(lo - at + 180.0, 360.0) - 180.0
    for ra, ro in rings:
        ro = ro + 360.0 * np.round((at - ro.mean()) / 360.0)
        for (a1, o1), (a2, o2) in zip(zip(ra, ro), zip(np.roll(ra, -1), np.roll(ro, -1))):
            if a1 != a2:
                cross = (a1 > la) != (a2 > la)
                odd ^= cross & (x < (o2 - o1) * (la - a1) / (a2 - a1) + o1)
    return odd


def in_zones(points: DataFrame, id_col: str, lat: str, lon: str, zones: DataFrame, zone_id: str = "zone_id", ring: str = "ring", hole: str | None = "hole", block: int = 150_000) -> DataFrame:
    """(id, zone_id) of all points inside a zone: within its ring and not within its hole.

    Edges are straight in degrees and take the short way across the 180th meridian; rings may be open or closed, in
    either direction, and of any shape (even-odd rule). A zone with a null id or without a ring of three sound corners
    holds nothing; a broken hole is no hole. Points with a null id or an unusable position lie nowhere. Rows of the
    result are distinct as long as an id has one position. No points or no zones give no rows.
    """
    tree = build_quadtree(points, lat, lon, 30.0, block)
    shape = "array<struct<lat double, lon double>>"
    areas = zones.where(F.col(zone_id).isNotNull()).select(
        F.col(zone_id).cast("string").alias("zone_id"), F.col(ring).cast(shape).alias("ring"), (F.col(hole).cast(shape) if hole else F.lit(None).cast(shape)).alias("hole")
    )

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, r[0]) for i, x in enumerate(batch.column("ring").to_pylist()) if (r := _rings([x]))]
            if not rows:
                continue
            s, w, n, e = (np.array([f(r[k]) for _, r in rows]) for k, f in ((0, np.min), (1, np.min), (0, np.max), (1, np.max)))
            box, leaf = tree.touched(s, w, n, e)
            k = tree.salts[leaf]
            row = np.repeat(np.array([i for i, _ in rows])[box], k)
            part = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(row)).columns, pa.array(np.repeat(leaf, k)), pa.array(part.astype(np.int32))],
                names=["zone_id", "ring", "hole", "leaf", "part"],
            )

    covered = areas.mapInArrow(cover, f"zone_id string, ring {shape}, hole {shape}, leaf int, part int")
    has = np.zeros(len(tree.starts), bool)
    has[[r.leaf for r in covered.select("leaf").distinct().collect()]] = True  # as many rows as the tree has leaves, at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf(batch.column("lat").to_numpy(zero_copy_only=False), batch.column("lon").to_numpy(zero_copy_only=False))
            keep = np.flatnonzero(has[leaf])
            out, leaf = batch.take(pa.array(keep)), leaf[keep]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leaf), pa.array(_salt(out.column("id"), tree.salts[leaf]))], names=["id", "lat", "lon", "leaf", "part"])

    def contained(own: pa.Table, near: pa.Table) -> pa.Table:
        found_p, found_z = [], []
        if own.num_rows and near.num_rows:
            la, lo = own.column("lat").to_numpy(), own.column("lon").to_numpy()
            shapes = [(_rings([r]), _rings([h])) for r, h in zip(near.column("ring").to_pylist(), near.column("hole").to_pylist())]
            s, w, n, e = (np.array([f(r[0][k]) for r, _ in shapes]) for k, f in ((0, np.min), (1, np.min), (0, np.max), (1, np.max)))
            boxes = RTree(w, s, e, n)
            for turn in (0.0, 360.0, -360.0):
                for q, z in boxes.probe(lo + turn, la, lo + turn, la):
                    for one in np.unique(z):
                        rings, holes = shapes[one]
                        p = q[z == one]
                        at = rings[0][1].mean()
                        p = p[_inside(la[p], lo[p], rings, at) & ~_inside(la[p], lo[p], holes, at)]
                        found_p.append(p)
                        found_z.append(np.full(len(p), one))
        p = np.concatenate(found_p) if found_p else np.zeros(0, np.int64)
        z = np.concatenate(found_z) if found_z else np.zeros(0, np.int64)
        out = pa.table({"id": own.column("id").take(pa.array(p)), "zone_id": near.column("zone_id").take(pa.array(z))})
        return out.group_by(["id", "zone_id"], use_threads=False).aggregate([])

    spread = _clean(points, id_col, lat, lon).mapInArrow(assign, "id string, lat double, lon double, leaf int, part int")
    return spread.groupBy("leaf", "part").cogroup(covered.groupBy("leaf", "part")).applyInArrow(contained, "id string, zone_id string")
