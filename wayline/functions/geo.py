"""Spherical geodesy and box geometry as Column expressions; no function here leaves the JVM.

Angles are degrees, lengths metres, on a sphere of radius EARTH_RADIUS_M. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
#: Edge of the uniform grid used for road lookups, in degrees.
GRID_DEG = 0.005
#: Metres of a Web-Mercator pixel at zoom 0 on the equator, tiles of 256 pixels.
MERCATOR_M_PER_PX = 156543.03392


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def _known(expr: Column, *inputs) -> Column:
    """expr, null if any input is: least and greatest inside of it would pass over nulls."""
    ok = F.lit(True)
    for x in inputs:
        if not isinstance(x, (int, float)):
            ok &= _c(x).isNotNull()
    return F.when(ok, expr)


def usable(lat, lon) -> Column:
    """Both present, numbers in range, not both 0. Never null."""
    lat, lon = _c(lat), _c(lon)
    ok = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(ok & ~((lat == 0.0) & (lon == 0.0)), F.lit(False))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return _known(_haversine(lat1, lon1, lat2, lon2), lat1, lon1, lat2, lon2)


def _haversine(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def normalize_bearing(deg) -> Column:
    return F.pmod(_c(deg), F.lit(360.0))


def initial_bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return normalize_bearing(F.degrees(F.atan2(east, north)))


def destination_point(lat, lon, bearing_deg, distance_m) -> Column:
    """struct(lat, lon), lon in [-180, 180)."""
    lat, lon, b, d = map(_c, (lat, lon, bearing_deg, distance_m))
    p, a, th = F.radians(lat), d / EARTH_RADIUS_M, F.radians(b)
    s = F.sin(p) * F.cos(a) + F.cos(p) * F.sin(a) * F.cos(th)
    p2 = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))
    dl = F.atan2(F.sin(th) * F.sin(a) * F.cos(p), F.cos(a) - F.sin(p) * s)
    return F.struct(
        _known(F.degrees(p2), lat, b, d).alias("lat"),
        (F.pmod(lon + F.degrees(dl) + 540.0, F.lit(360.0)) - 180.0).alias("lon"),
    )


def bearing_difference_deg(a, b) -> Column:
    """Smallest angle between two bearings, in [0, 180]."""
    d = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.least(d, 360.0 - d)  # both null or none


def interpolate_bearing(a, b, fraction) -> Column:
    """From a towards b over the shorter arc."""
    a, b, f = map(_c, (a, b, fraction))
    return normalize_bearing(a + (F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0) * f)


def interpolate(a, b, fraction) -> Column:
    a, b, f = map(_c, (a, b, fraction))
    return a + (b - a) * f


def normalize_lon(lon) -> Column:
    """In [-180, 180)."""
    return F.pmod(_c(lon) + 540.0, F.lit(360.0)) - 180.0


def interpolate_lon(a, b, fraction) -> Column:
    """From a towards b the short way, across the 180th meridian too; straight where the plain way is the short one."""
    a, b, f = map(_c, (a, b, fraction))
    return F.when(F.abs(b - a) <= 180.0, a + (b - a) * f).otherwise(normalize_lon(a + (F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0) * f))


def cross_track_distance_m(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Distance to the unbounded great circle through two points."""
    return _known(_cross_track(lat, lon, lat1, lon1, lat2, lon2), lat, lon, lat1, lon1, lat2, lon2)


def _cross_track(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    d = _haversine(lat1, lon1, lat, lon) / EARTH_RADIUS_M
    turn = F.radians(initial_bearing_deg(lat1, lon1, lat, lon) - initial_bearing_deg(lat1, lon1, lat2, lon2))
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d) * F.sin(turn)))
    return F.abs(F.asin(x)) * EARTH_RADIUS_M


def along_track(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Signed metres from the segment's start to the foot of the perpendicular."""
    return _known(_along_track(lat, lon, lat1, lon1, lat2, lon2), lat, lon, lat1, lon1, lat2, lon2)


def _along_track(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    d = _haversine(lat1, lon1, lat, lon) / EARTH_RADIUS_M
    turn = F.radians(initial_bearing_deg(lat1, lon1, lat, lon) - initial_bearing_deg(lat1, lon1, lat2, lon2))
    xt = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d) * F.sin(turn))))
    ratio = F.when(F.abs(F.cos(xt)) < 1e-15, F.lit(0.0)).otherwise(F.cos(d) / F.cos(xt))
    a = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    return F.when(F.cos(turn) < 0, -a).otherwise(a) * EARTH_RADIUS_M


def with_projection(df: DataFrame, lat, lon, lat1, lon1, lat2, lon2) -> DataFrame:
    """df with distance_m, along_m and fraction of the nearest point of a segment to a point, and the segment's
    bearing_deg and length_m. In steps of named columns, each computed once: as one expression the same terms would be
    repeated until the generated code gets too large."""
    r = EARTH_RADIUS_M
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    # rows without a coordinate have no distance; callers join on cells, which drops them
    df = df.withColumns({
        "length_m": _haversine(lat1, lon1, lat2, lon2), "_start": _haversine(lat, lon, lat1, lon1), "_end": _haversine(lat, lon, lat2, lon2),
        "bearing_deg": initial_bearing_deg(lat1, lon1, lat2, lon2), "_to": initial_bearing_deg(lat1, lon1, lat, lon),
    })
    df = df.withColumns({"_d": F.col("_start") / r, "_turn": F.radians(F.col("_to") - F.col("bearing_deg"))})
    df = df.withColumn("_x", F.asin(clip(F.sin("_d") * F.sin("_turn"))))
    ahead = F.acos(clip(F.cos("_d") / F.cos("_x"))) * F.when(F.cos("_turn") < 0, -r).otherwise(r)
    df = df.withColumn("_a", F.when((F.col("length_m") == 0) | (F.col("_start") == 0) | (F.abs(F.cos("_x")) < 1e-15), F.lit(0.0)).otherwise(ahead))
    df = df.withColumns({
        "distance_m": F.when(F.col("_a") <= 0, F.col("_start")).when(F.col("_a") >= F.col("length_m"), F.col("_end")).otherwise(F.abs("_x") * r),
        "along_m": F.greatest(F.lit(0.0), F.least("_a", "length_m")),
    })
    return df.withColumn("fraction", F.when(F.col("length_m") == 0, F.lit(0.0)).otherwise(F.col("along_m") / F.col("length_m"))).drop("_start", "_end", "_to", "_d", "_turn", "_x", "_a")


def project_onto_segment(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """struct(distance_m, along_m, fraction) as one expression; see with_projection for many rows."""
    lat, lon, lat1, lon1, lat2, lon2 = map(_c, (lat, lon, lat1, lon1, lat2, lon2))
    length, at_start = _haversine(lat1, lon1, lat2, lon2), _haversine(lat, lon, lat1, lon1)
    along = F.when((length == 0.0) | (at_start == 0.0), F.lit(0.0)).otherwise(_along_track(lat, lon, lat1, lon1, lat2, lon2))
    distance = F.when(along <= 0, at_start).when(along >= length, _haversine(lat, lon, lat2, lon2)).otherwise(_cross_track(lat, lon, lat1, lon1, lat2, lon2))
    kept = F.greatest(F.lit(0.0), F.least(along, length))
    out = F.struct(distance.alias("distance_m"), kept.alias("along_m"), F.when(length == 0.0, F.lit(0.0)).otherwise(kept / length).alias("fraction"))
    return _known(out, lat, lon, lat1, lon1, lat2, lon2)


def point_to_segment_distance_m(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    return project_onto_segment(lat, lon, lat1, lon1, lat2, lon2)["distance_m"]


def bounding_box(lat, lon, radius_m) -> Column:
    """struct(min_lat, min_lon, max_lat, max_lon), clamped to the map, whole width at a pole."""
    lat, lon, r = map(_c, (lat, lon, radius_m))
    dlat = F.degrees(r / EARTH_RADIUS_M)
    c = F.cos(F.radians(lat))
    dlon = F.when(F.abs(c) < 1e-9, F.lit(180.0)).otherwise(F.degrees(r / (EARTH_RADIUS_M * c)))
    return F.struct(
        _known(F.greatest(F.lit(-90.0), lat - dlat), lat, r).alias("min_lat"),
        _known(F.greatest(F.lit(-180.0), lon - dlon), lat, lon, r).alias("min_lon"),
        _known(F.least(F.lit(90.0), lat + dlat), lat, r).alias("max_lat"),
        _known(F.least(F.lit(180.0), lon + dlon), lat, lon, r).alias("max_lon"),
    )


def extent(df: DataFrame, key: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(*key, min_lat, max_lat, min_lon, max_lon) of usable positions. Where the way over the 180th meridian is the
    narrower one, min_lon is east of it and max_lon west, so that min_lon > max_lon."""
    turned = F.when(F.col(lon) < 0, F.col(lon) + 360.0).otherwise(F.col(lon))
    e = df.groupBy(*key).agg(F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("a"), F.max(lon).alias("b"), F.min(turned).alias("c"), F.max(turned).alias("d"))
    back = lambda x: F.col(x) - F.when(F.col(x) >= 180.0, 360.0).otherwise(0.0)
    over = F.col("d") - F.col("c") < F.col("b") - F.col("a")
    return e.select(*key, "min_lat", "max_lat", F.when(over, back("c")).otherwise(F.col("a")).alias("min_lon"), F.when(over, back("d")).otherwise(F.col("b")).alias("max_lon"))


def box_area(x1, y1, x2, y2) -> Column:
    return (_c(x2) - _c(x1)) * (_c(y2) - _c(y1))


def box_center(x1, y1, x2, y2) -> Column:
    return F.struct(((_c(x1) + _c(x2)) / 2).alias("x"), ((_c(y1) + _c(y2)) / 2).alias("y"))


def ground_contact(x1, y1, x2, y2) -> Column:
    """Middle of the lower edge."""
    return F.struct(((_c(x1) + _c(x2)) / 2).alias("x"), _c(y2).alias("y"))


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Intersection over union, 0 unless the boxes strictly overlap."""
    a = tuple(map(_c, (ax1, ay1, ax2, ay2)))
    b = tuple(map(_c, (bx1, by1, bx2, by2)))
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = w * h
    return _known(F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(inter / (box_area(*a) + box_area(*b) - inter)), *a, *b)


def region_contains(x, y, horizon=0.45, bonnet=0.05, near=(0.0, 1.0), far=(0.35, 0.65)) -> Column:
    """Is a point (fractions of the frame) in the road trapezoid between horizon and bonnet? Edges count."""
    x, y = _c(x), _c(y)
    bottom = 1.0 - bonnet
    f = (y - horizon) / (bottom - horizon)
    left = far[0] + (near[0] - far[0]) * f
    right = far[1] + (near[1] - far[1]) * f
    return (y >= horizon) & (y <= bottom) & (x >= left) & (x <= right)


def region_accepts(x1, y1, x2, y2, width, height, **region) -> Column:
    """region_contains for the ground contact of a box in pixels; frames of unknown size accept."""
    w, h = _c(width), _c(height)
    p = ground_contact(x1, y1, x2, y2)
    known = w.isNotNull() & h.isNotNull() & (w > 0) & (h > 0)
    return F.when(~known, F.lit(True)).otherwise(region_contains(p["x"] / w, p["y"] / h, **region))


def expanded_region(x1, y1, x2, y2, margin, width, height) -> Column:
    """A box grown by a share of its own size on every side, within the frame."""
    x1, y1, x2, y2, m, w, h = map(_c, (x1, y1, x2, y2, margin, width, height))
    dx, dy = (x2 - x1) * m, (y2 - y1) * m
    return F.struct(
        _known(F.greatest(F.lit(0.0), x1 - dx), x1, x2).alias("x1"),
        _known(F.greatest(F.lit(0.0), y1 - dy), y1, y2).alias("y1"),
        _known(F.least(w, x2 + dx), x1, x2, w).alias("x2"),
        _known(F.least(h, y2 + dy), y1, y2, h).alias("y2"),
    )


def grid_cell(deg, size: float = GRID_DEG) -> Column:
    return F.floor(_c(deg) / size).cast("long")


def cells_spanned(a, b, size: float = GRID_DEG) -> Column:
    """array<long> of all cells between two coordinates."""
    return _known(F.sequence(grid_cell(F.least(_c(a), _c(b)), size), grid_cell(F.greatest(_c(a), _c(b)), size)), a, b)


def lon_cells_spanned(a, b, size: float = GRID_DEG) -> Column:
    """array<long> of all cells from longitude a eastwards to b, which may leave [-180, 180]; cells are those of
    longitudes in [-180, 180), so a range over the 180th meridian goes on at its other side."""
    n = round(360.0 / size)
    first, last = grid_cell(a, size), grid_cell(b, size)
    return F.when(last - first >= n, F.sequence(F.lit(-(n // 2)).cast("long"), F.lit(n - n // 2 - 1).cast("long"))).otherwise(F.transform(F.sequence(first, last), lambda c: F.pmod(c + n // 2, F.lit(n)) - n // 2))


def estimated_spacing_m(speed_mps, fps) -> Column:
    s, f = _c(speed_mps), _c(fps)
    return F.when(f > 0, s / f)


def pixels_per_metre(lat, zoom) -> Column:
    """Web-Mercator pixels (256 px tiles) per ground metre."""
    return F.pow(F.lit(2.0), _c(zoom)) / (MERCATOR_M_PER_PX * F.cos(F.radians(_c(lat))))


def ring_radius_px(lat, zoom, uncertainty_m, least: float = 4.0) -> Column:
    return _known(F.greatest(F.lit(least), _c(uncertainty_m) * pixels_per_metre(lat, zoom)), uncertainty_m, lat, zoom)
