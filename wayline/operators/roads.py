"""Road segments, and matching points to the street they lie on."""

from __future__ import annotations

from dataclasses import dataclass
from math import degrees

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geo

#: Highway values that are driven on; fixed values.
DRIVABLE = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road",
)


@dataclass(frozen=True)
class MatchingConfig:
    max_distance_m: float = 20.0
    uncertainty_multiplier: float = 2.0
    min_radius_m: float = 15.0
    max_heading_deg: float = 55.0
    penalty_m_per_deg: float = 0.15
    ambiguity_m: float = 4.0
    require_named: bool = False


def oneway(tag: Column, junction: Column) -> Column:
    """struct(oneway, reverse) of a way's tags."""
    t, j = F.lower(F.trim(F.coalesce(tag, F.lit("")))), F.lower(F.trim(F.coalesce(junction, F.lit(""))))
    return F.struct(
        F.when(t.isin("yes", "true", "1", "-1"), True).when(t.isin("no", "false", "0"), False).otherwise(j.isin("roundabout", "circular")).alias("oneway"),
        (t == "-1").alias("reverse"),
    )


def segments_of_ways(ways: DataFrame) -> DataFrame:
    """One row for each pair of successive vertices of `ways` (way_id, name, highway, oneway_tag, junction, points
    array<struct<lat, lon>>). Drivable ways only; pairs without length are dropped but keep their number; oneway=-1
    turns the geometry round. Points without coordinates are left out first."""
    rows = ways.where(F.lower("highway").isin(*DRIVABLE)).withColumn("w", oneway(F.col("oneway_tag"), F.col("junction")))
    p = F.filter("points", lambda x: x["lat"].isNotNull() & x["lon"].isNotNull())
    rows = rows.withColumn("p", F.when(F.col("w.reverse"), F.reverse(p)).otherwise(p)).where(F.size("p") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(i.alias("i"), F.get("p", i).alias("a"), F.get("p", i + 1).alias("b")))
    s = rows.select("way_id", F.nullif(F.col("name"), F.lit("")).alias("name"), "highway", "w.oneway", F.inline(pairs)).where("a.lat <> b.lat or a.lon <> b.lon")
    return s.select(
        F.concat(F.lit("way/"), "way_id", F.lit("#"), "i").alias("segment_id"), F.concat(F.lit("way/"), "way_id").alias("way_id"), F.col("i").cast("long").alias("seg_ord"),
        F.col("a.lat").alias("a_lat"), F.col("a.lon").alias("a_lon"), F.col("b.lat").alias("b_lat"), F.col("b.lon").alias("b_lon"), "name", "highway", "oneway",
    )


def with_geometry(segments: DataFrame) -> DataFrame:
    """Segments with bearing_deg and length_m."""
    ends = ("a_lat", "a_lon", "b_lat", "b_lon")
    return segments.withColumn("bearing_deg", geo.initial_bearing_deg(*ends)).withColumn("length_m", geo.haversine_m(*ends))


def street_key(name: Column, way_id: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("name:"), name)).otherwise(F.concat(F.lit("way:"), way_id))


def heading_delta(heading: Column, bearing: Column, is_oneway: Column) -> Column:
    """Folded to [0, 90] unless the segment is one-way; null without a heading."""
    d = geo.bearing_difference_deg(heading, bearing)
    return F.when(is_oneway, d).otherwise(F.least(d, 180.0 - d))


#: Edge of the cells in which points and segments meet, in degrees: about what a segment is long.
MEET_DEG = 0.001


def _meeting_cells(points: DataFrame, segments: DataFrame, reach_m: float) -> tuple[DataFrame, DataFrame]:
    """Both with cell_lat, cell_lon: a point once, in its own cell; a segment in all cells around it, piece by piece,
    in which points within reach_m of it may lie. So a pair meets once at most."""
    at = points.withColumns({"cell_lat": geo.grid_cell("p_lat", MEET_DEG), "cell_lon": geo.grid_cell(geo.normalize_lon("p_lon"), MEET_DEG)})
    east = F.pmod(F.col("b_lon") - F.col("a_lon") + 540.0, F.lit(360.0)) - 180.0
    rise = F.col("b_lat") - F.col("a_lat")
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(east), F.abs(rise)) / MEET_DEG)).cast("long")
    # a great circle leaves the straight line in degrees by at most an eighth of its length squared
    lat_pad = degrees(reach_m / geo.EARTH_RADIUS_M) * 1.01 + F.degrees(F.pow(F.radians(east), 2) / 8)
    lon_pad = F.least(F.lit(180.0), lat_pad / F.greatest(F.lit(1e-9), F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs("a_lat"), F.abs("b_lat")) + lat_pad)))))
    cut = segments.withColumns({"_east": east, "_rise": rise, "_n": n, "_lat_pad": lat_pad, "_lon_pad": lon_pad})

    def piece(i: Column) -> Column:
        ends = lambda start, step: [F.col(start) + F.col(step) * (i + k) / F.col("_n") for k in (0, 1)]
        (la0, la1), (lo0, lo1) = ends("a_lat", "_rise"), ends("a_lon", "_east")
        lats = geo.cells_spanned(F.least(la0, la1) - F.col("_lat_pad"), F.greatest(la0, la1) + F.col("_lat_pad"), MEET_DEG)
        lons = geo.lon_cells_spanned(F.least(lo0, lo1) - F.col("_lon_pad"), F.greatest(lo0, lo1) + F.col("_lon_pad"), MEET_DEG)
        return F.flatten(F.transform(lats, lambda x: F.transform(lons, lambda y: F.struct(x.alias("cell_lat"), y.alias("cell_lon")))))

    cells = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), piece)))
    return at, cut.withColumn("_cell", F.explode(cells)).select(*segments.columns, "_cell.*")


def match_points(points: DataFrame, segments: DataFrame, config: MatchingConfig = MatchingConfig()) -> DataFrame:
    """(point_id, reason, segment_id, way_id, name, lat, lon, match_distance_m, heading_delta_deg, uncertainty_m), one
    row for each row of `points` (point_id unique, lat, lon, uncertainty_m, heading_deg).

    Candidates are the segments within max_distance_m that share a cell of a uniform grid of 0.005 degrees with the
    point's search box. They are found in finer cells, a segment's own degree box sorts out most of the rest, and only
    what is left pays for trigonometry. The best by distance plus heading penalty wins (ties: the smaller segment id),
    unless another street is nearly as good. reason: matched, ambiguous, heading_mismatch or no_candidates; an
    unmatched point keeps its position.
    """
    c = config
    radius = F.least(F.lit(c.max_distance_m), F.greatest(F.lit(c.min_radius_m), F.coalesce("uncertainty_m", F.lit(0.0)) * c.uncertainty_multiplier))
    near = points.select("point_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "heading_deg", radius.alias("radius"))
    roads = segments.select("segment_id", "way_id", "name", "oneway", "a_lat", "a_lon", "b_lat", "b_lon")
    if c.require_named:
        roads = roads.where("coalesce(name, '') <> ''")
    near, roads = _meeting_cells(near, roads, c.max_distance_m)
    ends = ("a_lat", "a_lon", "b_lat", "b_lon")
    # the segment's own box, widened by what counts
    east, off = (F.pmod(F.col(x) - F.col("a_lon") + 540.0, F.lit(360.0)) - 180.0 for x in ("b_lon", "p_lon"))
    lat_pad = degrees(c.max_distance_m / geo.EARTH_RADIUS_M) * 1.01 + F.degrees(F.pow(F.radians(east), 2) / 8)
    lon_pad = lat_pad / F.greatest(F.lit(1e-9), F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs("a_lat"), F.abs("b_lat")) + lat_pad))))
    zero = F.lit(0.0)
    inside = F.col("p_lat").between(F.least("a_lat", "b_lat") - lat_pad, F.greatest("a_lat", "b_lat") + lat_pad) & off.between(F.least(zero, east) - lon_pad, F.greatest(zero, east) + lon_pad)
    # the uniform grid: does the search box touch one of the segment's cells?
    reach = F.degrees(F.col("radius") / geo.EARTH_RADIUS_M)
    wide = reach / F.greatest(F.lit(1e-9), F.cos(F.radians("p_lat")))
    touch = lambda lo, hi, p, r: (geo.grid_cell(p - r) <= geo.grid_cell(hi)) & (geo.grid_cell(p + r) >= geo.grid_cell(lo))
    plain = F.abs(F.col("b_lon") - F.col("a_lon")) <= 180.0
    west, most = F.when(plain, F.least("a_lon", "b_lon")).otherwise(F.col("a_lon") + F.least(zero, east)), F.when(plain, F.greatest("a_lon", "b_lon")).otherwise(F.col("a_lon") + F.greatest(zero, east))
    p_lon = F.when(F.abs(F.col("p_lon") - F.col("a_lon")) <= 180.0, F.col("p_lon")).otherwise(F.col("a_lon") + off)
    grid = touch(F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat"), F.col("p_lat"), reach) & touch(west, most, p_lon, wide)
    met = near.join(roads, ["cell_lat", "cell_lon"]).where(inside & grid).drop("radius")
    met = geo.with_projection(met, "p_lat", "p_lon", *ends).where(F.col("distance_m") <= c.max_distance_m)
    met = met.withColumn("delta", heading_delta(F.col("heading_deg"), F.col("bearing_deg"), F.col("oneway"))).withColumn("wrong", F.coalesce(F.col("delta") > c.max_heading_deg, F.lit(False)))
    score = F.col("distance_m") + F.coalesce(F.col("delta") * c.penalty_m_per_deg, F.lit(0.0))
    cand = F.struct(score.alias("score"), "segment_id", "way_id", "name", "distance_m", "delta", "along_m", "fraction", "bearing_deg", *ends)
    # the best of each street, then the best two streets: only aggregates, nothing is collected
    streets = met.groupBy("point_id", street_key(F.col("name"), F.col("way_id")).alias("street")).agg(F.min(F.when(~F.col("wrong"), cand)).alias("best"), F.bool_or("wrong").alias("wrong"))
    w = Window.partitionBy("point_id").orderBy(F.col("best.score").asc_nulls_last(), "best.segment_id")
    top = streets.withColumn("rival", F.lead("best.score").over(w)).withColumn("any_wrong", F.bool_or("wrong").over(Window.partitionBy("point_id"))).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    out = points.select("point_id", "lat", "lon", "uncertainty_m").join(top.select("point_id", "best", "rival", "any_wrong"), "point_id", "left")
    b = F.col("best")
    reason = (
        F.when(b.isNotNull() & F.coalesce(F.col("rival") - b["score"] < c.ambiguity_m, F.lit(False)), "ambiguous").when(b.isNotNull(), "matched").when(F.coalesce("any_wrong", F.lit(False)), "heading_mismatch").otherwise("no_candidates")
    )
    out = out.withColumn("reason", reason)
    ok = F.col("reason") == "matched"
    take = lambda x: F.when(ok, x)
    # the foot of the winner only
    out = out.withColumn("foot", F.when(ok & (b["fraction"] > 0) & (b["fraction"] < 1), geo.destination_point(b["a_lat"], b["a_lon"], b["bearing_deg"], b["along_m"])))
    foot = lambda k: F.coalesce(F.col("foot")[k], F.when(ok & (b["fraction"] >= 1), b[f"b_{k}"]), take(b[f"a_{k}"]), F.col(k))
    return out.select(
        "point_id", "reason", take(b["segment_id"]).alias("segment_id"), take(b["way_id"]).alias("way_id"), take(b["name"]).alias("name"), foot("lat").alias("lat"), foot("lon").alias("lon"),
        take(F.round(b["distance_m"], 3)).alias("match_distance_m"), take(F.round(b["delta"], 2)).alias("heading_delta_deg"),
        F.when(ok, F.round(F.greatest("uncertainty_m", b["distance_m"]), 3)).otherwise(F.col("uncertainty_m")).alias("uncertainty_m"),
    )


def match_defects(defects: DataFrame, segments: DataFrame, headings: DataFrame | None = None, config: MatchingConfig = MatchingConfig()) -> DataFrame:
    """defects with `match_reason` and, where they matched, the segment, way and name of their street and their place on
    it. `headings` (defect_id, heading_deg) are those of their frames. A place that a reviewer has corrected is never
    touched: skipped_manual."""
    manual = F.coalesce(F.col("location_method") == "manual_correction", F.lit(False))
    rows = defects.where(~manual)
    rows = rows.join(headings.select("defect_id", "heading_deg"), "defect_id", "left") if headings is not None else rows.withColumn("heading_deg", F.lit(None).cast("double"))
    found = match_points(rows.select(F.col("defect_id").alias("point_id"), "lat", "lon", "uncertainty_m", "heading_deg"), segments, config)
    m = found.select(F.col("point_id").alias("defect_id"), F.col("reason").alias("match_reason"), *[F.col(c).alias(f"_{c}") for c in ("segment_id", "way_id", "name", "lat", "lon", "uncertainty_m", "match_distance_m", "heading_delta_deg")])
    out = defects.join(m, "defect_id", "left").withColumn("match_reason", F.coalesce("match_reason", F.lit("skipped_manual")))
    ok = F.col("match_reason") == "matched"
    moved = {c: F.when(ok, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("lat", "lon", "uncertainty_m")}
    moved["segment_id"] = F.when(ok, F.col("_segment_id")).otherwise(F.col("segment_id") if "segment_id" in defects.columns else F.lit(None).cast("string"))
    moved["location_method"] = F.when(ok, "road_segment_matched").otherwise(F.col("location_method"))
    return out.withColumns({**moved, "way_id": F.col("_way_id"), "road_name": F.col("_name"), "match_distance_m": F.col("_match_distance_m"), "heading_delta_deg": F.col("_heading_delta_deg")}).drop(*[c for c in m.columns if c.startswith("_")])


def match_counts(matched: DataFrame) -> DataFrame:
    """(reason, n) of match_defects, matched_named for those on a named street besides."""
    named = matched.where((F.col("match_reason") == "matched") & (F.coalesce("road_name", F.lit("")) != "")).select(F.lit("matched_named").alias("reason"))
    return matched.select(F.col("match_reason").alias("reason")).unionByName(named).groupBy("reason").agg(F.count("*").alias("n"))


def named_streets(segments: DataFrame) -> DataFrame:
    return segments.where("coalesce(name, '') <> ''").groupBy("name").agg(F.count("*").alias("n_segments"))


def points_near(points: DataFrame, id_col: str, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Rows within radius_m of one place, nearest first. The box is a plain range, so it is pushed to the scan."""
    from math import cos, degrees, radians

    dlat = degrees(radius_m / geo.EARTH_RADIUS_M)
    k = cos(radians(lat))
    dlon = 180.0 if abs(k) < 1e-9 else degrees(radius_m / (geo.EARTH_RADIUS_M * k))
    box = points.where(F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon))
    return box.withColumn("distance_m", geo.haversine_m("lat", "lon", lat, lon)).where(F.col("distance_m") <= radius_m).orderBy("distance_m", id_col)
