"""Queries of the survey operators and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline import schema
from wayline.functions import geo, misc
from wayline.operators import clustering, detect, evaluate, pixels, roads, rollup, store, track, tracking, training
from wayline.plans.process import process
from wayline.plans.projections import DEFECTS, DRIVEN, SEGMENTS, project
from wayline.session import checkpoint, table
from wayline.sources import annotations as notes
from wayline.sources import export

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL building blocks, with coordinates as lat, lon, lat, lon


def hav(a: str, b: str, c: str, d: str) -> str:
    """Null if any is: least() alone would pass over a null and give half the way round."""
    s = f"sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
    return f"(CASE WHEN ({a}) IS NULL OR ({c}) IS NULL OR ({b}) IS NULL OR ({d}) IS NULL THEN NULL ELSE 2 * 6371008.8e0 * asin(least(1e0, {s})) END)"


def brg(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b})))))"
    return f"((({x}) % 360 + 360) % 360)"


def bdiff(a: str, b: str) -> str:
    d = f"((({a}) - ({b})) % 360 + 360) % 360"
    return f"least({d}, 360 - ({d}))"


USABLE = "coalesce({0} BETWEEN -90 AND 90 AND {1} BETWEEN -180 AND 180 AND NOT isnan({0}) AND NOT isnan({1}) AND NOT ({0} = 0 AND {1} = 0), FALSE)"
GOOD_FIX = USABLE.format("lat", "lon")
BIG = lambda c: c.cast("long")


# --- geodesy


@query(f"""
    SELECT observation_id, round({hav("lat", "lon", "lat + 0.01", "lon + 0.02")}, 3) AS distance_m, round({brg("lat", "lon", "lat + 0.01", "lon + 0.02")}, 4) AS bearing_deg,
        round({bdiff("confidence * 720", "350e0")}, 4) AS difference_deg,
        round(((350e0 + (((confidence * 360 - 350 + 540) % 360 + 360) % 360 - 180) * 0.25) % 360 + 360) % 360, 4) AS between_deg
    FROM cluster_candidates WHERE {GOOD_FIX}""")
def geo_distance_bearing(spark: SparkSession, d: str) -> DataFrame:
    """G1, G2, G4, G5, G6."""
    c = table(spark, d, "cluster_candidates").where(geo.usable("lat", "lon"))
    there = (F.col("lat") + 0.01, F.col("lon") + 0.02)
    return c.select(
        "observation_id", F.round(geo.haversine_m("lat", "lon", *there), 3).alias("distance_m"), F.round(geo.initial_bearing_deg("lat", "lon", *there), 4).alias("bearing_deg"),
        F.round(geo.bearing_difference_deg(F.col("confidence") * 720, 350.0), 4).alias("difference_deg"), F.round(geo.interpolate_bearing(350.0, F.col("confidence") * 360, 0.25), 4).alias("between_deg"),
    )


@query(f"""
    WITH s AS (SELECT observation_id, lon, radians(lat) AS p, 250e0 / 6371008.8e0 AS a, radians(confidence * 360) AS th FROM cluster_candidates WHERE {GOOD_FIX}),
    q AS (SELECT *, sin(p) * cos(a) + cos(p) * sin(a) * cos(th) AS v FROM s)
    SELECT observation_id, round(degrees(asin(v)), 6) AS lat, round(((lon + degrees(atan2(sin(th) * sin(a) * cos(p), cos(a) - sin(p) * v)) + 540) % 360 + 360) % 360 - 180, 6) AS lon FROM q""")
def geo_destination(spark: SparkSession, d: str) -> DataFrame:
    """G3."""
    c = table(spark, d, "cluster_candidates").where(geo.usable("lat", "lon")).select("observation_id", geo.destination_point("lat", "lon", F.col("confidence") * 360, 250.0).alias("p"))
    return c.select("observation_id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


_SEG = ("lat - 0.001", "lon - 0.001", "lat + 0.002 * confidence", "lon + 0.001")


@query(f"""
    WITH s AS (SELECT observation_id, {hav(_SEG[0], _SEG[1], "lat", "lon")} / 6371008.8e0 AS d13, radians({brg(_SEG[0], _SEG[1], "lat", "lon")} - {brg(*_SEG)}) AS dt, {hav(*_SEG)} AS len FROM cluster_candidates WHERE {GOOD_FIX}),
    x AS (SELECT *, asin(greatest(-1e0, least(1e0, sin(d13) * sin(dt)))) AS xt FROM s),
    a AS (SELECT *, acos(greatest(-1e0, least(1e0, cos(d13) / cos(xt)))) * CASE WHEN cos(dt) < 0 THEN -1 ELSE 1 END * 6371008.8e0 AS al FROM x)
    SELECT observation_id, round(abs(xt) * 6371008.8e0, 2) AS cross_track_m, round(greatest(0e0, least(al, len)), 2) AS along_m, round(greatest(0e0, least(al, len)) / len, 4) AS fraction FROM a""")
def geo_projection(spark: SparkSession, d: str) -> DataFrame:
    """G7, G8, G9, G10."""
    c = table(spark, d, "cluster_candidates").where(geo.usable("lat", "lon"))
    seg = (F.col("lat") - 0.001, F.col("lon") - 0.001, F.col("lat") + 0.002 * F.col("confidence"), F.col("lon") + 0.001)
    names = ("s_lat", "s_lon", "e_lat", "e_lon")
    p = geo.with_projection(c.select("observation_id", "lat", "lon", *[x.alias(n) for x, n in zip(seg, names)]), "lat", "lon", *names)
    return p.select("observation_id", F.round(geo.cross_track_distance_m("lat", "lon", *names), 2).alias("cross_track_m"), F.round("along_m", 2).alias("along_m"), F.round("fraction", 4).alias("fraction"))


@query(f"""
    SELECT observation_id, round(greatest(-90e0, lat - degrees(u / 6371008.8e0)), 6) AS min_lat, round(least(90e0, lat + degrees(u / 6371008.8e0)), 6) AS max_lat,
        round(greatest(-180e0, lon - degrees(u / (6371008.8e0 * cos(radians(lat))))), 6) AS min_lon, round(least(180e0, lon + degrees(u / (6371008.8e0 * cos(radians(lat))))), 6) AS max_lon
    FROM (SELECT *, coalesce(uncertainty_m, 10e0) AS u FROM cluster_candidates) c WHERE {GOOD_FIX}""")
def geo_bounding_box(spark: SparkSession, d: str) -> DataFrame:
    """G11."""
    c = table(spark, d, "cluster_candidates").where(geo.usable("lat", "lon")).select("observation_id", geo.bounding_box("lat", "lon", F.coalesce("uncertainty_m", F.lit(10.0))).alias("b"))
    return c.select("observation_id", *[F.round(f"b.{k}", 6).alias(k) for k in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query("""
    WITH d AS (SELECT detection_id, min(frame_id) AS frame_id, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2 FROM detections GROUP BY 1),
    p AS (SELECT a.detection_id AS a_id, b.detection_id AS b_id, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h,
        (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba FROM d a JOIN d b ON a.frame_id = b.frame_id AND a.detection_id < b.detection_id)
    SELECT a_id, b_id, round(CASE WHEN w <= 0 OR h <= 0 THEN 0e0 ELSE w * h / (aa + ba - w * h) END, 4) AS iou FROM p""")
def geo_iou(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of one frame."""
    x = table(spark, d, "detections").groupBy("detection_id").agg(*[F.min(c).alias(c) for c in ("frame_id", "x1", "y1", "x2", "y2")])
    y = x.select("frame_id", F.col("detection_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    both = x.join(y, "frame_id").where("detection_id < b_id")
    return both.select(F.col("detection_id").alias("a_id"), "b_id", F.round(geo.iou("x1", "y1", "x2", "y2", "b_x1", "b_y1", "b_x2", "b_y2"), 4).alias("iou"))


@query("""
    WITH d AS (SELECT x.frame_id, x.detection_id, (x.x1 + x.x2) / 2 / f.width AS px, x.y2 / f.height AS py, f.width IS NULL OR f.height IS NULL OR f.width <= 0 OR f.height <= 0 AS unknown, x.confidence
        FROM detections x JOIN frames f ON x.frame_id = f.frame_id),
    e AS (SELECT *, (py - 0.45e0) / (0.95e0 - 0.45e0) AS k FROM d)
    SELECT frame_id, detection_id, min(CASE WHEN confidence < 0.25 THEN 'low_confidence' WHEN NOT coalesce(unknown OR (py >= 0.45e0 AND py <= 0.95e0 AND px >= 0.35e0 - 0.35e0 * k AND px <= 0.65e0 + 0.35e0 * k), FALSE) THEN 'outside_road' ELSE 'kept' END) AS reason
    FROM e GROUP BY 1, 2""")
def filter_detections(spark: SparkSession, d: str) -> DataFrame:
    """Each detection, and why those that aren't kept aren't."""
    x = table(spark, d, "detections").drop("survey_id").join(table(spark, d, "frames").select("frame_id", "width", "height"), "frame_id")
    return detect.keep_detections(x).groupBy("frame_id", "detection_id").agg(F.min(F.coalesce("reason", F.lit("kept"))).alias("reason"))


@query("""
    SELECT detection_id, min(round(greatest(0e0, x1 - (x2 - x1) * 0.15e0), 4)) AS x1, min(round(greatest(0e0, y1 - (y2 - y1) * 0.15e0), 4)) AS y1, min(round(least(1920e0, x2 + (x2 - x1) * 0.15e0), 4)) AS x2, min(round(least(1080e0, y2 + (y2 - y1) * 0.15e0), 4)) AS y2
    FROM detections GROUP BY 1""")
def geo_expanded_region(spark: SparkSession, d: str) -> DataFrame:
    """G16."""
    e = table(spark, d, "detections").select("detection_id", geo.expanded_region("x1", "y1", "x2", "y2", 0.15, 1920, 1080).alias("r"))
    return e.groupBy("detection_id").agg(*[F.min(F.round(f"r.{k}", 4)).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query(f"""SELECT CAST(floor(lat / 0.005e0) AS BIGINT) AS cell_lat, CAST(floor(lon / 0.005e0) AS BIGINT) AS cell_lon, count(*) AS n FROM location_records WHERE {GOOD_FIX} GROUP BY 1, 2""")
def geo_grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """G17, M1."""
    f = table(spark, d, "location_records").where(geo.usable("lat", "lon"))
    return f.groupBy(geo.grid_cell("lat").alias("cell_lat"), geo.grid_cell("lon").alias("cell_lon")).agg(F.count("*").alias("n"))


@query("""SELECT frame_id, round(speed_mps / 4e0, 4) AS spacing_m, round(greatest(4e0, coalesce(obs_uncertainty_m, 0) * pow(2e0, 15e0) / (156543.03392e0 * cos(radians(obs_lat)))), 3) AS ring_px
    FROM frames WHERE obs_lat BETWEEN -89 AND 89""")
def geo_spacing_ring(spark: SparkSession, d: str) -> DataFrame:
    """G18, G19."""
    f = table(spark, d, "frames").where(F.col("obs_lat").between(-89, 89) & ~F.isnan("obs_lat"))
    return f.select("frame_id", F.round(geo.estimated_spacing_m("speed_mps", 4.0), 4).alias("spacing_m"), F.round(geo.ring_radius_px("obs_lat", 15.0, F.coalesce("obs_uncertainty_m", F.lit(0.0))), 3).alias("ring_px"))


@query(f"""
    WITH e AS (SELECT survey_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS a, max(lon) AS b, min(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) AS c, max(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) AS d FROM location_records WHERE {GOOD_FIX} GROUP BY 1)
    SELECT survey_id, min_lat, max_lat, CASE WHEN d - c < b - a THEN c - CASE WHEN c >= 180 THEN 360 ELSE 0 END ELSE a END AS min_lon, CASE WHEN d - c < b - a THEN d - CASE WHEN d >= 180 THEN 360 ELSE 0 END ELSE b END AS max_lon FROM e""")
def geo_extent(spark: SparkSession, d: str) -> DataFrame:
    """G20."""
    return geo.extent(table(spark, d, "location_records").where(geo.usable("lat", "lon")), ["survey_id"])


# --- time, text, hash


@query("""SELECT frame_id, CAST(round_even(s.recording_start_epoch_ms + f.video_time_s * 1000e0, 0) AS BIGINT) AS t_ms, strftime(make_timestamp(f.t_epoch_ms * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS at
    FROM frames f JOIN surveys s ON f.survey_id = s.survey_id""")
def fn_video_time(spark: SparkSession, d: str) -> DataFrame:
    """F1, F2, F3."""
    f = table(spark, d, "frames").join(table(spark, d, "surveys").select("survey_id", "recording_start_epoch_ms"), "survey_id")
    return f.select("frame_id", misc.video_time_to_epoch_ms(F.col("recording_start_epoch_ms"), F.col("video_time_s")).alias("t_ms"), misc.iso_z(F.timestamp_millis("t_epoch_ms")).alias("at"))


@query("""
    WITH b AS (SELECT unnest(boxes) AS b FROM annotations)
    SELECT b.rdd_code AS rdd_code, CASE b.rdd_code WHEN 'D00' THEN 'longitudinal_crack' WHEN 'D10' THEN 'transverse_crack' WHEN 'D20' THEN 'alligator_crack' WHEN 'D40' THEN 'pothole' END AS damage_class, count(*) AS n FROM b GROUP BY 1""")
def fn_rdd_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of all boxes."""
    return notes.flat_boxes(table(spark, d, "annotations")).groupBy("rdd_code", "damage_class").agg(F.count("*").alias("n"))


@query("""SELECT image_id, min(file_name) AS file_name, CAST('0x' || substr(md5(concat_ws('|', '7', image_id)), 1, 8) AS BIGINT) / 4294967296e0 AS u, regexp_matches(image_id, '^[A-Za-z0-9._-]+$') AS safe FROM annotations GROUP BY image_id""")
def fn_stable_unit(spark: SparkSession, d: str) -> DataFrame:
    """F6, F8."""
    a = table(spark, d, "annotations").groupBy("image_id").agg(F.min("file_name").alias("file_name"))
    return a.select("image_id", "file_name", misc.stable_unit(F.lit("7"), F.col("image_id")).alias("u"), misc.safe_name(F.col("image_id")).alias("safe"))


_BOX_TEXT = "concat_ws('|', image_id, coalesce(country, ''), coalesce(CAST(image_index AS VARCHAR), ''), list_aggregate(list_transform(boxes, lambda b: concat(b.rdd_code, ':', b.xmin, ',', b.ymin, ',', b.xmax, ',', b.ymax)), 'string_agg', ';'))"


@query(f"""
    WITH h AS (SELECT md5({_BOX_TEXT}) AS h FROM annotations)
    SELECT sha256(concat_ws(':', count(*), sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)), sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)))) AS content_hash, count(*) AS n FROM h""")
def fn_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """one hash of a whole table, whatever its order."""
    boxes = F.array_join(F.transform("boxes", lambda b: F.concat(b["rdd_code"], F.lit(":"), F.concat_ws(",", b["xmin"], b["ymin"], b["xmax"], b["ymax"]))), ";")
    row = F.concat_ws("|", "image_id", F.coalesce("country", F.lit("")), F.coalesce(F.col("image_index").cast("string"), F.lit("")), F.when(F.size("boxes") > 0, boxes))
    return table(spark, d, "annotations").agg(misc.content_hash(row).alias("content_hash"), F.count("*").alias("n"))


@query("""SELECT json_extract_string(device_json, '$.os') AS os, json_extract_string(device_json, '$.mount') AS mount, count(*) AS n FROM surveys GROUP BY 1, 2""")
def fn_json_fields(spark: SparkSession, d: str) -> DataFrame:
    """F10."""
    s = table(spark, d, "surveys")
    return s.groupBy(F.get_json_object("device_json", "$.os").alias("os"), F.get_json_object("device_json", "$.mount").alias("mount")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN accuracy_m IS NULL OR isnan(accuracy_m) OR accuracy_m < 0 THEN 'unusable' WHEN accuracy_m <= 10 THEN 'good' WHEN accuracy_m <= 25 THEN 'fair' ELSE 'poor' END AS accuracy, count(*) AS n FROM location_records GROUP BY 1""")
def fn_describe_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """B9."""
    return table(spark, d, "location_records").groupBy(misc.describe_accuracy(F.col("accuracy_m")).alias("accuracy")).agg(F.count("*").alias("n"))


# --- GPS tracks

_CLEAN = """
    WITH r AS (SELECT *, CASE WHEN t IS NULL OR lat IS NULL OR lon IS NULL OR isnan(lat) OR isnan(lon) THEN 'malformed' WHEN NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) THEN 'out_of_range'
            WHEN accuracy_m IS NOT NULL AND (isnan(accuracy_m) OR accuracy_m > 25) THEN 'low_accuracy' END AS why FROM location_records WHERE survey_id IS NOT NULL),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY survey_id, t ORDER BY coalesce(accuracy_m, 'infinity'::DOUBLE), record_id) AS rn FROM r WHERE why IS NULL) WHERE rn = 1)
"""


@query(_CLEAN + """SELECT survey_id, count(*) AS total_input, count(*) FILTER (why = 'malformed') AS dropped_malformed, count(*) FILTER (why = 'out_of_range') AS dropped_out_of_range, count(*) FILTER (why = 'low_accuracy') AS dropped_low_accuracy,
    count(*) FILTER (why IS NULL) - count(DISTINCT t) FILTER (why IS NULL) AS deduplicated, count(DISTINCT t) FILTER (why IS NULL) AS kept, coalesce(bool_or(back), FALSE) AS reordered
    FROM (SELECT *, why IS NULL AND t < lag(t) OVER (PARTITION BY survey_id, why IS NULL ORDER BY record_id) AS back FROM r) GROUP BY 1""")
def track_stats(spark: SparkSession, d: str) -> DataFrame:
    """P1, T1, T2, T11, R28."""
    return track.track_stats(table(spark, d, "location_records"))


@query(_CLEAN + f"""SELECT survey_id, count(*) AS n_fixes, min(t) AS start_t, max(t) AS end_t, round(coalesce(sum(hop), 0), 2) AS distance_m
    FROM (SELECT *, {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS hop FROM k WINDOW w AS (PARTITION BY survey_id ORDER BY t)) GROUP BY 1""")
def track_distance(spark: SparkSession, d: str) -> DataFrame:
    """T1, T3, T11, W1."""
    x = track.track_distance(track.clean_track(table(spark, d, "location_records")))
    return x.withColumn("distance_m", F.round("distance_m", 2))


_LOCATE = _CLEAN + f""",
    z AS (SELECT survey_id, min(t) AS t0, max(t) AS t1 FROM k GROUP BY 1),
    q AS (SELECT f.frame_id, f.survey_id, f.t_epoch_ms AS t, z.t0, z.t1 FROM frames f JOIN z ON f.survey_id = z.survey_id),
    a AS (SELECT q.*, x.t AS a_t, x.lat AS alat, x.lon AS alon, x.accuracy_m AS aacc, x.speed_mps AS aspd, x.heading_deg AS ahdg FROM q ASOF LEFT JOIN k x ON q.survey_id = x.survey_id AND q.t > x.t),
    b AS (SELECT a.*, y.t AS bt, y.lat AS blat, y.lon AS blon, y.accuracy_m AS bacc, y.speed_mps AS bspd, y.heading_deg AS bhdg FROM a ASOF LEFT JOIN k y ON a.survey_id = y.survey_id AND a.t <= y.t),
    c AS (SELECT b.*, e.lat AS clat, e.lon AS clon, e.accuracy_m AS cacc, e.speed_mps AS cspd, e.heading_deg AS chdg, abs(e.t - b.t) / 1000e0 AS drift, (b.t - a_t) / CAST(bt - a_t AS DOUBLE) AS al, (bt - a_t) / 1000e0 AS span, {hav("alat", "alon", "blat", "blon")} AS sep
        FROM b LEFT JOIN k e ON b.survey_id = e.survey_id AND e.t = CASE WHEN b.t <= b.t0 THEN b.t0 WHEN b.t >= b.t1 THEN b.t1 END)
"""


@query(_LOCATE + """SELECT frame_id, round(coalesce(clat, alat + (blat - alat) * al), 6) AS lat, round(coalesce(clon, CASE WHEN abs(blon - alon) <= 180 THEN alon + (blon - alon) * al ELSE ((alon + (((blon - alon + 540) % 360 + 360) % 360 - 180) * al + 540) % 360 + 360) % 360 - 180 END), 6) AS lon, CASE WHEN clat IS NULL THEN 'interpolated_phone_gps' ELSE 'phone_gps' END AS method,
    round(CASE WHEN clat IS NULL THEN coalesce(aacc, 10) + (coalesce(bacc, 10) - coalesce(aacc, 10)) * al + 0.25 * sep * 4 * al * (1 - al) ELSE coalesce(cacc, 10) + CASE WHEN coalesce(cspd, 0) = 0 THEN 13.9e0 ELSE cspd END * drift END, 3) AS uncertainty_m,
    round(CASE WHEN clat IS NULL THEN span ELSE drift END, 3) AS gap_s, CASE WHEN clat IS NULL THEN span <= 10 ELSE drift <= 1 END AS is_trustworthy,
    round(CASE WHEN clat IS NOT NULL THEN cspd WHEN aspd IS NOT NULL AND bspd IS NOT NULL THEN aspd + (bspd - aspd) * al ELSE coalesce(aspd, bspd, CASE WHEN span > 0 THEN sep / span END) END + 1e-8, 4) AS speed_mps,
    round(CASE WHEN clat IS NOT NULL THEN chdg WHEN ahdg IS NOT NULL AND bhdg IS NOT NULL THEN ((ahdg + (((bhdg - ahdg + 540) % 360 + 360) % 360 - 180) * al) % 360 + 360) % 360 ELSE coalesce(ahdg, bhdg, CASE WHEN sep >= 1 THEN {turn} END) END + 1e-8, 4) AS heading_deg FROM c""".replace("{turn}", brg("alat", "alon", "blat", "blon")))
def track_locate(spark: SparkSession, d: str) -> DataFrame:
    """The place of every frame."""
    at = track.locate(track.clean_track(table(spark, d, "location_records")), table(spark, d, "frames").select("frame_id", "survey_id", F.col("t_epoch_ms").alias("t")), "frame_id")
    return at.select("frame_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "method", F.round("uncertainty_m", 3).alias("uncertainty_m"), F.round("gap_s", 3).alias("gap_s"), "is_trustworthy", F.round(F.col("speed_mps") + 1e-8, 4).alias("speed_mps"), F.round(F.col("heading_deg") + 1e-8, 4).alias("heading_deg"))


@query(_CLEAN + """,
    x AS (SELECT survey_id, max(t) AS ft FROM r WHERE why IS NULL GROUP BY 1), y AS (SELECT survey_id, max(t_epoch_ms) AS vt FROM frames GROUP BY 1),
    s AS (SELECT v.survey_id, recording_start_epoch_ms AS r, CASE WHEN ended_at IS NOT NULL THEN epoch_us(ended_at) / 1e6 - epoch_us(started_at) / 1e6 ELSE greatest(0, (coalesce(ft, vt) - recording_start_epoch_ms) / 1000e0) END AS dur
        FROM surveys v LEFT JOIN x ON x.survey_id = v.survey_id LEFT JOIN y ON y.survey_id = v.survey_id WHERE ended_at IS NOT NULL OR coalesce(ft, vt) IS NOT NULL),
    g AS (SELECT survey_id, r, unnest(range(0, CAST(floor((dur + 1e-9) / 0.5e0) AS BIGINT) + 1)) AS i FROM s WHERE dur >= 0)
    SELECT survey_id, i AS index, round(i * 0.5e0, 6) AS video_time_s, CAST(r + i * 500 AS BIGINT) AS t_epoch_ms FROM g""")
def sample_fixed_interval(spark: SparkSession, d: str) -> DataFrame:
    """S1, S2."""
    return track.sampling_plan(_recorded(spark, d), None, track.SamplingConfig(mode="fixed_interval")).drop("distance_from_previous_m")


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    return track.durations(table(spark, d, "surveys"), table(spark, d, "location_records"), table(spark, d, "frames"))


@query()
def sample_by_distance(spark: SparkSession, d: str) -> DataFrame:
    """S3, S4."""
    return track.sampling_plan(_recorded(spark, d), track.clean_track(table(spark, d, "location_records")))


# --- quality


@query("""SELECT quality, count(*) AS n, count(*) FILTER (obs_lat IS NULL) AS unpositioned FROM frames GROUP BY 1""")
def quality_counts(spark: SparkSession, d: str) -> DataFrame:
    """P5, P7."""
    return table(spark, d, "frames").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("obs_lat").isNull()).alias("unpositioned"))


@query("""SELECT frame_id, CASE WHEN b < 40 OR l < 25 OR l > 235 THEN 'rejected' WHEN b < 100 OR l < 50 OR l > 210 THEN 'degraded' ELSE 'accepted' END AS verdict,
    concat_ws(';', CASE WHEN b < 40 THEN 'too_blurred' END, CASE WHEN l < 25 THEN 'too_dark' END, CASE WHEN l > 235 THEN 'too_bright' END, CASE WHEN b >= 40 AND b < 100 THEN 'blurred' END, CASE WHEN l >= 25 AND l < 50 THEN 'dark' END, CASE WHEN l > 210 AND l <= 235 THEN 'bright' END) AS reasons FROM (SELECT frame_id, obs_uncertainty_m * 12 AS b, heading_deg AS l FROM frames)""")
def quality_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Q4, over two numbers at hand in place of scores."""
    f = table(spark, d, "frames")
    v = f.select("frame_id", pixels.verdict(F.col("obs_uncertainty_m") * 12, F.col("heading_deg")).alias("v"))
    return v.select("frame_id", F.col("v.quality").alias("verdict"), F.concat_ws(";", "v.reasons").alias("reasons"))


# --- tracking and clustering


def _one_of_each(detections: DataFrame) -> DataFrame:
    """One row for each detection, with the class behind its label."""
    return detections.groupBy("detection_id").agg(*[F.min(c).alias(c) for c in ("frame_id", "confidence", "x1", "y1", "x2", "y2")], F.min(misc.damage_class(F.col("damage_class"))).alias("damage_class"))


@query()
def tracking_greedy(spark: SparkSession, d: str) -> DataFrame:
    """K1, K2: boxes of accepted and degraded frames in tracks."""
    f = table(spark, d, "frames").where("quality <> 'rejected'")
    x = _one_of_each(table(spark, d, "detections"))
    return tracking.track_detections(f, x).select("survey_id", "detection_id", "track_no")


@query("""
    WITH d AS (SELECT x.survey_id, x.track_id, x.detection_id, f.t_epoch_ms AS t, f.frame_id, x.confidence, row_number() OVER (PARTITION BY x.detection_id ORDER BY x.ingested_at, x.frame_id) AS rn FROM detections x JOIN frames f ON f.frame_id = x.frame_id WHERE x.track_id IS NOT NULL)
    SELECT survey_id, track_id, count(*) AS n_detections, min(t) AS first_t, max(t) AS last_t, arg_min(frame_id, (t, detection_id)) AS first_frame_id, arg_max(frame_id, (t, detection_id)) AS last_frame_id, max(confidence) AS max_confidence, round(avg(confidence), 8) AS mean_confidence,
        arg_min(detection_id, (-confidence, t, detection_id)) AS best_detection_id FROM d WHERE rn = 1 GROUP BY 1, 2""")
def tracking_summary(spark: SparkSession, d: str) -> DataFrame:
    """K3, K4, W2, J5."""
    x = table(spark, d, "detections").where("track_id is not null").groupBy("detection_id").agg(F.min_by(F.struct("survey_id", "track_id", "frame_id", "confidence"), F.struct("ingested_at", "frame_id")).alias("s")).select("detection_id", "s.*")
    rows = x.join(table(spark, d, "frames").select("frame_id", "t_epoch_ms"), "frame_id")
    return tracking.summarize_tracks(rows, ["survey_id", "track_id"]).withColumn("mean_confidence", F.round("mean_confidence", 8))


def _arc(a: str, b: str, c: str, d: str) -> str:
    """hav() of what is known not to be null."""
    return f"(2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))))"


# one candidate after another: the founders so far are a list that grows by one in each step
_CLUSTERS = f"""
c AS (SELECT row_number() OVER (ORDER BY observed_at, observation_id) AS k, observation_id AS id, damage_class AS cls, lat, lon, coalesce(uncertainty_m, 10e0) AS u, 1 / pow(greatest(coalesce(uncertainty_m, 10e0), 0.5e0), 2) AS w FROM cluster_candidates WHERE {GOOD_FIX}),
 p AS (SELECT a.k AS k, a.lat AS alat, a.lon AS alon, a.u AS au, a.w AS aw, b.k AS m, b.lat, a.lon + ((b.lon - a.lon + 540) % 360) - 180 AS lon, b.u, b.w FROM c a JOIN c b ON b.k < a.k AND a.cls = b.cls AND abs(a.lat - b.lat) < 0.0009e0 AND {_arc('a.lat','a.lon','b.lat','b.lon')} <= 92),
 l AS (SELECT k, any_value(alat) AS alat, any_value(alon) AS alon, any_value(au) AS au, any_value(aw) AS aw, list({{'m': m, 'lat': lat, 'lon': lon, 'u': u, 'w': w, 'd': {_arc('lat','lon','alat','alon')}}}) AS near FROM p GROUP BY 1),
 o AS (SELECT c.k, alat, alon, au, aw, near FROM c LEFT JOIN l ON l.k = c.k),
 r(k, f) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
   UNION ALL SELECT o.k, list_append(r.f, coalesce((SELECT g FROM (SELECT g, ms, list_min(list_transform(ms, lambda z: z.d)) AS d, list_max(list_transform(ms, lambda z: z.u)) AS mu,
        (list_sum(list_transform(ms, lambda z: z.w * z.lat)) + o.aw * o.alat) / (list_sum(list_transform(ms, lambda z: z.w)) + o.aw) AS y, (list_sum(list_transform(ms, lambda z: z.w * z.lon)) + o.aw * o.alon) / (list_sum(list_transform(ms, lambda z: z.w)) + o.aw) AS x
        FROM (SELECT g, list_filter(o.near, lambda z: r.f[z.m] = g) AS ms FROM (SELECT unnest(list_distinct(list_transform(o.near, lambda z: r.f[z.m]))) AS g) g0) g1) g2
      WHERE d <= least(12e0 + o.au + mu, 30e0) AND greatest({_arc('o.alat','o.alon','y','x')}, list_max(list_transform(ms, lambda z: {_arc('z.lat','z.lon','y','x')}))) <= 15e0 ORDER BY d, g LIMIT 1), o.k))
   FROM r JOIN o ON o.k = r.k + 1),
 a AS (SELECT unnest(f) AS g, generate_subscripts(f, 1) AS k FROM (SELECT f FROM r ORDER BY k DESC LIMIT 1)),
 k AS (SELECT c.id AS observation_id, d.id AS cluster_id FROM a JOIN c ON c.k = a.k JOIN c d ON d.k = a.g)"""


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT observation_id, cluster_id FROM k")
def cluster_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Every observation with the one that founded its cluster."""
    return clustering.cluster(table(spark, d, "cluster_candidates")).select("observation_id", "cluster_id")


@query(f"""WITH RECURSIVE {_CLUSTERS},
    q AS (SELECT k.cluster_id, x.*, coalesce(uncertainty_m, 10e0) AS u, 1 / pow(greatest(coalesce(uncertainty_m, 10e0), 0.5e0), 2) AS w, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS turned FROM k JOIN cluster_candidates x ON x.observation_id = k.observation_id),
    v AS (SELECT cluster_id, string_agg(survey_id, ';' ORDER BY seen) AS survey_ids FROM (SELECT cluster_id, survey_id, min((observed_at, observation_id)) AS seen FROM q GROUP BY 1, 2) GROUP BY 1)
    SELECT q.cluster_id, arg_min(damage_class, (observed_at, observation_id)) AS damage_class, round(sum(w * lat) / sum(w), 6) AS lat, round(CASE WHEN max(lon) - min(lon) > 180 THEN ((sum(w * turned) / sum(w) + 540) % 360 + 360) % 360 - 180 ELSE sum(w * lon) / sum(w) END, 6) AS lon,
        round(greatest(sqrt(1 / sum(w)), min(u)), 3) AS uncertainty_m, max(confidence) AS confidence, any_value(v.survey_ids) AS survey_ids, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS observation_count, arg_min({{'f': representative_frame_id}}, (-confidence, observed_at, q.observation_id)).f AS representative_frame_id
    FROM q JOIN v ON v.cluster_id = q.cluster_id GROUP BY 1""")
def cluster_defects(spark: SparkSession, d: str) -> DataFrame:
    """One defect for each cluster."""
    x = clustering.defects_of(clustering.cluster(table(spark, d, "cluster_candidates")))
    return x.select("cluster_id", "damage_class", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "uncertainty_m", "confidence", F.concat_ws(";", "survey_ids").alias("survey_ids"), "first_seen", "last_seen", "observation_count", "representative_frame_id")


@query("""
    SELECT damage_class, round(sum(lat * w) / sum(w), 6) AS lat, round(CASE WHEN max(lon) - min(lon) > 180 THEN ((sum(w * CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) / sum(w) + 540) % 360 + 360) % 360 - 180 ELSE sum(lon * w) / sum(w) END, 6) AS lon, round(greatest(sqrt(1 / sum(w)), min(u)), 3) AS uncertainty_m, count(*) AS n
    FROM (SELECT *, coalesce(uncertainty_m, 10e0) AS u, 1e0 / pow(greatest(coalesce(uncertainty_m, 10e0), 0.5e0), 2) AS w FROM cluster_candidates) c GROUP BY 1""")
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Weighted centroids by class."""
    c = table(spark, d, "cluster_candidates").withColumn("cluster_id", F.col("damage_class"))
    return clustering.defects_of(c).select("damage_class", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "uncertainty_m", F.col("observation_count").alias("n"))


# --- roads and rollups


def _segments(spark, d):
    return project(spark, d, SEGMENTS)


def _defects(spark, d):
    return project(spark, d, DEFECTS)


def _driven(spark, d):
    return project(spark, d, DRIVEN)


def match_sql(points: str, heading: str, p: str = "") -> str:
    """Brute force over all segments within the cells; `points` has point_id, lat, lon, uncertainty_m. `p` begins the names of the
    steps, so that a statement may match twice."""
    r = "least(20e0, greatest(15e0, coalesce(uncertainty_m, 0) * 2))"
    return f"""
    {p}seg AS ({SEGMENTS}),
    {p}pt AS (SELECT *, {heading} AS hdg, degrees({r} / 6371008.8e0) AS dla, degrees({r} / (6371008.8e0 * cos(radians(lat)))) AS dlo FROM ({points}) p0),
    {p}m0 AS (SELECT pt.*, seg.*, {hav("a_lat", "a_lon", "lat", "lon")} / 6371008.8e0 AS d13, radians({brg("a_lat", "a_lon", "lat", "lon")} - {brg("a_lat", "a_lon", "b_lat", "b_lon")}) AS dt, {hav("a_lat", "a_lon", "b_lat", "b_lon")} AS len, {brg("a_lat", "a_lon", "b_lat", "b_lon")} AS sb, {hav("a_lat", "a_lon", "lat", "lon")} AS da, {hav("b_lat", "b_lon", "lat", "lon")} AS db
        FROM {p}pt pt JOIN {p}seg seg ON floor((lat - dla) / 0.005e0) <= floor(greatest(a_lat, b_lat) / 0.005e0) AND floor((lat + dla) / 0.005e0) >= floor(least(a_lat, b_lat) / 0.005e0) AND floor((lon - dlo) / 0.005e0) <= floor(greatest(a_lon, b_lon) / 0.005e0) AND floor((lon + dlo) / 0.005e0) >= floor(least(a_lon, b_lon) / 0.005e0)),
    {p}m1 AS (SELECT *, asin(greatest(-1e0, least(1e0, sin(d13) * sin(dt)))) AS xt FROM {p}m0),
    {p}m2 AS (SELECT *, CASE WHEN da = 0 THEN 0 ELSE acos(greatest(-1e0, least(1e0, cos(d13) / cos(xt)))) * CASE WHEN cos(dt) < 0 THEN -1 ELSE 1 END * 6371008.8e0 END AS al FROM {p}m1),
    {p}m3 AS (SELECT *, CASE WHEN al <= 0 THEN da WHEN al >= len THEN db ELSE abs(xt) * 6371008.8e0 END AS dist, {bdiff("hdg", "sb")} AS raw FROM {p}m2),
    {p}m4 AS (SELECT *, CASE WHEN oneway THEN raw ELSE least(raw, 180 - raw) END AS delta, CASE WHEN coalesce(name, '') <> '' THEN 'name:' || name ELSE 'way:' || way_id END AS street FROM {p}m3 WHERE dist <= 20),
    {p}m5 AS (SELECT *, dist + coalesce(delta * 0.15e0, 0) AS score FROM {p}m4 WHERE NOT coalesce(delta > 55, FALSE)),
    {p}b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY score, segment_id) AS rn FROM {p}m5) WHERE rn = 1),
    {p}rv AS (SELECT m5.point_id, min(m5.score) AS rival FROM {p}m5 m5 JOIN {p}b1 b1 ON m5.point_id = b1.point_id AND m5.street <> b1.street GROUP BY 1),
    {p}matched AS (SELECT pt.point_id, CASE WHEN b1.point_id IS NOT NULL AND coalesce(rival - b1.score < 4, FALSE) THEN 'ambiguous' WHEN b1.point_id IS NOT NULL THEN 'matched' WHEN pt.point_id IN (SELECT point_id FROM {p}m4) THEN 'heading_mismatch' ELSE 'no_candidates' END AS reason,
        b1.way_id, b1.segment_id, b1.dist FROM {p}pt pt LEFT JOIN {p}b1 b1 ON pt.point_id = b1.point_id LEFT JOIN {p}rv rv ON rv.point_id = pt.point_id)"""


_POINTS = f"SELECT defect_id AS point_id, lat, lon, uncertainty_m FROM ({DEFECTS}) d1"


@query(f"WITH {match_sql(_POINTS, 'NULL::DOUBLE')} SELECT point_id, reason, CASE WHEN reason = 'matched' THEN way_id END AS way_id, CASE WHEN reason = 'matched' THEN round(dist, 3) END AS match_distance_m FROM matched")
def roads_match(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2, M3, M4, M6, G9."""
    p = _defects(spark, d).select(F.col("defect_id").alias("point_id"), "lat", "lon", "uncertainty_m", F.lit(None).cast("double").alias("heading_deg"))
    return roads.match_points(p, _segments(spark, d)).select("point_id", "reason", "way_id", "match_distance_m")


_DRIVEN_POINTS = f"SELECT frame_id AS point_id, lat, lon, uncertainty_m, heading_deg FROM ({DRIVEN}) d2"


@query(f"WITH {match_sql(_DRIVEN_POINTS, 'heading_deg')} SELECT point_id, reason, CASE WHEN reason = 'matched' THEN segment_id END AS segment_id FROM matched")
def roads_match_reasons(spark: SparkSession, d: str) -> DataFrame:
    """M3, M5, M6: outcomes with headings."""
    p = _driven(spark, d).select(F.col("frame_id").alias("point_id"), "lat", "lon", "uncertainty_m", "heading_deg")
    return roads.match_points(p, _segments(spark, d)).select("point_id", "reason", "segment_id")


@query(f"SELECT name, count(*) AS n_segments FROM ({SEGMENTS}) s1 WHERE coalesce(name, '') <> '' GROUP BY 1")
def roads_named_streets(spark: SparkSession, d: str) -> DataFrame:
    """M7."""
    return roads.named_streets(_segments(spark, d))


@query(f"SELECT defect_id, round({hav('lat', 'lon', '40.19231e0', '44.51991e0')}, 3) AS distance_m FROM ({DEFECTS}) d1 WHERE {hav('lat', 'lon', '40.19231e0', '44.51991e0')} <= 400")
def roads_points_near(spark: SparkSession, d: str) -> DataFrame:
    """J1."""
    return roads.points_near(_defects(spark, d), "defect_id", 40.19231, 44.51991, 400.0).select("defect_id", F.round("distance_m", 3).alias("distance_m"))


@query(f"SELECT way_id, round(sum({hav('a_lat', 'a_lon', 'b_lat', 'b_lon')}), 2) AS length_m, arg_max(name, seg_ord) FILTER (TRUE) AS name FROM (SELECT * FROM ({SEGMENTS}) s0) s1 GROUP BY 1")
def rollup_way_lengths(spark: SparkSession, d: str) -> DataFrame:
    """R2, G21."""
    return rollup.way_lengths(_segments(spark, d)).select("way_id", F.round("length_m", 2).alias("length_m"), "name")


_COVER = f"""
    dr AS ({DRIVEN}),
    pr AS (SELECT * FROM (SELECT *, {hav("lat", "lon", "lead(lat) OVER w", "lead(lon) OVER w")} AS metres FROM dr WINDOW w AS (PARTITION BY survey_id ORDER BY t_epoch_ms, video_time_s, frame_id)) WHERE metres > 0 AND metres <= 60),
    {match_sql("SELECT frame_id AS point_id, lat, lon, uncertainty_m, heading_deg FROM pr", "heading_deg")},
    cov AS (SELECT CASE WHEN reason = 'matched' THEN m.way_id END AS way_id, sum(metres) AS surveyed_m FROM pr JOIN matched m ON pr.frame_id = m.point_id GROUP BY 1)"""


@query(f"WITH {_COVER} SELECT way_id, round(surveyed_m, 1) AS surveyed_m FROM cov")
def rollup_coverage(spark: SparkSession, d: str) -> DataFrame:
    """R1."""
    return rollup.coverage_by_way(_driven(spark, d), _segments(spark, d)).select("way_id", F.round("surveyed_m", 1).alias("surveyed_m"))


def report_sql(everything: bool) -> str:
    n = lambda cond, name: f"count(*) FILTER ({cond}) AS {name}"
    alive = "status <> 'rejected' AND "
    counts = [n("status = 'verified'", "verified"), n("status = 'rejected'", "rejected"), n("status NOT IN ('verified', 'rejected')", "probable"), *[n(f"{alive}damage_class = '{k}'", k) for k in schema.ENUMS["damage_class"]], *[n(f"{alive}severity = '{k}'", f"severity_{k}") for k in schema.ENUMS["severity"]]]
    names = [c.rsplit(" ", 1)[1] for c in counts]
    fresh = f"SELECT defect_id AS point_id, lat, lon, uncertainty_m FROM ({DEFECTS}) d3 WHERE segment_id IS NULL"
    return f"""{_COVER}, {match_sql(fresh, 'NULL::DOUBLE', 'd_')},
    dw AS (SELECT d.*, CASE WHEN d.segment_id IS NOT NULL THEN split_part(d.segment_id, '#', 1) WHEN m.reason = 'matched' THEN m.way_id END AS way FROM ({DEFECTS}) d LEFT JOIN d_matched m ON m.point_id = d.defect_id),
    pw AS (SELECT way AS way_id, {', '.join(counts)}, count(DISTINCT survey_id) AS n_surveys, string_agg(DISTINCT survey_id, ';' ORDER BY survey_id) AS survey_ids FROM dw WHERE way IS NOT NULL GROUP BY 1),
    meta AS (SELECT way_id, sum({hav('a_lat', 'a_lon', 'b_lat', 'b_lon')}) AS length_m, arg_max(highway, seg_ord) AS highway, last(name ORDER BY seg_ord) AS name FROM ({SEGMENTS}) s5 GROUP BY 1),
    got AS (SELECT coalesce(c.way_id, pw.way_id) AS way_id, c.surveyed_m, pw.* EXCLUDE (way_id) FROM (SELECT * FROM cov WHERE way_id IS NOT NULL) c FULL JOIN pw ON c.way_id = pw.way_id),
    r0 AS (SELECT coalesce(meta.way_id, got.way_id) AS way_id, coalesce(length_m, 0) AS length_m, name, highway, coalesce(surveyed_m, 0) AS surveyed_m, coalesce(survey_ids, '') AS survey_ids, coalesce(n_surveys, 0) AS n_surveys, {', '.join(f'coalesce({c}, 0) AS {c}' for c in names)}
        FROM got {'FULL' if everything else 'LEFT'} JOIN meta ON meta.way_id = got.way_id),
    rep AS (SELECT *, verified + probable AS outstanding, CASE WHEN length_m > 0 THEN least(surveyed_m, length_m) ELSE 0 END AS covered_m, CASE WHEN surveyed_m >= 50 THEN round((verified + probable) / surveyed_m * 100, 2) END AS defects_per_100m,
        CASE WHEN surveyed_m <= 0 THEN 'not_surveyed' WHEN verified + probable = 0 THEN 'clean' ELSE 'defects' END AS state FROM r0)"""


def _report(spark, d, everything=False):
    seg = _segments(spark, d)
    cover = checkpoint(rollup.coverage_by_way(_driven(spark, d), seg))
    return rollup.street_report(rollup.ways_of_defects(_defects(spark, d), seg), cover, seg, everything), cover, seg


@query(f"WITH {report_sql(False)} SELECT * REPLACE (round(surveyed_m, 1) AS surveyed_m, round(length_m, 1) AS length_m, round(covered_m, 1) AS covered_m) FROM rep")
def rollup_streets(spark: SparkSession, d: str) -> DataFrame:
    """R3, R4, R5, R6, R7, J6."""
    r = _report(spark, d)[0]
    r = r.withColumn("survey_ids", F.concat_ws(";", F.array_sort("survey_ids")))
    return r.select(*[F.round(c, 1).alias(c) if t == "double" and c != "defects_per_100m" else F.col(c) for c, t in r.dtypes])


@query(f"""WITH {report_sql(True)}, t AS (SELECT (SELECT count(*) FROM meta) AS network_ways, (SELECT sum(length_m) FROM meta) AS network_length_m, (SELECT sum(covered_m) FROM rep) AS covered_m, (SELECT sum(surveyed_m) FROM rep) AS on_network_m,
    (SELECT coalesce(sum(surveyed_m) FILTER (way_id IS NULL), 0) FROM cov) AS unmatched_m, (SELECT sum(surveyed_m) FROM cov) AS surveyed_m)
    SELECT network_ways, round(network_length_m, 3) AS network_length_m, round(covered_m, 3) AS covered_m, round(on_network_m, 3) AS on_network_m, round(unmatched_m, 3) AS unmatched_m, round(surveyed_m, 3) AS surveyed_m, round(covered_m / network_length_m, 3) AS coverage_fraction FROM t""")
def rollup_network(spark: SparkSession, d: str) -> DataFrame:
    """R8."""
    r, cover, seg = _report(spark, d, True)
    n = rollup.network_totals(r, cover, seg)
    return n.select(*[F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in n.dtypes])


@query(f"WITH {report_sql(False)} SELECT way_id, defects_per_100m FROM rep WHERE defects_per_100m IS NOT NULL ORDER BY defects_per_100m DESC, way_id LIMIT 10")
def rollup_worst(spark: SparkSession, d: str) -> DataFrame:
    """The ten streets with most defects by length, a top-k report."""
    return rollup.worst(_report(spark, d)[0], 10).select("way_id", "defects_per_100m")


@query(f"""WITH {report_sql(False)}, ids AS (SELECT name, string_agg(DISTINCT s, ';' ORDER BY s) AS survey_ids FROM (SELECT name, unnest(string_split(survey_ids, ';')) AS s FROM rep WHERE survey_ids <> '') GROUP BY 1)
    SELECT r.*, coalesce(ids.survey_ids, '') AS survey_ids FROM (SELECT name, count(*) AS n_ways, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('verified', 'rejected', 'probable', 'outstanding', *schema.ENUMS['damage_class'], *(f'severity_{k}' for k in schema.ENUMS['severity'])))}, {', '.join(f'round(sum({c}), 1) AS {c}' for c in ('surveyed_m', 'covered_m', 'length_m'))}
        FROM rep WHERE coalesce(name, '') <> '' GROUP BY 1) r LEFT JOIN ids ON ids.name = r.name""")
def rollup_by_name(spark: SparkSession, d: str) -> DataFrame:
    """R10."""
    r = rollup.by_name(_report(spark, d)[0]).withColumn("survey_ids", F.concat_ws(";", "survey_ids"))
    return r.select(*[F.round(c, 1).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


@query(f"""
    WITH d1 AS ({DEFECTS})
    SELECT 'total' AS dimension, '' AS value, count(*) AS n, round(avg(uncertainty_m), 3) AS mean_uncertainty_m, round(count(*) / 12.5e0, 2) AS n_per_km FROM d1
    """ + " ".join(f"UNION ALL SELECT '{c}', {c}, count(*), round(avg(uncertainty_m), 3), round(count(*) / 12.5e0, 2) FROM d1 GROUP BY 2" for c in ("damage_class", "status", "severity")))
def rollup_summary(spark: SparkSession, d: str) -> DataFrame:
    """R11, O6."""
    return rollup.summarize(_defects(spark, d), distance_km=12.5)


@query("""SELECT model_id, model_id SIMILAR TO '(fake|scripted|null)-.*' AS is_synthetic, count(*) AS n, count(DISTINCT survey_id) AS n_surveys FROM detections GROUP BY 1""")
def rollup_provenance(spark: SparkSession, d: str) -> DataFrame:
    """R13, F13."""
    x = table(spark, d, "detections")
    return x.groupBy("model_id", misc.is_synthetic_model(F.col("model_id")).alias("is_synthetic")).agg(F.count("*").alias("n"), F.countDistinct("survey_id").alias("n_surveys"))


@query("""SELECT c.damage_class, count(x.damage_class) AS n FROM (SELECT unnest(['longitudinal_crack', 'transverse_crack', 'alligator_crack', 'pothole']) AS damage_class) c LEFT JOIN cluster_candidates x ON x.damage_class = c.damage_class AND x.confidence >= 0.95 GROUP BY 1""")
def rollup_legend(spark: SparkSession, d: str) -> DataFrame:
    """Counts with zeros for absent classes."""
    dim = spark.createDataFrame([(c,) for c in schema.ENUMS["damage_class"]], "damage_class string")
    n = table(spark, d, "cluster_candidates").where("confidence >= 0.95").groupBy("damage_class").agg(F.count("*").alias("n"))
    return dim.join(n, "damage_class", "left").select("damage_class", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
    WITH f AS (SELECT frame_id, quality FROM frames), d AS (SELECT frame_id, max(confidence) AS c FROM detections GROUP BY 1)
    SELECT quality, count(*) AS n_frames, count(d.frame_id) AS with_detections, round(100e0 * count(d.frame_id) / count(*), 2) AS percent FROM f LEFT JOIN d ON f.frame_id = d.frame_id GROUP BY 1""")
def rollup_detection_rate(spark: SparkSession, d: str) -> DataFrame:
    """R25, R26, J8."""
    best = table(spark, d, "detections").groupBy("frame_id").agg(F.max("confidence").alias("best"))
    j = table(spark, d, "frames").select("frame_id", "quality").join(best, "frame_id", "left").groupBy("quality").agg(F.count("*").alias("n_frames"), F.count("best").alias("with_detections"))
    return j.withColumn("percent", F.round(100.0 * F.col("with_detections") / F.col("n_frames"), 2))


@query("""
    SELECT c.observation_id, f.heading_deg FROM cluster_candidates c JOIN frames f ON c.representative_frame_id = f.frame_id WHERE f.heading_deg IS NOT NULL""")
def join_headings(spark: SparkSession, d: str) -> DataFrame:
    """J2."""
    f = table(spark, d, "frames").where("heading_deg is not null").select(F.col("frame_id").alias("representative_frame_id"), "heading_deg")
    return table(spark, d, "cluster_candidates").join(f, "representative_frame_id").select("observation_id", "heading_deg")


@query("""
    WITH o AS (SELECT observation_id, unnest(ids) AS detection_id FROM (SELECT c.observation_id, list(DISTINCT x.detection_id) AS ids FROM cluster_candidates c JOIN detections x ON x.frame_id = c.representative_frame_id GROUP BY 1))
    SELECT DISTINCT o.observation_id, x.detection_id, x.damage_class FROM o JOIN detections x ON x.detection_id = o.detection_id""")
def join_detection_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of ids taken apart and joined exactly."""
    x = table(spark, d, "detections")
    o = table(spark, d, "cluster_candidates").join(x.select(F.col("frame_id").alias("representative_frame_id"), "detection_id"), "representative_frame_id").groupBy("observation_id").agg(F.collect_set("detection_id").alias("ids"))
    return o.select("observation_id", F.explode("ids").alias("detection_id")).join(x.select("detection_id", "damage_class"), "detection_id").distinct()


@query("""SELECT s.survey_id, count(f.frame_id) AS n_frames FROM surveys s LEFT JOIN frames f ON s.survey_id = f.survey_id WHERE NOT EXISTS (SELECT 1 FROM detections x WHERE x.survey_id = s.survey_id AND x.confidence >= 0.9) GROUP BY 1""")
def join_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Surveys without a sure detection."""
    sure = table(spark, d, "detections").where("confidence >= 0.9").select("survey_id").distinct()
    n = table(spark, d, "frames").groupBy("survey_id").agg(F.count("*").alias("n_frames"))
    return table(spark, d, "surveys").select("survey_id").join(sure, "survey_id", "left_anti").join(n, "survey_id", "left").select("survey_id", F.coalesce("n_frames", F.lit(0)).alias("n_frames"))


# --- store


@query("""SELECT detection_id, arg_max(frame_id, (ingested_at, frame_id, confidence)) AS frame_id, arg_max(confidence, (ingested_at, frame_id, confidence)) AS confidence FROM detections GROUP BY 1""")
def store_last_write(spark: SparkSession, d: str) -> DataFrame:
    """D4, D7, D9."""
    x = table(spark, d, "detections").select("detection_id", "frame_id", "confidence", "ingested_at")
    return store.last_write(x, ["detection_id"], ["ingested_at", "frame_id", "confidence"]).select("detection_id", "frame_id", "confidence")


@query("""
    WITH n AS (SELECT o_custkey AS c_custkey, 'new' AS c_name, sum(o_totalprice) AS c_acctbal FROM orders GROUP BY 1 UNION ALL SELECT -c_custkey, c_name, c_acctbal FROM customer)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NOT NULL THEN o.c_name ELSE n.c_name END AS c_name, round(CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END, 2) AS c_acctbal FROM customer o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All customers, with what their orders come to as the new version, and as many new keys; the name of known
    rows stays."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit("new").alias("c_name"), F.sum("o_totalprice").alias("c_acctbal"))
    new = new.unionByName(c.withColumn("c_custkey", -F.col("c_custkey")))
    return store.upsert(c, new, ["c_custkey"], ["c_name"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("""SELECT survey_id, arg_max(lat, (t, record_id)) FILTER (lat IS NOT NULL) AS lat, arg_max(speed_mps, (t, record_id)) FILTER (speed_mps IS NOT NULL) AS speed_mps, count(*) AS n_entries, max(t) AS last_at FROM location_records WHERE t IS NOT NULL GROUP BY 1""")
def store_fold_log(spark: SparkSession, d: str) -> DataFrame:
    """D12's fold: the last known value of each attribute of a log."""
    return store.current_state(table(spark, d, "location_records").where("t is not null"), "survey_id", "t", "record_id", ["lat", "speed_mps"])


@query("""SELECT count(*) AS n FROM detections x WHERE x.frame_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM frames f WHERE f.frame_id = x.frame_id)""")
def store_orphans(spark: SparkSession, d: str) -> DataFrame:
    """D11."""
    return store.orphans(table(spark, d, "detections"), table(spark, d, "frames"), "frame_id").agg(F.count("*").alias("n"))


@query("""
    SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT coalesce(obs_lat IS NULL OR (obs_lat BETWEEN -90 AND 90 AND NOT isnan(obs_lat)), FALSE) THEN 'lat_range' END, CASE WHEN NOT coalesce(obs_lon IS NULL OR (obs_lon BETWEEN -180 AND 180 AND NOT isnan(obs_lon)), FALSE) THEN 'lon_range' END,
        CASE WHEN NOT coalesce(video_time_s >= 0, FALSE) THEN 'negative_time' END, CASE WHEN NOT coalesce(quality IN ('accepted', 'degraded', 'rejected'), FALSE) THEN 'unknown_quality' END], lambda x: x IS NOT NULL)) AS rule FROM frames) GROUP BY 1""")
def store_validate(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a rule."""
    return schema.validate(table(spark, d, "frames"), "frames").select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


# --- evaluation


def unit(part: str, key: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{part}', {key})), 1, 8) AS BIGINT) / 4294967296e0)"


_EVAL = f"""
    b0 AS (SELECT DISTINCT ON (image_id) image_id, boxes FROM annotations ORDER BY image_id),
    b1 AS (SELECT image_id, unnest(boxes) AS b, generate_subscripts(boxes, 1) AS i FROM b0),
    t AS (SELECT image_id, concat(image_id, '#', printf('%03d', i - 1)) AS box_id, CASE b.rdd_code WHEN 'D00' THEN 'longitudinal_crack' WHEN 'D10' THEN 'transverse_crack' WHEN 'D20' THEN 'alligator_crack' WHEN 'D40' THEN 'pothole' END AS damage_class,
        CAST(b.xmin AS DOUBLE) AS x1, CAST(b.ymin AS DOUBLE) AS y1, CAST(b.xmax AS DOUBLE) AS x2, CAST(b.ymax AS DOUBLE) AS y2 FROM b1),
    p AS (SELECT image_id, damage_class, box_id, round({unit('score', 'box_id')}, 3) AS score, x1 + k AS x1, y1, x2 + k AS x2, y2 FROM (SELECT *, ({unit('k', 'box_id')} * 0.7e0 - 0.35e0) * (x2 - x1) AS k FROM t) WHERE {unit('keep', 'box_id')} < 0.8e0),
    o AS (SELECT p.image_id, p.damage_class, p.box_id AS pred, p.score, t.box_id AS gt, least(p.x2, t.x2) - greatest(p.x1, t.x1) AS w, least(p.y2, t.y2) - greatest(p.y1, t.y1) AS h, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa, (t.x2 - t.x1) * (t.y2 - t.y1) AS ta
        FROM p JOIN t ON p.image_id = t.image_id AND p.damage_class = t.damage_class),
    e AS (SELECT *, w * h / (pa + ta - w * h) AS iou FROM o WHERE w > 0 AND h > 0 AND w * h / (pa + ta - w * h) >= 0.5e0),
    l AS (SELECT image_id, damage_class, pred, list(gt ORDER BY iou DESC, gt) AS gts, row_number() OVER (PARTITION BY image_id, damage_class ORDER BY any_value(score) DESC, pred) AS k FROM e GROUP BY 1, 2, 3),
    g(image_id, damage_class, k, used, pred) AS (SELECT DISTINCT image_id, damage_class, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), NULL::VARCHAR FROM l
        UNION ALL SELECT image_id, damage_class, k, CASE WHEN c IS NULL THEN used ELSE list_append(used, c) END, CASE WHEN c IS NOT NULL THEN pred END
        FROM (SELECT l.image_id, l.damage_class, l.k, g.used, l.pred, list_filter(l.gts, lambda x: NOT list_contains(g.used, x))[1] AS c FROM g JOIN l ON l.image_id = g.image_id AND l.damage_class = g.damage_class AND l.k = g.k + 1)),
    m AS (SELECT p.image_id, p.damage_class, p.box_id, p.score, g.pred IS NOT NULL AS hit FROM p LEFT JOIN (SELECT * FROM g WHERE pred IS NOT NULL) g ON g.image_id = p.image_id AND g.damage_class = p.damage_class AND g.pred = p.box_id)"""
_SCORES = f"""{_EVAL},
    gc AS (SELECT damage_class, count(*) AS gt FROM t GROUP BY 1),
    pc AS (SELECT damage_class, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM m GROUP BY 1),
    c0 AS (SELECT coalesce(pc.damage_class, gc.damage_class) AS damage_class, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(gt, 0) AS gt FROM pc FULL JOIN gc ON pc.damage_class = gc.damage_class),
    c1 AS (SELECT *, gt - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN gt > 0 THEN tp / CAST(gt AS DOUBLE) END AS recall FROM c0),
    a0 AS (SELECT *, sum(CAST(hit AS INT)) OVER w / CAST(count(*) OVER w AS DOUBLE) AS prec FROM m WINDOW w AS (PARTITION BY damage_class ORDER BY score DESC, image_id, box_id ROWS UNBOUNDED PRECEDING)),
    a1 AS (SELECT *, max(prec) OVER (PARTITION BY damage_class ORDER BY score DESC, image_id, box_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM a0),
    ap AS (SELECT a1.damage_class, sum(env / gt) FILTER (hit) AS ap FROM a1 JOIN gc ON gc.damage_class = a1.damage_class GROUP BY 1),
    sc AS (SELECT c1.damage_class, tp, fp, fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1, CASE WHEN gt > 0 THEN coalesce(ap, 0) END AS ap FROM c1 LEFT JOIN ap ON ap.damage_class = c1.damage_class)"""


def _boxes(spark, d):
    """Truth: every annotated box; predictions: the same boxes shifted by hashes, with a score, less some."""
    a = table(spark, d, "annotations").dropDuplicates(["image_id"])
    t = notes.flat_boxes(a).select("image_id", "damage_class", F.concat_ws("#", "image_id", F.format_string("%03d", "box_no")).alias("box_id"), *[F.col(c).cast("double").alias(n) for n, c in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))])
    u = lambda s: misc.stable_unit(F.lit(s), F.col("box_id"))
    k = (u("k") * 0.7 - 0.35) * (F.col("x2") - F.col("x1"))
    p = t.where(u("keep") < 0.8).select("image_id", "damage_class", "box_id", F.round(u("score"), 3).alias("score"), (F.col("x1") + k).alias("x1"), "y1", (F.col("x2") + k).alias("x2"), "y2")
    return p, t


@query(f"WITH RECURSIVE {_EVAL} SELECT * FROM m")
def eval_matches(spark: SparkSession, d: str) -> DataFrame:
    """E1, E2."""
    return evaluate.match_boxes(*_boxes(spark, d))


@query(f"WITH RECURSIVE {_SCORES} SELECT damage_class, tp, fp, fn, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(ap, 4) AS ap FROM sc")
def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    """E3, E4, W6, W7."""
    p, t = _boxes(spark, d)
    s = evaluate.scores(checkpoint(evaluate.match_boxes(p, t)), t)
    return s.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(c) for c, k in s.dtypes])


@query(f"WITH RECURSIVE {_SCORES} SELECT round(avg(f1), 4) AS macro_f1, round(avg(ap), 4) AS map50, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) AS n_classes FROM sc")
def eval_totals(spark: SparkSession, d: str) -> DataFrame:
    """E5."""
    p, t = _boxes(spark, d)
    r = evaluate.totals(evaluate.scores(checkpoint(evaluate.match_boxes(p, t)), t))
    return r.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(c) for c, k in r.dtypes])


# --- splits by blocks of a numbering



_PLACE = """
    p AS (SELECT DISTINCT image_id, coalesce(nullif(trim(regexp_replace(lower(country), '[\\s_\\-]+', ' ', 'g')), ''), nullif(trim(regexp_replace(lower(regexp_extract(image_id, '^\\s*(.+?)_(\\d+)', 1)), '[\\s_\\-]+', ' ', 'g')), '')) AS c,
        coalesce(image_index, try_cast(nullif(regexp_extract(image_id, '^\\s*(.+?)_(\\d+)', 2), '') AS BIGINT)) AS i, len(boxes) AS n FROM annotations),
    a AS (SELECT image_id, min(coalesce(upper(c[1]) || c[2:], 'unknown')) AS country, coalesce(min(i), 0) AS image_index, min(n) AS n FROM p GROUP BY 1)"""


@query(f"""
    WITH {_PLACE}, r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY image_index, image_id) - 1 AS rn, count(*) OVER (PARTITION BY country) AS k FROM a)
    SELECT image_id, country, CASE WHEN rn < floor(k * 0.7e0) THEN 'train' WHEN rn < greatest(floor(k * 0.7e0), floor(k * (0.7e0 + 0.15e0))) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_contiguous(spark: SparkSession, d: str) -> DataFrame:
    """One block of the numbering for each split, by country in any spelling. Country and index are read from
    the id where they are missing; an image that tells neither way is of country 'unknown', at index 0."""
    c, i = misc.picture_place(F.col("image_id"), F.col("country"), F.col("image_index"))
    a = table(spark, d, "annotations").groupBy("image_id").agg(F.min(misc.country_name(c)).alias("country"), F.coalesce(F.min(i), F.lit(0).cast("long")).alias("image_index"))
    return training.contiguous_splits(a, "country", ["image_index", "image_id"], joint=True).select("image_id", "country", "split")


@query("""
    WITH s AS (SELECT survey_id, row_number() OVER (ORDER BY survey_id) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT survey_id FROM frames))
    SELECT survey_id, CASE WHEN n = 1 OR rn < greatest(1, floor(n * 0.7e0)) THEN 'train' WHEN rn < greatest(1, floor(n * 0.7e0), floor(n * (0.7e0 + 0.15e0))) THEN 'val' ELSE 'test' END AS split FROM s""")
def split_by_survey(spark: SparkSession, d: str) -> DataFrame:
    """X1."""
    return training.survey_splits(table(spark, d, "frames"))


@query(f"WITH {_PLACE} SELECT country, count(*) AS n_images, count(*) FILTER (n = 0) AS n_negative, CAST(sum(n) AS BIGINT) AS n_boxes FROM a GROUP BY 1")
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What a dataset holds: every image, by its country in any spelling or else the start of its id."""
    c, _ = misc.picture_place(F.col("image_id"), F.col("country"), F.col("image_index"))
    a = table(spark, d, "annotations").groupBy("image_id").agg(F.min(misc.country_name(c)).alias("country"), F.min(F.size("boxes")).alias("n"))
    return a.groupBy("country").agg(F.count("*").alias("n_images"), F.count_if(F.col("n") == 0).alias("n_negative"), F.sum("n").alias("n_boxes"))


# --- exports


@query(f"""
    SELECT defect_id, damage_class, round(lat, 6) AS latitude, round(lon, 6) AS longitude, location_method, round(uncertainty_m, 2) AS location_uncertainty_m, '' AS road_name, coalesce(segment_id, '') AS road_segment_id, CASE WHEN segment_id IS NULL THEN '' ELSE 'openstreetmap' END AS road_source,
        round(confidence, 4) AS confidence, severity, severity_source, status, 'unknown' AS trend, observation_count, survey_id AS survey_ids, strftime(first_seen, '%Y-%m-%dT%H:%M:%S.%fZ') AS first_seen, strftime(last_seen, '%Y-%m-%dT%H:%M:%S.%fZ') AS last_seen,
        coalesce(model_id, '') AS model_id, processing_run_id, representative_frame_id, '' AS representative_image FROM ({DEFECTS}) d1""")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """O1, O2, O3."""
    x = _defects(spark, d).withColumns({"survey_ids": F.array("survey_id"), "road_source": F.when(F.col("segment_id").isNotNull(), "openstreetmap")})
    return export.csv_rows(x)


@query(f"SELECT defect_id, 'Feature' AS type, 'Point' AS geometry, round(lon, 6) AS lon, round(lat, 6) AS lat, damage_class, uncertainty_m, segment_id FROM ({DEFECTS}) d1")
def export_features(spark: SparkSession, d: str) -> DataFrame:
    """Each feature's JSON, read again."""
    get = lambda path, name, kind="string": F.get_json_object("value", f"$.{path}").cast(kind).alias(name)
    f = export.features(_defects(spark, d))
    return f.select(
        get("properties.defect_id", "defect_id"), get("type", "type"), get("geometry.type", "geometry"), get("geometry.coordinates[0]", "lon", "double"), get("geometry.coordinates[1]", "lat", "double"),
        get("properties.damage_class", "damage_class"), get("properties.uncertainty_m", "uncertainty_m", "double"), get("properties.segment_id", "segment_id"),
    )


@query("""
    WITH d AS (SELECT DISTINCT detection_id, x1, y1, x2, y2, greatest(greatest(x2 - x1, y2 - y1) * 1.5e0, 80e0) AS h FROM detections),
    c AS (SELECT *, greatest(0, floor((x1 + x2) / 2 - h)) AS cx1, greatest(0, floor((y1 + y2) / 2 - h)) AS cy1, least(1920, floor((x1 + x2) / 2 + h)) AS cx2, least(1080, floor((y1 + y2) / 2 + h)) AS cy2 FROM d)
    SELECT detection_id, CAST(CASE WHEN cx2 <= cx1 OR cy2 <= cy1 THEN 0 ELSE cx1 END AS BIGINT) AS crop_x1, CAST(CASE WHEN cx2 <= cx1 OR cy2 <= cy1 THEN 0 ELSE cy1 END AS BIGINT) AS crop_y1, CAST(CASE WHEN cx2 <= cx1 OR cy2 <= cy1 THEN 1920 ELSE cx2 END AS BIGINT) AS crop_x2, CAST(CASE WHEN cx2 <= cx1 OR cy2 <= cy1 THEN 1080 ELSE cy2 END AS BIGINT) AS crop_y2 FROM c""")
def export_crops(spark: SparkSession, d: str) -> DataFrame:
    """O9."""
    x = table(spark, d, "detections").select("detection_id", "x1", "y1", "x2", "y2").distinct().withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    return export.crop_rectangle(x).select("detection_id", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query(f"""
    WITH s AS ({SEGMENTS}), v AS (SELECT way_id, seg_ord, a_lon AS lon, a_lat AS lat FROM s UNION ALL SELECT way_id, max(seg_ord) + 1, arg_max(b_lon, seg_ord), arg_max(b_lat, seg_ord) FROM s GROUP BY 1)
    SELECT way_id, count(*) AS n_points, string_agg(printf('%.5f %.5f', lon, lat), ',' ORDER BY seg_ord) AS points FROM v GROUP BY 1""")
def export_way_lines(spark: SparkSession, d: str) -> DataFrame:
    """The segments of a way as one line."""
    w = export.way_lines(_segments(spark, d)).select("way_id", F.from_json("geometry", "type string, coordinates array<array<double>>").alias("g"))
    return w.select("way_id", F.size("g.coordinates").cast("long").alias("n_points"), F.array_join(F.transform("g.coordinates", lambda p: F.format_string("%.5f %.5f", p[0], p[1])), ",").alias("points"))


# --- detectors and the whole pipeline


@query(f"""
    SELECT frame_id, ['longitudinal_crack', 'transverse_crack', 'alligator_crack', 'pothole'][CAST(floor({unit("0", "concat_ws('|', frame_id, 'class')")} * 4) AS INT) + 1] AS damage_class, round(0.3e0 + 0.7e0 * {unit("0", "concat_ws('|', frame_id, 'confidence')")}, 6) AS confidence,
        round({unit("0", "concat_ws('|', frame_id, 'x')")} * 0.92e0 * width, 3) AS x1, round((0.4e0 + {unit("0", "concat_ws('|', frame_id, 'y')")} * 0.54e0) * height, 3) AS y1
    FROM frames WHERE {unit("0", "concat_ws('|', frame_id, 'hit')")} < 0.3e0""")
def detect_fake(spark: SparkSession, d: str) -> DataFrame:
    """U1, U4."""
    x = detect.fake_detector(table(spark, d, "frames"))
    return x.select("frame_id", "damage_class", F.round("confidence", 6).alias("confidence"), F.round("x1", 3).alias("x1"), F.round("y1", 3).alias("y1"))


@query()
def process_defects(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from fixes and detections to defects."""
    x = _one_of_each(table(spark, d, "detections"))
    out = process(table(spark, d, "location_records"), table(spark, d, "frames"), x)["defects"]
    return out.select("cluster_id", "damage_class", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "uncertainty_m", "confidence", "observation_count", "first_seen", "last_seen")


# --- windows over the star schema: ranking and top-k per group


@query("""SELECT survey_id, frame_id, rn FROM (SELECT survey_id, frame_id, row_number() OVER (PARTITION BY survey_id ORDER BY obs_uncertainty_m DESC NULLS LAST, frame_id) AS rn FROM frames) WHERE rn <= 3""")
def window_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The three least certain frames of each survey, a top-k report."""
    w = Window.partitionBy("survey_id").orderBy(F.desc_nulls_last("obs_uncertainty_m"), "frame_id")
    return table(spark, d, "frames").select("survey_id", "frame_id", BIG(F.row_number().over(w)).alias("rn")).where("rn <= 3")
