"""Queries of the general problems: near points and regions, stops and trips, implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.spatial import in_zones, near_pairs
from wayline.operators.spikes import implausible
from wayline.operators.trips import stops_and_trips
from wayline.session import table

NEAR_M = 6.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Frames of different surveys within 6 m, and fixes with the zones they lie in."""
    near = near_pairs(table(spark, d, "frames"), "frame_id", "survey_id", "obs_lat", "obs_lon", NEAR_M)
    inside = in_zones(table(spark, d, "location_records"), "record_id", "lat", "lon", table(spark, d, "zones"))
    return near.union(inside.select(F.col("id").alias("id_a"), F.col("zone_id").alias("id_b")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Stops and trips by the minutes in which they start and end."""
    found = stops_and_trips(table(spark, d, "location_records"), "survey_id", "t", "lat", "lon", "record_id")
    minute = lambda c: F.floor(F.col(c) / 60_000).cast("long")
    return found.select(F.col("source").alias("survey_id"), "kind", minute("t0").alias("start_min"), minute("t1").alias("end_min")).distinct()


def p2_trips(spark: SparkSession, d: str) -> DataFrame:
    """Stops and trips with start, end, duration, distance and, for stops, place."""
    found = stops_and_trips(table(spark, d, "location_records"), "survey_id", "t", "lat", "lon", "record_id")
    return found.select(
        F.col("source").alias("survey_id"), "kind", F.timestamp_millis("t0").alias("started_at"), F.timestamp_millis("t1").alias("ended_at"),
        ((F.col("t1") - F.col("t0")) / 1000).alias("duration_s"), F.round("distance_m", 1).alias("distance_m"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings that are impossible, stuck or a spike."""
    found = implausible(table(spark, d, "location_records"), "record_id", "survey_id", "t", "lat", "lon")
    return found.select(F.col("id").alias("record_id"), "field_name").distinct()


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_trips": p2_trips, "p7_found": p7_found}
_OK = "coalesce({0} BETWEEN -90 AND 90 AND {1} BETWEEN -180 AND 180 AND NOT isnan({0}) AND NOT isnan({1}) AND NOT ({0} = 0 AND {1} = 0), FALSE)"
_WRAP = lambda x: f"((({x}) + 540) % 360 + 360) % 360 - 180"
SQL: dict[str, str] = {
    # near frames meet in bands of latitude; a fix is inside a zone if a ray eastwards meets its edges an odd number of times
    "p1_found": f"""
        WITH f AS (SELECT DISTINCT frame_id, survey_id, obs_lat AS lat, obs_lon AS lon, CAST(floor(obs_lat / 0.0001e0) AS BIGINT) AS b FROM frames WHERE {_OK.format('obs_lat', 'obs_lon')}),
        g AS (SELECT *, b + unnest([-1, 0, 1]) AS nb FROM f),
        n AS (SELECT DISTINCT f.frame_id AS id_a, g.frame_id AS id_b FROM f JOIN g ON f.b = g.nb AND f.frame_id < g.frame_id AND f.survey_id IS DISTINCT FROM g.survey_id
            WHERE 2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians(g.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - f.lon) / 2), 2)))) <= {NEAR_M}),
        r AS (SELECT zone_id, 0 AS part, ring AS pts FROM zones UNION ALL SELECT zone_id, 1, hole FROM zones WHERE hole IS NOT NULL),
        e AS (SELECT zone_id, part, pts[i].lat AS y1, pts[i].lon AS x1, pts[i % len(pts) + 1].lat AS y2, pts[i % len(pts) + 1].lon AS x2 FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM r)),
        z AS (SELECT zone_id, min(y1) AS lo, max(y1) AS hi, any_value(x1) AS x0 FROM e GROUP BY 1),
        w AS (SELECT e.zone_id, min({_WRAP('x1 - x0')}) AS west, max({_WRAP('x1 - x0')}) AS east FROM e JOIN z ON z.zone_id = e.zone_id GROUP BY 1),
        l AS (SELECT DISTINCT record_id, lat, lon FROM location_records WHERE record_id IS NOT NULL AND {_OK.format('lat', 'lon')}),
        c AS (SELECT l.record_id, z.zone_id, l.lat, l.lon FROM l JOIN z ON l.lat BETWEEN z.lo AND z.hi JOIN w ON w.zone_id = z.zone_id WHERE {_WRAP('l.lon - z.x0')} BETWEEN w.west AND w.east),
        h AS (SELECT record_id, c.zone_id, part, lat, lon, y1, y2, {_WRAP('x1 - lon')} AS a, {_WRAP('x2 - x1')} AS d FROM c JOIN e ON e.zone_id = c.zone_id WHERE (y1 > lat) <> (y2 > lat)),
        k AS (SELECT record_id, zone_id FROM h WHERE a + d * (lat - y1) / (y2 - y1) > 0 GROUP BY record_id, zone_id, lat, lon HAVING count(*) FILTER (part = 0) % 2 = 1 AND count(*) FILTER (part = 1) % 2 = 0)
        SELECT id_a, id_b FROM n UNION SELECT record_id, zone_id FROM k""",
}
