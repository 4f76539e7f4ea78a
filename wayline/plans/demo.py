"""A made-up drive and made-up streets, the same each time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from wayline.functions import geo

#: Where the demo begins, when, and how it goes: (bearing, seconds, metres a second).
START, T0 = (40.19231, 44.52991), 1_787_049_731_000
LEGS = ((90.0, 70, 10.0), (0.0, 60, 10.0), (0.0, 25, 0.0), (270.0, 70, 10.0), (180.0, 60, 10.0))


def _ahead(lat: float, lon: float, bearing: float, metres: float) -> tuple[float, float]:
    p, a, th = math.radians(lat), metres / geo.EARTH_RADIUS_M, math.radians(bearing)
    s = math.sin(p) * math.cos(a) + math.cos(p) * math.sin(a) * math.cos(th)
    return math.degrees(math.asin(s)), lon + math.degrees(math.atan2(math.sin(th) * math.sin(a) * math.cos(p), math.cos(a) - math.sin(p) * s))


def demo_drive(spark: SparkSession, survey_id: str = "demo") -> DataFrame:
    """Fixes of a drive around a block at one a second, with a stop of 25 s and a few fixes that don't pass cleaning."""
    rows, at, (lat, lon) = [], 0, START
    for k, (bearing, seconds, speed) in enumerate(LEGS):
        for s in range(seconds + (k == len(LEGS) - 1)):
            i = at + s
            rows.append((f"r{i:05d}", survey_id, T0 + i * 1000, *_ahead(lat, lon, bearing, s * speed), 60.0 if i % 47 == 46 else 4.0 + i % 5, speed, bearing))
        lat, lon = _ahead(lat, lon, bearing, seconds * speed)
        at += seconds
    return spark.createDataFrame(rows, "record_id string, survey_id string, t long, lat double, lon double, accuracy_m double, speed_mps double, heading_deg double")


def demo_roads(spark: SparkSession) -> DataFrame:
    """Segments of the streets around the block and of one that is never driven."""
    deg = 0.0063
    corners = [(0.0, -0.1), (0.0, 1.4), (1.0, 1.4), (1.0, -0.1), (0.0, -0.1)]
    ways = [("1", "South Street", corners[0:2]), ("2", "East Street", corners[1:3]), ("3", "North Street", corners[2:4]), ("4", None, corners[3:5]), ("9", "Far Street", [(3.0, 0.0), (3.0, 1.0)])]
    rows = []
    for way, name, (a, b) in ways:
        for i in range(4):
            p = [(START[0] + (a[0] + (b[0] - a[0]) * k / 4) * deg, START[1] + (a[1] + (b[1] - a[1]) * k / 4) * deg) for k in (i, i + 1)]
            rows.append((f"way/{way}#{i}", f"way/{way}", i, *p[0], *p[1], name, "residential", False))
    return spark.createDataFrame(rows, "segment_id string, way_id string, seg_ord long, a_lat double, a_lon double, b_lat double, b_lon double, name string, highway string, oneway boolean")
