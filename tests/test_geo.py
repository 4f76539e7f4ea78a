import math

from pyspark.sql import functions as F

from wayline.functions import geo, misc

R = geo.EARTH_RADIUS_M


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_distance_and_bearing(spark):
    r = one(spark, d=geo.haversine_m(40.0, 44.0, 40.0, 44.001), b=geo.initial_bearing_deg(40.0, 44.0, 41.0, 44.0), w=geo.initial_bearing_deg(0.0, 0.0, 0.0, -1.0), over=geo.haversine_m(0.0, 179.9995, 0.0, -179.9995))
    assert abs(r.d - math.radians(0.001) * R * math.cos(math.radians(40))) < 1e-3
    assert r.b == 0 and abs(r.w - 270) < 1e-9 and abs(r.over - math.radians(0.001) * R) < 1e-6


def test_bearings_go_the_short_way(spark):
    r = one(spark, d=geo.bearing_difference_deg(350.0, 10.0), i=geo.interpolate_bearing(350.0, 20.0, 0.5), n=geo.normalize_bearing(-10.0))
    assert (r.d, r.i, r.n) == (20, 5, 350)


def test_destination_comes_back(spark):
    p = geo.destination_point(61.0, 179.9999, 77.0, 500.0)
    r = one(spark, p=p, d=geo.haversine_m(F.lit(61.0), F.lit(179.9999), p["lat"], p["lon"]))
    assert abs(r.d - 500) < 1e-6 and -180 <= r.p.lon < 180


def test_projection_is_signed_and_clamped(spark):
    seg = (0.0, 0.0, 0.0, 0.01)
    r = one(spark, behind=geo.project_onto_segment(0.0, -0.005, *seg), beside=geo.project_onto_segment(0.001, 0.004, *seg), past=geo.project_onto_segment(0.0, 0.02, *seg), none=geo.project_onto_segment(1.0, 1.0, 0.0, 0.0, 0.0, 0.0))
    assert r.behind.fraction == 0 and abs(r.behind.distance_m - math.radians(0.005) * R) < 1e-6
    assert abs(r.beside.fraction - 0.4) < 1e-6 and abs(r.beside.distance_m - math.radians(0.001) * R) < 1e-3
    assert r.past.fraction == 1 and r.none.along_m == 0


def test_usable(spark):
    rows = [(1.0, 1.0, True), (0.0, 0.0, False), (0.0, 5.0, True), (float("nan"), 1.0, False), (91.0, 1.0, False), (1.0, -180.0, True), (None, 1.0, False)]
    df = spark.createDataFrame(rows, "lat double, lon double, want boolean")
    assert df.where(geo.usable("lat", "lon") != F.col("want")).count() == 0


def test_boxes_and_region(spark):
    r = one(spark, a=geo.iou(0, 0, 2, 2, 1, 1, 3, 3), edge=geo.iou(0, 0, 1, 1, 1, 0, 2, 1), ahead=geo.region_contains(0.5, 0.7), sky=geo.region_contains(0.5, 0.2), side=geo.region_contains(0.05, 0.5), unknown=geo.region_accepts(0, 0, 1, 1, F.lit(None).cast("int"), 5))
    assert abs(r.a - 1 / 7) < 1e-12 and r.edge == 0 and r.ahead and not r.sky and not r.side and r.unknown


def test_misc(spark):
    r = one(spark, way=misc.way_of_segment(F.lit("way/12#3")), n=misc.padded_id("trk", F.lit(7)), c=misc.rdd_class(F.lit("D40")), x=misc.rdd_class(F.lit("D44")), k=misc.file_kind(F.lit("a/frames/f1.JPG")), e=misc.format_elapsed(F.lit(3725)), v=misc.video_time_to_epoch_ms(F.lit(1000), F.lit(0.25)), neg=misc.video_time_to_epoch_ms(F.lit(1000), F.lit(-1.0)))
    assert (r.way, r.n, r.c, r.x, r.k, r.e, r.v, r.neg) == ("way/12", "trk00007", "pothole", None, "frames", "62:05", 1250, None)


def test_content_hash_ignores_order(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("s"))
    h = lambda d: d.agg(misc.content_hash(F.col("s"))).first()[0]
    assert h(df) == h(df.orderBy(F.desc("s")).repartition(3)) != h(df.limit(49))


def test_null_in_null_out(spark):
    n, one = F.lit(None).cast("double"), F.lit(1.0)
    f = {
        "haversine": geo.haversine_m(n, one, one, one), "haversine2": geo.haversine_m(one, one, one, n), "bearing": geo.initial_bearing_deg(one, n, one, one), "difference": geo.bearing_difference_deg(n, one), "between": geo.interpolate_bearing(one, n, 0.5),
        "destination": geo.destination_point(n, one, one, one)["lat"], "cross": geo.cross_track_distance_m(n, one, one, one, F.lit(2.0), one), "along": geo.along_track(one, one, one, n, F.lit(2.0), one), "distance": geo.project_onto_segment(n, one, one, one, F.lit(2.0), one)["distance_m"],
        "fraction": geo.project_onto_segment(one, n, one, one, F.lit(2.0), one)["fraction"], "box": geo.bounding_box(n, one, one)["min_lat"], "box2": geo.bounding_box(one, one, n)["max_lon"], "iou": geo.iou(n, one, one, one, one, one, one, one), "region": geo.expanded_region(n, one, one, one, one, one, one)["x1"],
        "cells": geo.cells_spanned(n, one), "ring": geo.ring_radius_px(one, one, n), "lon": geo.interpolate_lon(n, one, one), "pixels": geo.pixels_per_metre(n, one), "spacing": geo.estimated_spacing_m(n, one),
    }
    r = spark.range(1).select(*[c.alias(k) for k, c in f.items()]).first().asDict()
    assert {k for k, v in r.items() if v is not None} == set()
