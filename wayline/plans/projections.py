"""Road segments, defects and driven frames projected from the star-schema tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SEGMENTS = """
    SELECT concat('way/', s_nationkey, '#', i) AS segment_id, concat('way/', s_nationkey) AS way_id, CAST(i AS BIGINT) AS seg_ord,
        40.18231e0 + s_nationkey * 0.001e0 + 0.00003e0 AS a_lat, 44.51491e0 + i * 0.001e0 AS a_lon,
        40.18231e0 + s_nationkey * 0.001e0 + 0.00003e0 AS b_lat, 44.51491e0 + (i + 1) * 0.001e0 AS b_lon,
        CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE n_name END AS name, 'residential' AS highway, s_nationkey % 4 = 0 AS oneway
    FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier) s
    JOIN nation ON n_nationkey = s_nationkey
"""
DEFECTS = """
    SELECT concat('def_', o_orderkey) AS defect_id,
        CASE o_orderkey % 4 WHEN 0 THEN 'pothole' WHEN 1 THEN 'alligator_crack' WHEN 2 THEN 'longitudinal_crack' ELSE 'transverse_crack' END AS damage_class,
        CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'P' THEN 'rejected' ELSE 'probable' END AS status,
        40.18231e0 + (o_custkey % 25) * 0.001e0 + (o_orderkey % 7) * 0.00001e0 AS lat, 44.51491e0 + (o_orderkey % 997) * 0.00001e0 AS lon,
        5.0e0 + o_orderkey % 10 AS uncertainty_m, (o_orderkey % 100) / 100.0e0 AS confidence, concat('s', o_custkey % 150) AS survey_id,
        CASE WHEN o_orderkey % 11 = 0 THEN concat('way/', o_custkey % 25, '#0') END AS segment_id,
        CASE o_orderkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'unassessed' END AS severity, CASE WHEN o_orderkey % 5 < 3 THEN 'ai' ELSE 'other' END AS severity_source,
        CASE WHEN o_orderkey % 13 = 0 THEN 'manual_correction' ELSE 'interpolated_phone_gps' END AS location_method, o_orderdate AS first_seen, o_orderdate AS last_seen, CAST(1 + o_orderkey % 4 AS BIGINT) AS observation_count,
        CASE WHEN o_orderkey % 9 = 0 THEN 'fake-1' WHEN o_orderkey % 9 < 8 THEN 'det-v1' END AS model_id, concat('run_', o_custkey % 10) AS processing_run_id, concat('frm_', o_orderkey) AS representative_frame_id
    FROM orders
"""
#: Six kinds of review, one for each line of an order; some name a value that isn't valid, some a defect that isn't there.
REVIEWS = """
    SELECT concat('rev_', l_orderkey, '_', l_linenumber) AS review_id, concat('def_', l_orderkey + CASE WHEN l_partkey % 97 = 0 THEN 100000000 ELSE 0 END) AS defect_id,
        CASE l_partkey % 6 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'change_class' WHEN 3 THEN 'change_severity' WHEN 4 THEN 'adjust_location' ELSE 'add_note' END AS action,
        concat('reviewer_', l_suppkey % 5) AS reviewer, l_shipdate AS reviewed_at,
        CASE WHEN l_partkey % 6 = 2 AND l_suppkey % 7 <> 0 THEN CASE l_suppkey % 4 WHEN 0 THEN 'pothole' WHEN 1 THEN 'alligator_crack' WHEN 2 THEN 'longitudinal_crack' ELSE 'transverse_crack' END END AS damage_class,
        CASE WHEN l_partkey % 6 = 3 AND l_suppkey % 7 <> 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END END AS severity,
        CASE WHEN l_partkey % 6 = 4 THEN 40.0e0 + l_suppkey * 0.001e0 END AS lat, CASE WHEN l_partkey % 6 = 4 AND l_suppkey % 11 <> 0 THEN 44.0e0 + l_suppkey * 0.01e0 END AS lon, CASE WHEN l_partkey % 6 = 5 THEN 'seen' END AS note
    FROM lineitem
"""
#: Observations of defects, with the ids of their detections as text.
OBSERVATIONS = """
    SELECT concat('obs_', l_orderkey, '_', l_linenumber) AS observation_id, concat('def_', l_orderkey) AS defect_id, concat('s', l_suppkey % 150) AS survey_id, l_shipdate AS observed_at, l_discount AS confidence,
        concat('frm_', l_orderkey + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) AS representative_frame_id,
        CASE WHEN l_linenumber % 2 = 0 THEN concat('det_', l_orderkey, '_', l_linenumber, ',det_', l_orderkey, '_', l_linenumber, 'b') ELSE concat('det_', l_orderkey, '_', l_linenumber) END AS detection_ids
    FROM lineitem
"""
DRIVEN = """
    SELECT concat('f', event_id) AS frame_id, concat('s', user_id) AS survey_id, CAST(seq * 1000 AS BIGINT) AS t_epoch_ms, CAST(seq AS DOUBLE) AS video_time_s,
        40.18231e0 + (user_id % 25) * 0.001e0 AS lat, 44.51491e0 + seq * 0.000118e0 AS lon, 8.0e0 AS uncertainty_m, 90.0e0 AS heading_deg
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) e
"""


def project(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The projection over the Parquet files themselves, without temporary views."""
    sql = re.sub(r"\b(FROM|JOIN) (supplier|nation|orders|events|lineitem)\b", lambda m: f"{m[1]} parquet.`{d}/{m[2]}.parquet`", sql)
    return spark.sql(sql)
