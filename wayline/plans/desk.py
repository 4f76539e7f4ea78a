"""Queries of review, lists, training sets and retention, and the SQL that says the same."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import dataset, retention, reviews, rollup, track
from wayline.plans.projections import DEFECTS, OBSERVATIONS, REVIEWS, project
from wayline.plans.survey import _CLEAN, hav
from wayline.schema import ENUMS
from wayline.session import checkpoint, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: The detections that the observations name, with the boxes that a line of an order gives.
BOXES = """
    SELECT detection_id, concat('frm_', k) AS frame_id, x AS x1, y AS y1, x + w AS x2, y + w AS y2
    FROM (SELECT concat('det_', l_orderkey, '_', l_linenumber) AS detection_id, l_orderkey AS k, l_quantity AS x, l_tax * 1000 AS y, 10.0e0 + l_linenumber AS w FROM lineitem
        UNION ALL SELECT concat('det_', l_orderkey, '_', l_linenumber, 'b'), l_orderkey, l_quantity + 5, l_tax * 900, 20.0e0 FROM lineitem) b
"""
#: The defects of which there is an image.
IMAGES = "SELECT concat('def_', o_orderkey) AS defect_id, 1920 AS width, 1080 AS height FROM orders WHERE o_totalprice > 1000"
NOW = datetime(2024, 4, 20, tzinfo=timezone.utc)
LIMIT = 200


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, DEFECTS).withColumn("survey_ids", F.array("survey_id"))


def _reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return reviews.split_reviews(_defects(spark, d), project(spark, d, REVIEWS))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, OBSERVATIONS).withColumn("detection_ids", F.split("detection_ids", ","))


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    return reviews.apply_reviews(_defects(spark, d), _reviews(spark, d)[0])


_IN = lambda c, kind: f"coalesce({c} IN ({', '.join(repr(v) for v in ENUMS[kind])}), FALSE)"
_LOG = f"""
    df AS ({DEFECTS}), rw AS ({REVIEWS}), ob AS ({OBSERVATIONS}),
    p0 AS (SELECT rw.*, CASE WHEN action = 'change_class' AND NOT {_IN('rw.damage_class', 'damage_class')} THEN 'damage_class_required' WHEN action = 'change_severity' AND NOT {_IN('rw.severity', 'severity')} THEN 'severity_required'
        WHEN action = 'adjust_location' AND NOT coalesce(rw.lat BETWEEN -90 AND 90 AND rw.lon BETWEEN -180 AND 180, FALSE) THEN 'location_required' WHEN df.defect_id IS NULL THEN 'unknown_defect' END AS problem FROM rw LEFT JOIN df ON df.defect_id = rw.defect_id),
    pb AS (SELECT * REPLACE (CASE WHEN problem IS NULL AND row_number() OVER (PARTITION BY review_id, problem IS NULL ORDER BY reviewed_at, defect_id, action, reviewer, damage_class NULLS FIRST, severity NULLS FIRST, lat NULLS FIRST, lon NULLS FIRST, note NULLS FIRST) > 1 THEN 'duplicate_id' ELSE problem END AS problem) FROM p0),
    ok AS (SELECT review_id, defect_id, action, reviewer, reviewed_at, note, CASE WHEN action IN ('approve', 'change_class', 'adjust_location') THEN 'verified' WHEN action = 'reject' THEN 'rejected' END AS n_status, CASE WHEN action = 'change_class' THEN damage_class END AS n_class,
        CASE WHEN action = 'change_severity' THEN severity END AS n_sev, CASE WHEN action = 'adjust_location' THEN lat END AS n_lat, CASE WHEN action = 'adjust_location' THEN lon END AS n_lon FROM pb WHERE problem IS NULL),
    fo AS (SELECT defect_id, {', '.join(f"arg_max({c}, (reviewed_at, review_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("n_status", "n_class", "n_sev", "n_lat", "n_lon"))}, count(*) AS n_reviews, max(reviewed_at) AS updated_at, bool_or(action = 'change_class') AS corrected FROM ok GROUP BY 1),
    st AS (SELECT df.* REPLACE (coalesce(n_status, status) AS status, coalesce(n_class, damage_class) AS damage_class, coalesce(n_sev, severity) AS severity, CASE WHEN n_sev IS NOT NULL THEN 'human' ELSE severity_source END AS severity_source, coalesce(n_lat, lat) AS lat, coalesce(n_lon, lon) AS lon,
        CASE WHEN n_lat IS NOT NULL THEN 'manual_correction' ELSE location_method END AS location_method, CASE WHEN n_lat IS NOT NULL THEN 2e0 ELSE uncertainty_m END AS uncertainty_m), coalesce(n_reviews, 0) AS n_reviews, updated_at, coalesce(corrected, FALSE) AS class_corrected FROM df LEFT JOIN fo ON fo.defect_id = df.defect_id)"""


@query(f"WITH {_LOG} SELECT defect_id, status, damage_class, severity, severity_source, round(lat, 6) AS lat, round(lon, 6) AS lon, location_method, uncertainty_m, n_reviews, updated_at, class_corrected FROM st")
def store_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Defects after six kinds of review."""
    s = _reviewed(spark, d)
    return s.select("defect_id", "status", "damage_class", "severity", "severity_source", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "location_method", "uncertainty_m", "n_reviews", "updated_at", "class_corrected")


_BEFORE = lambda c, base: f"CASE WHEN {c} IS NOT NULL THEN coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY ok.defect_id ORDER BY reviewed_at, review_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {base}) END"


@query(f"""WITH {_LOG} SELECT review_id, ok.defect_id, action, n_status AS new_status, {_BEFORE('n_status', 'df.status')} AS old_status, n_class AS new_class, {_BEFORE('n_class', 'df.damage_class')} AS old_class, n_sev AS new_severity, {_BEFORE('n_sev', 'df.severity')} AS old_severity,
    round(n_lat, 6) AS new_lat, round({_BEFORE('n_lat', 'df.lat')}, 6) AS old_lat FROM ok JOIN df ON df.defect_id = ok.defect_id""")
def store_review_log(spark: SparkSession, d: str) -> DataFrame:
    """Each review with what it found before it."""
    x = reviews.review_log(_defects(spark, d), _reviews(spark, d)[0])
    both = [F.col(f"{side}.{c}").alias(f"{name}_{short}") for side, name in (("new", "new"), ("previous", "old")) for c, short in (("status", "status"), ("damage_class", "class"), ("severity", "severity"))]
    return x.select("review_id", "defect_id", "action", *both, F.round("new.lat", 6).alias("new_lat"), F.round("previous.lat", 6).alias("old_lat"))


@query(f"WITH {_LOG} SELECT review_id, problem FROM pb WHERE problem IS NOT NULL")
def store_reviews_refused(spark: SparkSession, d: str) -> DataFrame:
    """Reviews that can't be applied, and why."""
    return _reviews(spark, d)[1]


@query(f"WITH {_LOG} SELECT defect_id, confidence, first_seen FROM st WHERE damage_class = 'pothole' AND status = 'verified' AND confidence >= 0.5")
def list_defects(spark: SparkSession, d: str) -> DataFrame:
    """P2, P6."""
    return reviews.list_defects(_reviewed(spark, d), damage_class="pothole", status="verified", min_confidence=0.5).select("defect_id", "confidence", "first_seen")


@query(f"""WITH {_LOG}, pg AS (SELECT * FROM st WHERE status = 'probable' ORDER BY first_seen, defect_id LIMIT {LIMIT}),
    ids AS (SELECT defect_id, observed_at, observation_id, unnest(string_split(detection_ids, ',')) AS id, generate_subscripts(string_split(detection_ids, ','), 1) AS k FROM ob),
    tp AS (SELECT *, row_number() OVER (PARTITION BY defect_id ORDER BY observed_at, observation_id, k) AS rn FROM ids),
    ls AS (SELECT defect_id, string_agg(id, ';' ORDER BY rn) AS detection_ids FROM tp WHERE rn <= 20 GROUP BY 1)
    SELECT pg.defect_id, damage_class, round(confidence, 4) AS confidence, severity, round(uncertainty_m, 2) AS uncertainty_m, first_seen, concat(pg.defect_id, '_crop.jpg') AS crop_image, coalesce(detection_ids, '') AS detection_ids FROM pg LEFT JOIN ls ON ls.defect_id = pg.defect_id""")
def list_queue(spark: SparkSession, d: str) -> DataFrame:
    """The page of the review queue, a top-k report."""
    q = reviews.queue(_reviewed(spark, d), _observations(spark, d), limit=LIMIT)
    return q.select("defect_id", "damage_class", "confidence", "severity", "uncertainty_m", "first_seen", "crop_image", F.concat_ws(";", "detection_ids").alias("detection_ids"))


_SUMMARY = "SELECT 'total' AS dimension, '' AS value, count(*) AS n, round(avg(uncertainty_m), 3) AS mean_uncertainty_m FROM st " + " ".join(f"UNION ALL SELECT '{c}', {c}, count(*), round(avg(uncertainty_m), 3) FROM st GROUP BY 2" for c in ("damage_class", "status", "severity"))


@query(f"WITH {_LOG} {_SUMMARY} UNION ALL SELECT 'table', 'reviews', count(*), NULL FROM ok UNION ALL SELECT 'table', 'surveys', count(*), NULL FROM surveys")
def list_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts by class, status and severity, and of tables."""
    return reviews.stats(_reviewed(spark, d), _reviews(spark, d)[0], table(spark, d, "surveys"))


@query(f"""WITH {_LOG}, sh AS (SELECT * FROM st WHERE confidence >= 0.9 ORDER BY first_seen, defect_id LIMIT 500)
    SELECT (SELECT count(*) FROM sh) AS n_shown, (SELECT count(*) >= 500 FROM sh) AS truncated, (SELECT count(*) FROM st) AS n_total, (SELECT count(DISTINCT survey_id) FROM st) AS n_surveys, (SELECT string_agg(DISTINCT model_id, ';' ORDER BY model_id) FROM st) AS models,
        (SELECT bool_or(model_id SIMILAR TO '(fake|scripted|null)-.*') FROM st) AS synthetic, concat_ws(';', CASE WHEN (SELECT bool_or(model_id SIMILAR TO '(fake|scripted|null)-.*') FROM st) THEN 'synthetic_detector' END, CASE WHEN NOT (SELECT bool_or(status = 'verified') FROM st) THEN 'none_verified' END) AS warnings""")
def list_map(spark: SparkSession, d: str) -> DataFrame:
    """What a map shows against all there is."""
    m = reviews.map_view(checkpoint(_reviewed(spark, d)), limit=500, min_confidence=0.9)
    p = m["provenance"].select(F.concat_ws(";", "models").alias("models"), "synthetic", F.concat_ws(";", "warnings").alias("warnings"))
    total = m["totals"].where("dimension = 'total'").select(F.col("n").alias("n_total"))
    return m["page"].join(total).join(m["surveys"].agg(F.count("*").alias("n_surveys"))).join(p)


@query(f"""WITH {_LOG} SELECT st.defect_id, coalesce(o.n, 0) AS n_observations, o.first AS first_observation, coalesce(r.n, 0) AS n_logged, r.last AS last_review FROM st
    LEFT JOIN (SELECT defect_id, count(*) AS n, arg_min(observation_id, (observed_at, observation_id)) AS first FROM ob GROUP BY 1) o ON o.defect_id = st.defect_id
    LEFT JOIN (SELECT defect_id, count(*) AS n, arg_max(review_id, (reviewed_at, review_id)) AS last FROM ok GROUP BY 1) r ON r.defect_id = st.defect_id""")
def list_details(spark: SparkSession, d: str) -> DataFrame:
    """Defects with their observations and reviews in order."""
    x = reviews.details(_reviewed(spark, d), _observations(spark, d), _reviews(spark, d)[0])
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    n = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(size(c))
    return x.select("defect_id", n("observations").alias("n_observations"), F.get("observations", 0)["observation_id"].alias("first_observation"), n("reviews").alias("n_logged"), F.get("reviews", F.size("reviews") - 1)["review_id"].alias("last_review"))


_SET = f"""{_LOG}, bx AS ({BOXES}), im AS ({IMAGES}),
    sn AS (SELECT DISTINCT defect_id, unnest(string_split(detection_ids, ',')) AS detection_id FROM ob),
    hb AS (SELECT DISTINCT st.defect_id, bx.detection_id, st.damage_class, CAST(trunc(x1) AS INT) AS a, CAST(trunc(y1) AS INT) AS b, CAST(trunc(x2) AS INT) AS c, CAST(trunc(y2) AS INT) AS e FROM st JOIN sn ON sn.defect_id = st.defect_id JOIN bx ON bx.detection_id = sn.detection_id AND bx.frame_id = st.representative_frame_id WHERE st.status = 'verified'),
    lb AS (SELECT defect_id, count(*) AS n, string_agg(concat(damage_class, ':', a, ',', b, ',', c, ',', e), ';' ORDER BY detection_id, a, b, c, e) AS boxes FROM hb GROUP BY 1),
    oc AS (SELECT st.*, lb.n, lb.boxes, CASE WHEN status = 'probable' THEN 'unreviewed' WHEN status NOT IN ('verified', 'rejected') THEN 'other_status' WHEN im.defect_id IS NULL THEN 'no_image' WHEN status = 'verified' AND lb.n IS NULL THEN 'no_box' WHEN status = 'verified' THEN 'positive' ELSE 'negative' END AS outcome
        FROM st LEFT JOIN im ON im.defect_id = st.defect_id LEFT JOIN lb ON lb.defect_id = st.defect_id),
    rc AS (SELECT defect_id AS image_id, survey_id, status AS source_status, class_corrected AND outcome = 'positive' AS corrected, CASE WHEN outcome = 'positive' THEN n ELSE 0 END AS n_boxes, CASE WHEN outcome = 'positive' THEN boxes ELSE '' END AS boxes FROM oc WHERE outcome IN ('positive', 'negative')),
    sv AS (SELECT survey_id, row_number() OVER (ORDER BY survey_id) - 1 AS rn, count(*) OVER () AS k FROM (SELECT DISTINCT survey_id FROM rc)),
    sp AS (SELECT survey_id, CASE WHEN k = 1 OR rn < greatest(1, floor(k * 0.7e0)) THEN 'train' WHEN rn < greatest(1, floor(k * 0.7e0), floor(k * (0.7e0 + 0.15e0))) THEN 'val' ELSE 'test' END AS split FROM sv)"""


def _set(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = _reviews(spark, d)[0]
    return dataset.reviewed_records(reviews.apply_reviews(_defects(spark, d), log), _observations(spark, d), project(spark, d, BOXES), project(spark, d, IMAGES), log)


@query(f"WITH {_SET} SELECT rc.image_id, rc.survey_id, source_status, corrected, CAST(n_boxes AS BIGINT) AS n_boxes, boxes, split FROM rc LEFT JOIN sp ON sp.survey_id = rc.survey_id")
def export_reviewed(spark: SparkSession, d: str) -> DataFrame:
    """The training set of reviewed defects, with its splits."""
    r = dataset.with_splits(checkpoint(_set(spark, d)[0]))
    return r.select("image_id", "survey_id", "source_status", "corrected", F.size("boxes").cast("long").alias("n_boxes"), dataset.record_text().alias("boxes"), "split")


@query(f"WITH {_SET} SELECT defect_id, outcome FROM oc")
def export_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What became of each defect on its way into the set."""
    return _set(spark, d)[1]


@query(f"""WITH {_SET}, h AS (SELECT md5(concat_ws('|', image_id, boxes)) AS h, * FROM rc)
    SELECT count(*) AS image_count, CAST(sum(n_boxes) AS BIGINT) AS annotation_count, count(*) FILTER (source_status = 'rejected') AS negative_image_count, count(*) FILTER (corrected) AS corrected_count, count(DISTINCT survey_id) AS survey_count,
        sha256(concat_ws(':', count(*), sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)), sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)))) AS content_hash, (SELECT count(*) FROM oc WHERE outcome = 'unreviewed') AS skipped_unreviewed,
        (SELECT count(*) FROM oc WHERE outcome = 'no_image') AS skipped_no_image, (SELECT count(*) FROM oc WHERE outcome = 'no_box') AS skipped_no_box, CASE WHEN count(DISTINCT survey_id) < 2 THEN 'one survey only; everything is for training' END AS warning FROM h""")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the set holds and what was left out."""
    records, outcomes = _set(spark, d)
    return dataset.manifest(records, outcomes)


@query(f"""
    WITH f AS (SELECT 'data/frames/' || frame_id || '.jpg' AS path, t_epoch_ms / 1000e0 AS made, 1000 AS size_bytes FROM frames UNION ALL SELECT video_path, epoch_us(started_at) / 1e6, 1000000 FROM surveys WHERE video_path IS NOT NULL UNION ALL SELECT 'data/evidence/' || frame_id || '.jpg', 0, 5 FROM frames),
    k AS (SELECT *, ({NOW.timestamp()}e0 - made) / 86400e0 AS age_days, CASE WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('mp4', 'mov', 'mkv', 'avi', 'm4v') THEN 'raw_video' WHEN path LIKE '%/frames/%' THEN 'frames' END AS kind FROM f)
    SELECT path, kind, round(age_days, 4) AS age_days, CAST(size_bytes AS BIGINT) AS size_bytes FROM k WHERE kind IS NOT NULL AND age_days >= CASE kind WHEN 'raw_video' THEN 30 ELSE 100 END""")
def retention_due(spark: SparkSession, d: str) -> DataFrame:
    """Files past their age."""
    file = lambda path, at, size: (path.alias("path"), at.alias("modified_at"), F.lit(size).cast("long").alias("size_bytes"))
    frames, surveys = table(spark, d, "frames"), table(spark, d, "surveys")
    at = F.timestamp_millis("t_epoch_ms")
    files = frames.select(*file(F.concat(F.lit("data/frames/"), "frame_id", F.lit(".jpg")), at, 1000)).unionByName(surveys.where("video_path is not null").select(*file(F.col("video_path"), F.col("started_at").cast("timestamp"), 1_000_000)))
    files = files.unionByName(frames.select(*file(F.concat(F.lit("data/evidence/"), "frame_id", F.lit(".jpg")), F.timestamp_seconds(F.lit(0)), 5)))
    return retention.find_expired(files, NOW, retention.RetentionPolicy(frames_days=100)).withColumn("age_days", F.round("age_days", 4))


@query("""
    WITH r AS (SELECT f.frame_id, count(x.frame_id) AS n, count(*) FILTER (x.confidence < 0.5) AS p, count(*) FILTER (x.confidence >= 0.5) AS v FROM frames f LEFT JOIN detections x ON x.frame_id = f.frame_id GROUP BY 1)
    SELECT count(*) AS n_images, count(*) FILTER (n > 0) AS n_images_with_regions, CAST(sum(n) AS BIGINT) AS n_regions, CAST(sum(p) AS BIGINT) AS n_persons, CAST(sum(v) AS BIGINT) AS n_vehicles, 'scripted-1' AS detectors, 'mosaic' AS methods FROM r""")
def redaction_totals(spark: SparkSession, d: str) -> DataFrame:
    """The totals of redaction, over detections in place of regions."""
    x = table(spark, d, "detections").select(F.col("frame_id").alias("image_id"), F.when(F.col("confidence") < 0.5, "person").otherwise("vehicle").alias("kind"))
    t = retention.summarize_reports(retention.redaction_reports(table(spark, d, "frames").select(F.col("frame_id").alias("image_id")), x, "scripted-1"))
    return t.withColumns({c: F.concat_ws(";", c) for c in ("detectors", "methods")})


@query(_CLEAN + f""",
    h AS (SELECT survey_id, coalesce(sum(hop), 0) / 1000 AS km FROM (SELECT *, {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS hop FROM k WINDOW w AS (PARTITION BY survey_id ORDER BY t)) GROUP BY 1), n AS (SELECT survey_id, count(*) AS n FROM cluster_candidates GROUP BY 1)
    SELECT h.survey_id, coalesce(n, 0) AS n_defects, round(km, 4) AS km, CASE WHEN km > 0 THEN round(coalesce(n, 0) / km, 4) END AS per_km FROM h LEFT JOIN n ON n.survey_id = h.survey_id""")
def rollup_per_km(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each survey by the kilometres driven."""
    x = rollup.defects_per_km(table(spark, d, "cluster_candidates"), track.track_distance(track.clean_track(table(spark, d, "location_records"))))
    return x.withColumns({"km": F.round("km", 4), "per_km": F.round("per_km", 4)})
