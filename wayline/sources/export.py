"""Sinks: flat rows, CSV, GeoJSON and attribution."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.misc import iso_z

#: Notices owed by source; fixed values.
ATTRIBUTION = {"openstreetmap": "© OpenStreetMap contributors, ODbL 1.0"}


#: The columns of a table of defects, in their order; a fixed format.
COLUMNS = (
    "defect_id", "damage_class", "latitude", "longitude", "location_method", "location_uncertainty_m", "road_name", "road_segment_id", "road_source", "confidence", "severity", "severity_source",
    "status", "trend", "observation_count", "survey_ids", "first_seen", "last_seen", "model_id", "processing_run_id", "representative_frame_id", "representative_image",
)
_FROM = {"latitude": "lat", "longitude": "lon", "location_uncertainty_m": "uncertainty_m", "road_segment_id": "segment_id", "representative_image": "representative_image_path"}
_UNSET = {"severity": "unassessed", "severity_source": "other", "status": "probable", "trend": "unknown", "location_method": "interpolated_phone_gps"}


def csv_rows(defects: DataFrame) -> DataFrame:
    """COLUMNS of defects (lat, lon, uncertainty_m, segment_id, survey_ids array and the rest by their names): coordinates
    to 6 places, metres to 2, confidence to 4, lists joined by ';', times as UTC text, nulls and absent columns empty or
    what is meant by them."""
    kinds = dict(defects.dtypes)
    places = {"latitude": 6, "longitude": 6, "location_uncertainty_m": 2, "confidence": 4}
    out = []
    for name in COLUMNS:
        own = _FROM.get(name, name)
        c = F.col(own) if own in kinds else F.lit(None).cast("string")
        kind = kinds.get(own, "string")
        if name in places:
            c = F.round(c.cast("double"), places[name])
        elif name == "observation_count":
            c = F.coalesce(c.cast("long"), F.lit(0).cast("long"))
        else:
            text = F.concat_ws(";", c) if kind.startswith("array") else iso_z(c.cast("timestamp")) if kind.startswith("timestamp") else c.cast("string")
            c = F.coalesce(text, F.lit(_UNSET.get(name, "")))
        out.append(c.alias(name))
    return defects.select(*out)


def flat_rows(defects: DataFrame) -> DataFrame:
    """Text-friendly rows of any columns: coordinates to 6 places, metres to 2, confidence to 4, lists joined by ';',
    nulls empty."""
    places = {"lat": 6, "lon": 6, "uncertainty_m": 2, "confidence": 4}
    out = []
    for name, kind in defects.dtypes:
        c = F.col(name)
        if name in places:
            c = F.round(c, places[name])
        elif kind.startswith("array"):
            c = F.concat_ws(";", c)
        out.append(c.alias(name) if name in places else F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return defects.select(*out)


def required_attribution(defects: DataFrame, source: str = "road_source") -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in ATTRIBUTION.items() for x in kv])
    return defects.select(F.try_element_at(known, F.lower(source)).alias("notice")).where("notice is not null").distinct()


def _sidecar(spark: SparkSession, path: str, text: str | None) -> None:
    """Writes the text to path on any file system, or deletes what is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if text is None:
        fs.delete(hadoop, False)
        return
    out = fs.create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(defects: DataFrame, folder: str, notices: list[str] | None = None) -> None:
    """csv_rows as CSV files with a header in `folder`, one for each partition, and ATTRIBUTION.txt next to them if
    notices are owed; a stale one goes."""
    csv_rows(defects).write.mode("overwrite").option("header", True).csv(folder)
    _sidecar(defects.sparkSession, f"{folder.rstrip('/')}/ATTRIBUTION.txt", "\n".join(sorted(notices)) + "\n" if notices else None)


def features(defects: DataFrame) -> DataFrame:
    """(value): a GeoJSON Feature for each row, coordinates as [lon, lat], the other columns as properties."""
    props = F.struct(*[F.col(c) for c in defects.columns if c not in ("lat", "lon")])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 6), F.round("lat", 6)).alias("coordinates"))
    return defects.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("value"))


def write_geojson_lines(defects: DataFrame, folder: str) -> None:
    """One Feature a line (GeoJSON text sequence), written by all tasks."""
    features(defects).write.mode("overwrite").text(folder)


#: A document in one piece is for a map's view; more features are refused.
MOST_FEATURES = 100_000


def feature_collection(defects: DataFrame, notices: list[str] | None = None) -> str:
    """A whole FeatureCollection as text, with a header that counts the features and tells the notices owed. More than
    MOST_FEATURES rows are an error: use write_geojson_lines for them."""
    rows = features(defects).limit(MOST_FEATURES + 1).collect()
    if len(rows) > MOST_FEATURES:
        raise ValueError("too many features for one document; use write_geojson_lines")
    head = {"schema_version": 1, "feature_count": len(rows), "attribution": sorted(notices) if notices else None}
    return '{"type":"FeatureCollection","header":' + json.dumps(head, ensure_ascii=False) + ',"features":[' + ",".join(r.value for r in rows) + "]}"


def way_lines(segments: DataFrame) -> DataFrame:
    """(way_id, name, highway, geometry): the segments of each way as one GeoJSON line."""
    p = F.array_sort(F.collect_list(F.struct("seg_ord", "a_lon", "a_lat", "b_lon", "b_lat")))
    last = F.max_by(F.struct("name", "highway"), "seg_ord")
    w = segments.groupBy("way_id").agg(p.alias("p"), last.alias("m"))
    line = F.concat(F.transform("p", lambda s: F.array(s["a_lon"], s["a_lat"])), F.array(F.array(F.element_at("p", -1)["b_lon"], F.element_at("p", -1)["b_lat"])))
    return w.select("way_id", "m.name", "m.highway", F.to_json(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))).alias("geometry"))


def crop_rectangle(df: DataFrame, padding: float = 1.0, least_px: int = 160) -> DataFrame:
    """df (x1..y2, width, height) with crop_x1..crop_y2 around each box, within the image."""
    half = F.greatest(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * (0.5 + padding), F.lit(least_px / 2.0))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    zero = F.lit(0)
    out = {
        "crop_x1": F.greatest(zero, F.floor(cx - half)), "crop_y1": F.greatest(zero, F.floor(cy - half)),
        "crop_x2": F.least(F.col("width"), F.floor(cx + half)), "crop_y2": F.least(F.col("height"), F.floor(cy + half)),
    }
    df = df.withColumns({k: v.cast("long") for k, v in out.items()})
    gone = (F.col("crop_x2") <= F.col("crop_x1")) | (F.col("crop_y2") <= F.col("crop_y1"))
    whole = {"crop_x1": zero, "crop_y1": zero, "crop_x2": F.col("width"), "crop_y2": F.col("height")}
    return df.withColumns({k: F.when(gone, v).otherwise(F.col(k)).cast("long") for k, v in whole.items()})
