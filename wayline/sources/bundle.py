"""Survey bundles: a folder for each survey with route.json, manifest.json, device.json and locations.jsonl."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.misc import safe_name

VERSION = 1
KNOWN_FILES = ("route.json", "manifest.json", "device.json", "locations.jsonl", "calibration.json", "video.mp4")
_LINE = "struct<t: variant, lat: variant, lon: variant, accuracy_m: variant, speed_mps: variant, heading_deg: variant, altitude_m: variant>"


def _survey(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_locations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(fixes, counts) of root/*/locations.jsonl. Blank lines are skipped; lines that aren't JSON objects, or lack a
    numeric t or a lat or lon, are counted. t must be a JSON number and loses its fraction; lat and lon may be numeric
    strings; other fields that can't be read are null."""
    raw = spark.read.text(os.path.join(root, "*", "locations.jsonl")).select(_survey(F.col("_metadata.file_path")).alias("survey_id"), "value").where(F.trim("value") != "")
    v = F.try_parse_json("value")
    obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    number = lambda k: F.try_variant_get(v, f"$.{k}", "double")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.t", "variant"))
    t = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number("t").cast("long"))
    rows = raw.select("survey_id", v.isNull().alias("bad"), (v.isNotNull() & ~obj).alias("other"), *[F.when(obj, x).alias(n) for n, x in [("t", t), *[(k, number(k)) for k in ("lat", "lon", "accuracy_m", "speed_mps", "heading_deg", "altitude_m")]]])
    whole = F.col("t").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    counts = rows.groupBy("survey_id").agg(F.count_if("bad").alias("n_malformed"), F.count_if("other").alias("n_not_objects"), F.count_if(~F.col("bad") & ~F.col("other") & ~whole).alias("n_incomplete"), F.count_if(whole).alias("n_fixes"))
    return rows.where(whole).drop("bad", "other"), counts


def read_json(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(survey_id, doc variant): doc is null for a file that isn't a JSON object."""
    files = spark.read.text(os.path.join(root, "*", name), wholetext=True).select(_survey(F.col("_metadata.file_path")).alias("survey_id"), F.try_parse_json("value").alias("v"))
    return files.select("survey_id", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")).alias("doc"))


def read_surveys(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(surveys, issues). The version is that of the manifest, else the route's, else 1; a newer one, a bad route or
    manifest and an unsafe id are errors; a missing anchor falls back to started_at, with a warning."""
    get = lambda d, k, t="string": F.try_variant_get(F.col(d), f"$.{k}", t)
    both = read_json(spark, root, "route.json").withColumnRenamed("doc", "route").join(read_json(spark, root, "manifest.json").withColumnRenamed("doc", "manifest"), "survey_id", "full_outer")
    start = F.try_to_timestamp(get("route", "started_at"))
    anchor = get("route", "recording_start_epoch_ms", "long")
    rows = both.select(
        "survey_id", F.coalesce(get("manifest", "schema_version", "int"), get("route", "schema_version", "int"), F.lit(1)).alias("schema_version"),
        start.alias("started_at"), F.try_to_timestamp(get("route", "ended_at")).alias("ended_at"), F.coalesce(anchor, F.unix_millis(start)).alias("recording_start_epoch_ms"),
        get("route", "app_version").alias("app_version"), F.col("route").isNull().alias("no_route"), F.col("manifest").isNull().alias("no_manifest"), (anchor.isNull() & F.col("route").isNotNull()).alias("no_anchor"),
    )
    issue = lambda when, severity, text: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("message")))
    found = F.array_compact(F.array(
        issue(F.col("no_route"), "error", "route.json is missing or unreadable"), issue(F.col("no_manifest"), "warning", "manifest.json is missing or unreadable"),
        issue(~safe_name(F.col("survey_id")), "error", "unsafe survey id"), issue(F.col("schema_version") > VERSION, "error", "newer bundle version"), issue(F.col("no_anchor"), "warning", "no recording anchor; started_at is used"),
    ))
    return rows.drop("no_route", "no_manifest", "no_anchor"), rows.select("survey_id", F.inline(found))


def build_route(route_id: str, started_at: str, start_ms: int, app_version: str, ended_at: str | None = None, camera_facing: str = "back", requested_video_quality: str = "1080p") -> dict:
    route = {"schema_version": VERSION, "route_id": route_id, "started_at": started_at, "recording_start_epoch_ms": start_ms, "camera_facing": camera_facing, "requested_video_quality": requested_video_quality, "app_version": app_version}
    return route | ({"ended_at": ended_at} if ended_at else {})


def build_manifest(has_video: bool, has_frames: bool = False) -> dict:
    """Lists what is there and nothing else."""
    return {"schema_version": VERSION, "files": ["route.json", "locations.jsonl", "device.json", *(["video.mp4"] if has_video else []), *(["frames"] if has_frames else [])]}


def file_issues(spark: SparkSession, root: str) -> DataFrame:
    """(survey_id, severity, message): bundles without locations.jsonl, which is an error, files that no bundle should
    have, a warning, and locations with bytes that aren't UTF-8, an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substring_index(F.expr(f"substring(path, locate('{os.path.basename(root.rstrip('/'))}/', path) + {len(os.path.basename(root.rstrip('/'))) + 1})"), "/", 20).alias("p"))
    own = files.select(F.substring_index("p", "/", 1).alias("survey_id"), F.expr("substring(p, locate('/', p) + 1)").alias("name"))
    known = F.col("name").isin(*KNOWN_FILES) | F.col("name").startswith("frames/")
    odd = own.where(~known).select("survey_id", F.lit("warning").alias("severity"), F.concat(F.lit("unknown file "), "name").alias("message"))
    none = own.groupBy("survey_id").agg(F.bool_or(F.col("name") == "locations.jsonl").alias("has")).where("not has").select("survey_id", F.lit("error").alias("severity"), F.lit("locations.jsonl is missing").alias("message"))
    raw = spark.read.text(os.path.join(root, "*", "locations.jsonl")).where(~F.is_valid_utf8("value"))
    bad = raw.select(_survey(F.col("_metadata.file_path")).alias("survey_id")).distinct().select("survey_id", F.lit("error").alias("severity"), F.lit("locations.jsonl isn't UTF-8").alias("message"))
    return odd.unionByName(none).unionByName(bad)


def append_locations(fixes: DataFrame, folder: str) -> None:
    """Adds fixes to a folder of JSON lines; earlier ones stay."""
    encode_locations(fixes).write.mode("append").text(folder)


def write_skeleton(root: str, survey_id: str, started_at: str, start_ms: int, fixes: list[dict]) -> str:
    """A bundle's folder with the given fixes; for fixtures and as the written contract."""
    folder = os.path.join(root, survey_id)
    os.makedirs(folder, exist_ok=True)
    route = {"schema_version": VERSION, "route_id": survey_id, "started_at": started_at, "recording_start_epoch_ms": start_ms}
    for name, doc in (("route.json", route), ("manifest.json", {"schema_version": VERSION, "files": ["route.json", "device.json", "locations.jsonl"]}), ("device.json", {"os": "android"})):
        with open(os.path.join(folder, name), "w") as f:
            json.dump(doc, f)
    with open(os.path.join(folder, "locations.jsonl"), "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in fixes)
    return folder


def encode_locations(fixes: DataFrame) -> DataFrame:
    """One JSON line for each fix; negative readings are left out as absent."""
    keep = [F.round("t").cast("long").alias("t"), "lat", "lon", *[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in ("accuracy_m", "speed_mps", "heading_deg")]]
    return fixes.select(F.to_json(F.struct(*keep)).alias("value"))
