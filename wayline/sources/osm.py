"""Road networks from OpenStreetMap extracts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators.roads import DRIVABLE, segments_of_ways
from wayline.schema import SCHEMAS

_ELEMENT = "elements array<struct<type: string, id: long, tags: map<string,string>, geometry: array<struct<lat: double, lon: double>>>>"


def _ways(rows: DataFrame) -> DataFrame:
    t = F.col("tags")
    return rows.select(F.col("id").cast("string").alias("way_id"), t["name"].alias("name"), t["highway"].alias("highway"), t["oneway"].alias("oneway_tag"), t["junction"].alias("junction"), "points")


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Segments of the drivable ways of an Overpass JSON document (out geom)."""
    rows = spark.read.schema(_ELEMENT).option("multiLine", True).json(path).select(F.inline("elements")).where("type = 'way'")
    return segments_of_ways(_ways(rows.withColumnRenamed("geometry", "points")))


def read_osm_xml(spark: SparkSession, path: str) -> DataFrame:
    """Segments of an OSM XML file. Nodes may follow the ways; references to missing nodes are dropped."""
    xml = spark.read.format("xml")
    nodes = xml.option("rowTag", "node").schema("_id long, _lat double, _lon double").load(path).where("_lat is not null and _lon is not null")
    ways = xml.option("rowTag", "way").schema("_id long, nd array<struct<_ref: long>>, tag array<struct<_k: string, _v: string>>").load(path)
    ways = ways.select(F.col("_id").alias("id"), "nd", F.map_from_entries(F.array_distinct(F.transform("tag", lambda x: F.struct(x["_k"], x["_v"])))).alias("tags")).where(F.col("tags")["highway"].isin(*DRIVABLE))
    refs = ways.select("id", F.posexplode("nd").alias("pos", "nd")).select("id", "pos", F.col("nd._ref").alias("_id")).join(nodes, "_id")
    points = refs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).alias("p")))).alias("o")).select("id", F.transform("o", lambda x: x["p"]).alias("points"))
    return segments_of_ways(_ways(ways.drop("nd").join(points, "id")))


def overpass_query(south: float, west: float, north: float, east: float, timeout_s: int = 180) -> str:
    if not (south < north and west < east):
        raise ValueError("the box is degenerate")
    kinds = "|".join(DRIVABLE)
    return f'[out:json][timeout:{timeout_s}];way["highway"~"^({kinds})$"]({south},{west},{north},{east});out tags geom;'


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """'south,west,north,east'."""
    s, w, n, e = (float(x) for x in text.split(","))
    if not (s < n and w < e):
        raise ValueError("the box is degenerate")
    return s, w, n, e


def bbox_around(lat: float, lon: float, radius_m: float) -> tuple[float, float, float, float]:
    """(south, west, north, east) of a box that holds the circle."""
    dlat = math.degrees(radius_m / geo.EARTH_RADIUS_M)
    dlon = min(180.0, dlat / max(math.cos(math.radians(min(89.99, abs(lat) + dlat))), 1e-9))
    return max(-90.0, lat - dlat), lon - dlon, min(90.0, lat + dlat), lon + dlon


def save_network_json(segments: DataFrame, folder: str, compression: str = "gzip") -> None:
    """JSON lines, compressed; for tools that read no Parquet."""
    segments.withColumn("schema_version", F.lit(1)).write.mode("errorifexists").option("compression", compression).json(folder)


def load_network_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, compressed or not, refused if newer than this version."""
    df = spark.read.schema(SCHEMAS["road_segments"] + ", schema_version int").json(path)
    newest = df.agg(F.max("schema_version")).first()[0]
    if newest is not None and newest > 1:
        raise ValueError(f"network version {newest} is newer than 1")
    return df.drop("schema_version")


def save_network(segments: DataFrame, path: str, source: str, license_: str, attribution: str) -> None:
    """Parquet with the provenance in every row's constant columns (dictionary encoded, next to nothing on disk)."""
    segments.withColumns({"source": F.lit(source), "license": F.lit(license_), "attribution": F.lit(attribution), "schema_version": F.lit(1)}).write.mode("errorifexists").parquet(path)


def load_network(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    newest = df.agg(F.max("schema_version")).first()[0]
    if newest is not None and newest > 1:
        raise ValueError(f"network version {newest} is newer than 1")
    return df
