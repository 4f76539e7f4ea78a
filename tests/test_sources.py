import json

from pyspark.sql import functions as F

from wayline import schema
from wayline.sources import annotations, bundle, export, osm
from wayline.streaming.tracks import latest_state, sessions, track_stream, window_counts

FIX = [{"t": 1000.7, "lat": 40.1, "lon": "44.5", "accuracy_m": 5, "speed_mps": None}, {"t": "2000", "lat": 40.1, "lon": 44.5}, {"t": 3000, "lat": None, "lon": 44.5}, {"t": 4000, "lat": 40.2, "lon": 44.5, "heading_deg": "x"}]


def test_bundle(spark, tmp_path):
    a = bundle.write_skeleton(str(tmp_path), "sv-1", "2026-08-18T10:42:11Z", 1787049731000, FIX)
    with open(f"{a}/locations.jsonl", "a") as f:
        f.write('\n\n[1, 2]\n{"t": 5000, "lat": 1')
    b = bundle.write_skeleton(str(tmp_path), "bad id", "2026-08-18T10:42:11Z", 5, [])
    json.dump({"schema_version": 9, "started_at": "2026-08-18T10:42:11Z"}, open(f"{b}/route.json", "w"))
    open(f"{b}/manifest.json", "w").write("[]")
    fixes, counts = bundle.read_locations(spark, str(tmp_path))
    rows = sorted(fixes.collect(), key=lambda r: r.t)
    assert [(r.t, r.lat, r.lon, r.accuracy_m, r.heading_deg) for r in rows] == [(1000, 40.1, 44.5, 5.0, None), (4000, 40.2, 44.5, None, None)]
    c = counts.first()
    assert (c.n_malformed, c.n_not_objects, c.n_incomplete, c.n_fixes) == (1, 1, 2, 2)
    surveys, issues = bundle.read_surveys(spark, str(tmp_path))
    s = {r.survey_id: r for r in surveys.collect()}
    assert s["sv-1"].recording_start_epoch_ms == 1787049731000 and s["sv-1"].schema_version == 1
    by = {(r.severity, r.message) for r in issues.where(F.col("survey_id").startswith("bad")).collect()}
    assert ("error", "unsafe survey id") in by and ("error", "newer bundle version") in by and ("warning", "no recording anchor; started_at is used") in by


def test_overpass_and_xml(spark, tmp_path):
    pts = [{"lat": 40.0, "lon": 44.0}, {"lat": 40.0, "lon": 44.0}, {"lat": 40.0, "lon": 44.001}, {"lat": None, "lon": 1.0}, {"lat": 40.001, "lon": 44.001}]
    way = lambda i, **tags: {"type": "way", "id": i, "tags": tags, "geometry": pts}
    doc = {"elements": [way(1, highway="residential", name="A", oneway="-1"), way(2, highway="footway"), way(3, highway="primary", junction="roundabout"), {"type": "node", "id": 9}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    rows = osm.read_overpass(spark, str(tmp_path / "o.json")).collect()
    got = {r.segment_id: r for r in rows}
    assert set(got) == {"way/1#0", "way/1#1", "way/3#1", "way/3#2"}
    assert got["way/1#0"].a_lat == 40.001 and got["way/1#0"].oneway and got["way/3#1"].oneway and got["way/3#1"].name is None
    xml = '<osm><way id="7"><nd ref="1"/><nd ref="99"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="service"/><tag k="name" v="B"/></way><way id="8"><nd ref="1"/><nd ref="2"/><tag k="building" v="yes"/></way><node id="1" lat="40.0" lon="44.0"/><node id="2" lat="40.0" lon="44.1"/><node id="3" lat="40.1" lon="44.1"/></osm>'
    (tmp_path / "o.xml").write_text(xml)
    x = sorted((r.segment_id, r.a_lon, r.b_lat, r.oneway) for r in osm.read_osm_xml(spark, str(tmp_path / "o.xml")).collect())
    assert x == [("way/7#0", 44.0, 40.0, False), ("way/7#1", 44.1, 40.1, False)]
    osm.save_network(osm.read_overpass(spark, str(tmp_path / "o.json")), str(tmp_path / "net"), "openstreetmap", "ODbL", "©")
    assert osm.load_network(spark, str(tmp_path / "net")).count() == 4
    assert osm.parse_bbox("1,2,3,4") == (1, 2, 3, 4) and "residential" in osm.overpass_query(1, 2, 3, 4)


def test_annotations(spark, tmp_path):
    obj = lambda c, *b: f"<object><name>{c}</name><bndbox><xmin>{b[0]}</xmin><ymin>{b[1]}</ymin><xmax>{b[2]}</xmax><ymax>{b[3]}</ymax></bndbox></object>"
    head = "<annotation><filename>a.jpg</filename><size><width>100</width><height>80</height><depth>3</depth></size>"
    (tmp_path / "a.xml").write_text(head + obj("D00", "10.7", 5, 400, 60) + obj("D44", 1, 1, 5, 5) + obj("D40", 9, 9, 3, 3) + obj("D10", "x", 1, 2, 3) + obj("D10", 1, 1, "abc", 30) + obj("D20", -5, -5, 5, 5) + "</annotation>")
    (tmp_path / "b.xml").write_text(head.replace("<height>80</height>", "") + obj("D00", 1, 1, 5, 5) + "</annotation>")
    (tmp_path / "c.xml").write_text("no xml")
    got = {r.image_id: r for r in annotations.read_voc(spark, str(tmp_path / "*.xml")).collect()}
    assert (got["a"].width, got["a"].error) == (100, False) and [tuple(b) for b in got["a"].boxes] == [("D00", 10, 5, 100, 60), ("D20", 0, 0, 5, 5)]
    assert [(got[k].error, got[k].boxes) for k in "bc"] == [(True, [])] * 2


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("d1", 40.1234567, 44.7654321, 5.126, 0.55555, ["a", "b"], None)], "defect_id string, lat double, lon double, uncertainty_m double, confidence double, survey_ids array<string>, name string")
    r = export.flat_rows(d).first()
    assert (r.lat, r.uncertainty_m, r.confidence, r.survey_ids, r.name) == (40.123457, 5.13, 0.5556, "a;b", "")
    doc = json.loads(export.feature_collection(d))
    assert doc["features"][0]["geometry"]["coordinates"] == [44.765432, 40.123457] and doc["features"][0]["properties"]["defect_id"] == "d1"
    export.write_csv(d, str(tmp_path / "csv"), ["notice"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1 and (tmp_path / "csv/ATTRIBUTION.txt").exists()
    assert [x.notice for x in export.required_attribution(d.withColumn("road_source", F.lit("OpenStreetMap"))).collect()] == ["© OpenStreetMap contributors, ODbL 1.0"]


def test_validation(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0, 0.5), (91.0, 2.0, -1.0, 1.5), (float("nan"), None, None, None)], "lat double, lon double, uncertainty_m double, confidence double")
    got = [sorted(r.violations) for r in schema.validate(d, "cluster_candidates").collect()]
    assert got == [[], ["confidence_range", "lat_range", "uncertainty_negative"], ["lat_range"]]
    assert schema.unknown_columns(d, "fixes") == ["uncertainty_m", "confidence"]


def run_stream(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    return spark.table(name)


def test_streams_give_what_batches_give(spark, tmp_path):
    fixes = spark.range(100).select(F.lit("s").alias("survey_id"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 5).cast("double").alias("speed_mps"))
    fixes.write.parquet(str(tmp_path / "fixes"))
    live = spark.readStream.schema(fixes.schema).parquet(str(tmp_path / "fixes"))
    got = run_stream(spark, window_counts(live), "windows", "complete")
    assert got.exceptAll(window_counts(spark.read.parquet(str(tmp_path / "fixes")))).count() == 0 and got.count() == 4
    assert run_stream(spark, sessions(live), "sessions", "complete").first().n_fixes == 100
    assert run_stream(spark, latest_state(live, "survey_id", "ts", ["speed_mps"]), "latest", "complete").first().speed_mps == 4.0


def test_tracks_over_micro_batches(spark, tmp_path):
    rows = [("s", f"f{i}", 1000 * i, [(f"d{i}", "pothole", 10.0 + i, 10.0, 110.0 + i, 110.0)] if i != 3 else []) for i in range(8)]
    kind = "survey_id string, frame_id string, t_epoch_ms long, boxes array<struct<detection_id string, damage_class string, x1 double, y1 double, x2 double, y2 double>>"
    for k in range(2):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "frames"))
    got = {r.detection_id: r.track_no for r in run_stream(spark, track_stream(stream), "tracks", "append").collect()}
    assert len(got) == 7 and set(got.values()) == {1}
