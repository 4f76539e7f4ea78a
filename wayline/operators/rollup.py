"""Coverage and defects by street."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geo
from wayline.operators.roads import MatchingConfig, match_points, with_geometry

MAX_FRAME_GAP_M = 60.0
MIN_LENGTH_FOR_DENSITY_M = 50.0
SEVERITIES = ("unassessed", "low", "medium", "high")


def way_lengths(segments: DataFrame) -> DataFrame:
    """(way_id, length_m, name, highway); the last segment names the way."""
    last = F.max_by(F.struct("name", "highway"), "seg_ord")
    return with_geometry(segments).groupBy("way_id").agg(F.sum("length_m").alias("length_m"), last.alias("m")).select("way_id", "length_m", "m.name", "m.highway")


def driven_pairs(frames: DataFrame) -> DataFrame:
    """(frame_id, lat, lon, heading_deg, metres): each frame with the way to the next of its survey, unless they are
    at one place or too far apart."""
    w = Window.partitionBy("survey_id").orderBy("t_epoch_ms", "video_time_s", "frame_id")
    nxt = frames.where("lat is not null and lon is not null").withColumn("b", F.lead(F.struct("lat", "lon")).over(w)).where("b is not null")
    return nxt.withColumn("metres", geo.haversine_m("lat", "lon", F.col("b.lat"), F.col("b.lon"))).where((F.col("metres") > 0) & (F.col("metres") <= MAX_FRAME_GAP_M)).drop("b")


def coverage_by_way(frames: DataFrame, segments: DataFrame, config: MatchingConfig = MatchingConfig()) -> DataFrame:
    """(way_id, surveyed_m): metres driven, credited to the way that the earlier frame matches; null: none."""
    pairs = driven_pairs(frames)
    at = match_points(pairs.select(F.col("frame_id").alias("point_id"), "lat", "lon", F.coalesce("uncertainty_m", F.lit(10.0)).alias("uncertainty_m"), "heading_deg"), segments, config)
    return pairs.join(at.select(F.col("point_id").alias("frame_id"), "way_id"), "frame_id").groupBy("way_id").agg(F.sum("metres").alias("surveyed_m"))


def ways_of_defects(defects: DataFrame, segments: DataFrame, config: MatchingConfig = MatchingConfig()) -> DataFrame:
    """defects with way_id: of the segment they carry, else of the one they match, without a heading."""
    has = F.col("segment_id").isNotNull()
    fresh = match_points(defects.where(~has).select(F.col("defect_id").alias("point_id"), "lat", "lon", "uncertainty_m", F.lit(None).cast("double").alias("heading_deg")), segments, config)
    found = defects.join(fresh.select(F.col("point_id").alias("defect_id"), F.col("way_id").alias("matched")), "defect_id", "left")
    return found.withColumn("way_id", F.when(has, F.substring_index("segment_id", "#", 1)).otherwise(F.col("matched"))).drop("matched")


def street_report(defects: DataFrame, coverage: DataFrame, segments: DataFrame, include_unsurveyed: bool = False) -> DataFrame:
    """One row for each way with coverage or defects (all ways, if asked): counts by state, class and severity,
    metres, share and density. `defects` have a way_id; those without one are left out."""
    alive = F.col("status") != "rejected"
    n = lambda cond, name: F.count_if(cond).alias(name)
    per_way = defects.where("way_id is not null").groupBy("way_id").agg(
        n(F.col("status") == "verified", "verified"), n(F.col("status") == "rejected", "rejected"), n(~F.col("status").isin("verified", "rejected"), "probable"),
        *[n(alive & (F.col("damage_class") == k), k) for k in ("longitudinal_crack", "transverse_crack", "alligator_crack", "pothole")],
        *[n(alive & (F.col("severity") == k), f"severity_{k}") for k in SEVERITIES if "severity" in defects.columns],
        F.countDistinct("survey_id").alias("n_surveys"), F.collect_set("survey_id").alias("survey_ids"),
    )
    rows = coverage.where("way_id is not null").join(per_way, "way_id", "full_outer")
    meta = way_lengths(segments)
    rows = meta.join(rows, "way_id", "full_outer" if include_unsurveyed else "right")
    zero = [c for c, t in rows.dtypes if t == "bigint" or c in ("surveyed_m", "length_m")]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(dict(rows.dtypes)[c])) for c in zero})
    rows = rows.withColumn("survey_ids", F.coalesce("survey_ids", F.array().cast("array<string>")))
    return rows.withColumns({
        "outstanding": F.col("verified") + F.col("probable"),
        "covered_m": F.when(F.col("length_m") > 0, F.least("surveyed_m", "length_m")).otherwise(F.lit(0.0)),
        "defects_per_100m": F.when(F.col("surveyed_m") >= MIN_LENGTH_FOR_DENSITY_M, F.round((F.col("verified") + F.col("probable")) / F.col("surveyed_m") * 100, 2)),
        "state": F.when(F.col("surveyed_m") <= 0, "not_surveyed").when(F.col("verified") + F.col("probable") == 0, "clean").otherwise("defects"),
    })


def report_json(report: DataFrame) -> DataFrame:
    """(way_id, value): each street of a report as JSON."""
    return report.select("way_id", F.to_json(F.struct(*report.columns)).alias("value"))


def report_text(report: DataFrame, totals: DataFrame, n: int = 10) -> str:
    """The totals and the worst streets as text."""
    t = totals.first()
    head = f"{t.surveyed_m / 1000:.1f} km driven, {t.unmatched_m / 1000:.1f} km off the network; {t.coverage_fraction:.0%} of {t.network_ways} ways covered"
    rows = [f"  {r.name or r.way_id}: {r.outstanding} outstanding, {r.defects_per_100m} per 100 m over {r.surveyed_m:.0f} m" for r in worst(report, n).collect()]
    return "\n".join([head, *rows])


def network_totals(report: DataFrame, coverage: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: ways and metres of the network, metres driven on and off it, share covered."""
    net = way_lengths(segments).agg(F.count("*").alias("network_ways"), F.sum("length_m").alias("network_length_m"))
    on = report.agg(F.sum("covered_m").alias("covered_m"), F.sum("surveyed_m").alias("on_network_m"))
    off = coverage.agg(F.coalesce(F.sum(F.when(F.col("way_id").isNull(), F.col("surveyed_m"))), F.lit(0.0)).alias("unmatched_m"), F.sum("surveyed_m").alias("surveyed_m"))
    return net.join(on).join(off).withColumn("coverage_fraction", F.when(F.col("network_length_m") > 0, F.col("covered_m") / F.col("network_length_m")).otherwise(F.lit(0.0)))


def worst(report: DataFrame, n: int) -> DataFrame:
    return report.where("defects_per_100m is not null").orderBy(F.desc("defects_per_100m"), "way_id").limit(n)


def by_name(report: DataFrame) -> DataFrame:
    """Ways of one name as one street, with the surveys of all of them; unnamed ones are left out."""
    sums = ["verified", "rejected", "probable", "outstanding", "surveyed_m", "covered_m", "length_m", "longitudinal_crack", "transverse_crack", "alligator_crack", "pothole", *[c for c in report.columns if c.startswith("severity_")]]
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("survey_ids")))).alias("survey_ids")
    return report.where("coalesce(name, '') <> ''").groupBy("name").agg(F.count("*").alias("n_ways"), *[F.sum(c).alias(c) for c in sums], ids)


def streets(report: DataFrame, limit: int = 200, keep_unsurveyed: bool = False) -> DataFrame:
    """The densest streets first, then those with most outstanding defects, then by way; a top-k report. A street with
    defects that was never driven is left out unless asked for."""
    rows = report if keep_unsurveyed else report.where("state <> 'not_surveyed'")
    return rows.orderBy(F.desc(F.coalesce("defects_per_100m", F.lit(0.0))), F.desc("outstanding"), "way_id").limit(limit)


def summarize(defects: DataFrame, distance_km: float | None = None) -> DataFrame:
    """(dimension, value, n, mean_uncertainty_m): total and by class, status and (where there is one) severity, in one
    pass of grouping sets; with a distance above 0 also n_per_km."""
    dims = ["damage_class", "status", *(["severity"] if "severity" in defects.columns else [])]
    sets = defects.groupingSets([*[[d] for d in dims], []], *dims).agg(F.count("*").alias("n"), F.avg("uncertainty_m").alias("mean_uncertainty_m"), F.grouping_id(*dims).alias("g"))
    alone = {d: (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - k)) for k, d in enumerate(dims)}
    pick = lambda f: F.coalesce(*[F.when(F.col("g") == g, f(d)) for d, g in alone.items()])
    out = sets.select(F.coalesce(pick(F.lit), F.lit("total")).alias("dimension"), F.coalesce(pick(F.col), F.lit("")).alias("value"), "n", F.round("mean_uncertainty_m", 3).alias("mean_uncertainty_m"))
    return out if not distance_km or distance_km <= 0 else out.withColumn("n_per_km", F.round(F.col("n") / distance_km, 2))


def defects_per_km(defects: DataFrame, distances: DataFrame) -> DataFrame:
    """(survey_id, n_defects, km, per_km) for each survey of `distances` (survey_id, distance_m); null without a distance."""
    n = defects.groupBy("survey_id").agg(F.count("*").alias("n_defects"))
    rows = distances.join(n, "survey_id", "left").select("survey_id", F.coalesce("n_defects", F.lit(0)).alias("n_defects"), (F.col("distance_m") / 1000.0).alias("km"))
    return rows.withColumn("per_km", F.when(F.col("km") > 0, F.col("n_defects") / F.col("km")))
