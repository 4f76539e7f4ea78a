"""Human review of defects: a log of actions, folded to the state it leads to, and the lists that reviewers work with.

Reviews are append-only. What they lead to is an aggregate of the log: each attribute has the value of the last action
that sets it, so a defect with any number of reviews is combined before the shuffle. What each action found before it is
carried over buckets of time, so that no defect's log is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.misc import is_synthetic_model
from wayline.schema import ENUMS

ACTIONS = ("approve", "reject", "change_class", "change_severity", "adjust_location", "add_note")
MANUAL_UNCERTAINTY_M = 2.0
ATTRIBUTES = ("status", "damage_class", "severity", "severity_source", "lat", "lon", "location_method", "uncertainty_m")


def review_problem() -> Column:
    """Why a review can't be applied, null if it can: an unknown action, or a value that its action needs and lacks."""
    place = F.coalesce(F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0), F.lit(False))
    return (
        F.when(F.col("review_id").isNull() | F.col("defect_id").isNull() | F.col("reviewed_at").isNull(), "incomplete")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown_action")
        .when((F.col("action") == "change_class") & ~F.coalesce(F.col("damage_class").isin(*ENUMS["damage_class"]), F.lit(False)), "damage_class_required")
        .when((F.col("action") == "change_severity") & ~F.coalesce(F.col("severity").isin(*ENUMS["severity"]), F.lit(False)), "severity_required")
        .when((F.col("action") == "adjust_location") & ~place, "location_required")
    )


def _sets() -> dict[str, Column]:
    """What an action sets: approving, correcting the class or the place verify a defect, rejecting rejects it, a
    severity is the reviewer's own; a note sets nothing."""
    is_ = lambda *a: F.col("action").isin(*a)
    move = is_("adjust_location")
    return {
        "status": F.when(is_("approve", "change_class", "adjust_location"), "verified").when(is_("reject"), "rejected"),
        "damage_class": F.when(is_("change_class"), F.col("damage_class")),
        "severity": F.when(is_("change_severity"), F.col("severity")),
        "severity_source": F.when(is_("change_severity"), F.when(F.col("severity") == "unassessed", "other").otherwise("human")),
        "lat": F.when(move, F.col("lat")), "lon": F.when(move, F.col("lon")),
        "location_method": F.when(move, "manual_correction"), "uncertainty_m": F.when(move, MANUAL_UNCERTAINTY_M),
    }


def split_reviews(defects: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews that can be applied, the others with `problem`): also of unknown defects, and all but the first (by time,
    then by all columns) of one review_id. The latter are found by an aggregate, whatever their number."""
    known = defects.select("defect_id", F.lit(True).alias("_known"))
    rows = reviews.withColumn("problem", review_problem()).join(known, "defect_id", "left")
    rows = rows.withColumn("problem", F.coalesce("problem", F.when(F.col("_known").isNull(), "unknown_defect"))).drop("_known")
    cols = [c for c in reviews.columns if c != "review_id"]
    sound = rows.where("problem is null").groupBy("review_id").agg(F.min(F.struct("reviewed_at", *[c for c in cols if c != "reviewed_at"])).alias("r"), F.count("*").alias("n"))
    good = sound.select("review_id", *[f"r.{c}" for c in cols]).select(*reviews.columns)
    again = sound.where("n > 1").select("review_id", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select("review_id", F.lit("duplicate_id").alias("problem"))
    return good, rows.where("problem is not null").select("review_id", "problem").unionByName(again)


def apply_reviews(defects: DataFrame, reviews: DataFrame) -> DataFrame:
    """defects after their reviews (those of split_reviews), in the order of (reviewed_at, review_id), with n_reviews,
    updated_at and class_corrected."""
    order = F.struct("reviewed_at", "review_id")
    sets = _sets()
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), order))
    folded = reviews.groupBy("defect_id").agg(
        *[last(c).alias(f"_{k}") for k, c in sets.items()], F.count("*").alias("n_reviews"), F.max("reviewed_at").alias("updated_at"), F.bool_or(F.col("action") == "change_class").alias("class_corrected")
    )
    out = defects.join(folded, "defect_id", "left")
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in sets else F.col(c) for c in defects.columns]
    return out.select(*kept, F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"), "updated_at", F.coalesce("class_corrected", F.lit(False)).alias("class_corrected"))


def review_log(defects: DataFrame, reviews: DataFrame, bucket: str = "month") -> DataFrame:
    """(review_id, defect_id, action, reviewer, reviewed_at, note, previous, new): each review with the attributes it set
    and what they were before, as structs whose fields are null where an action doesn't set them."""
    order = ["reviewed_at", "review_id"]
    sets = _sets()
    rows = reviews.select("review_id", "defect_id", "action", "reviewer", "reviewed_at", "note", *[c.alias(f"_{k}") for k, c in sets.items()]).withColumn("_bucket", F.date_trunc(bucket, "reviewed_at"))
    # within a bucket by a window, over buckets by a small table of what each one ends with
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))
    ends = rows.groupBy("defect_id", "_bucket").agg(*[last(f"_{k}").alias(f"_{k}") for k in sets])
    up = Window.partitionBy("defect_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("defect_id", "_bucket", *[F.last(f"_{k}", ignorenulls=True).over(up).alias(f"_carry_{k}") for k in sets])
    w = Window.partitionBy("defect_id", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.select("*", *[F.last(f"_{k}", ignorenulls=True).over(w).alias(f"_before_{k}") for k in sets]).join(carry, ["defect_id", "_bucket"])
    base = defects.select("defect_id", *[F.col(k).alias(f"_base_{k}") if k in defects.columns else F.lit(None).cast("string").alias(f"_base_{k}") for k in sets])
    out = before.join(base, "defect_id")
    was = F.struct(*[F.when(F.col(f"_{k}").isNotNull(), F.coalesce(f"_before_{k}", f"_carry_{k}", f"_base_{k}")).alias(k) for k in sets])
    return out.select("review_id", "defect_id", "action", "reviewer", "reviewed_at", "note", was.alias("previous"), F.struct(*[F.col(f"_{k}").alias(k) for k in sets]).alias("new"))


# --- lists


def list_defects(defects: DataFrame, damage_class: str | None = None, status: str | None = None, min_confidence: float | None = None, survey_id: str | None = None, severity: str | None = None, limit: int | None = None, severity_after_limit: bool = False) -> DataFrame:
    """Defects in the order of (first_seen, defect_id). Filters come before the limit; severity_after_limit filters the
    page that the others give, so that it may be short. A min_confidence of 0 filters nothing."""
    rows = defects
    if damage_class is not None:
        rows = rows.where(F.col("damage_class") == damage_class)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if min_confidence:
        rows = rows.where(F.col("confidence") >= min_confidence)
    if survey_id is not None:
        rows = rows.where(F.array_contains("survey_ids", survey_id) if "survey_ids" in rows.columns else F.col("survey_id") == survey_id)
    of_severity = lambda df: df if severity is None else df.where(F.col("severity") == severity)
    rows = rows if severity_after_limit else of_severity(rows)
    rows = rows.orderBy("first_seen", "defect_id")
    rows = rows if limit is None else rows.limit(limit)
    return of_severity(rows) if severity_after_limit else rows


def get_defect(defects: DataFrame, defect_id: str) -> DataFrame:
    return defects.where(F.col("defect_id") == defect_id)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of the tables that may be counted."""
    allowed = {"surveys", "frames", "detections", "tracks", "defects", "defect_observations", "reviews", "model_versions", "processing_runs"}
    if odd := set(tables) - allowed:
        raise ValueError(f"no such table: {', '.join(sorted(odd))}")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_detections(observations: DataFrame, defects: DataFrame, most: int = 20) -> DataFrame:
    """(defect_id, detection_ids): the first `most` of each of `defects`, in the order of its observations and of their
    lists. Ranks are limited before the shuffle."""
    each = observations.join(defects.select("defect_id"), "defect_id", "left_semi").select("defect_id", "observed_at", "observation_id", F.posexplode("detection_ids").alias("at", "detection_id"))
    order = ["observed_at", "observation_id", "at"]
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("defect_id").orderBy(*order))).where(F.col("rank") <= most)
    return top.groupBy("defect_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "detection_id"))), lambda x: x["detection_id"]).alias("detection_ids"))


def queue(defects: DataFrame, observations: DataFrame, status: str = "probable", limit: int = 200) -> DataFrame:
    """The defects to be reviewed, oldest first, with their first detections and the names of their images; a page."""
    page = list_defects(defects, status=status, limit=limit)
    out = page.join(first_detections(observations, page), "defect_id", "left")
    picture = lambda kind: F.concat("defect_id", F.lit(f"_{kind}.jpg")).alias(f"{kind}_image")
    return out.select(
        "defect_id", "damage_class", F.round("confidence", 4).alias("confidence"), "severity", "severity_source", "status", "lat", "lon", "location_method", F.round("uncertainty_m", 2).alias("uncertainty_m"),
        "observation_count", "first_seen", "model_id", "processing_run_id", "representative_frame_id", picture("context"), picture("crop"), F.coalesce("detection_ids", F.array().cast("array<string>")).alias("detection_ids"),
    ).orderBy("first_seen", "defect_id")


def details(defects: DataFrame, observations: DataFrame, reviews: DataFrame, defect_id: str | None = None) -> DataFrame:
    """Defects (or one) with their observations and reviews as ordered lists."""
    rows = defects if defect_id is None else get_defect(defects, defect_id)

    def listed(df: DataFrame, order: list[str], name: str) -> DataFrame:
        df = df.join(rows.select("defect_id"), "defect_id", "left_semi")
        rest = [c for c in df.columns if c not in ("defect_id", *order)]
        return df.groupBy("defect_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))

    out = rows.join(listed(observations, ["observed_at", "observation_id"], "observations"), "defect_id", "left")
    return out.join(listed(reviews, ["reviewed_at", "review_id"], "reviews"), "defect_id", "left")


def provenance(defects: DataFrame) -> DataFrame:
    """One row: the models behind the defects, whether any is made up, and codes of warnings: synthetic_detector,
    none_verified."""
    made_up = is_synthetic_model(F.col("model_id"))
    one = defects.agg(F.array_sort(F.collect_set("model_id")).alias("models"), F.coalesce(F.bool_or(made_up), F.lit(False)).alias("synthetic"), F.coalesce(F.bool_or(F.col("status") == "verified"), F.lit(False)).alias("_verified"), F.count("*").alias("_n"))
    codes = F.array_compact(F.array(F.when(F.col("synthetic"), "synthetic_detector"), F.when((F.col("_n") > 0) & ~F.col("_verified"), "none_verified")))
    return one.select("models", "synthetic", codes.alias("warnings"))


def map_view(defects: DataFrame, limit: int = 5000, **filters) -> dict[str, DataFrame]:
    """What a map shows: `shown` defects, `page` (one row: how many, whether the limit cut them off), `totals` of all
    defects by class, status and severity, whatever the filters, `surveys` and `provenance`."""
    from wayline.operators.rollup import summarize

    shown = list_defects(defects, limit=limit, **filters)
    page = shown.agg(F.count("*").alias("n_shown")).withColumn("truncated", F.col("n_shown") >= limit)
    ids = F.explode("survey_ids") if "survey_ids" in defects.columns else F.col("survey_id")
    return {"shown": shown, "page": page, "totals": summarize(defects), "surveys": defects.select(ids.alias("survey_id")).distinct(), "provenance": provenance(defects)}


def stats(defects: DataFrame, reviews: DataFrame, surveys: DataFrame) -> DataFrame:
    """(dimension, value, n, mean_uncertainty_m): the summary of defects, and how many reviews and surveys there are."""
    from wayline.operators.rollup import summarize

    more = counts({"reviews": reviews, "surveys": surveys}).select(F.lit("table").alias("dimension"), F.col("name").alias("value"), "n", F.lit(None).cast("double").alias("mean_uncertainty_m"))
    return summarize(defects).unionByName(more)
