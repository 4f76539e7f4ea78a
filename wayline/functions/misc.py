"""Time, text, hash and id functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDD_CODES = {"D00": "longitudinal_crack", "D10": "transverse_crack", "D20": "alligator_crack", "D40": "pothole"}
#: Classes of the COCO set that stand for people and vehicles; fixed values.
COCO_REGIONS = {"person": "person", "bicycle": "vehicle", "car": "vehicle", "motorcycle": "vehicle", "bus": "vehicle", "train": "vehicle", "truck": "vehicle"}


def video_time_to_epoch_ms(start_ms: Column, seconds: Column) -> Column:
    """Null for negative seconds."""
    return F.when(seconds >= 0, F.bround(start_ms + seconds * 1000.0, 0).cast("long"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def way_of_segment(segment_id: Column) -> Column:
    return F.substring_index(segment_id, "#", 1)


def padded_id(prefix: str, n: Column, width: int = 5) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)


def canonical(name: Column) -> Column:
    """Lower case, blanks of any kind collapsed and trimmed; null if nothing is left."""
    s = F.trim(F.regexp_replace(F.lower(name.cast("string")), r"[\s_\-]+", " "))
    return F.when(s != "", s)


def picture_place(image_id: Column, country: Column, index: Column) -> tuple[Column, Column]:
    """The canonical country and the index of a picture; what is missing is read from the start of the id
    (country_index...), and null if that doesn't tell it either."""
    parsed = r"^\s*(.+?)_(\d+)"
    told = F.regexp_extract(image_id, parsed, 2)
    return F.coalesce(canonical(country), canonical(F.regexp_extract(image_id, parsed, 1))), F.coalesce(index.cast("long"), F.when(told != "", told.try_cast("long")))


def country_name(canon: Column) -> Column:
    """A canonical country as it is shown: 'Norvia', and 'unknown' for null."""
    return F.coalesce(F.concat(F.upper(F.substring(canon, 1, 1)), F.substring(canon, 2, 1 << 30)), F.lit("unknown"))


def safe_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]+$")


def rdd_class(code: Column) -> Column:
    """The class of an RDD code, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in RDD_CODES.items() for x in kv]), code)


def damage_class(label: Column) -> Column:
    """The class behind a label in any spelling, or its RDD code."""
    s = F.regexp_replace(F.trim(F.regexp_replace(F.lower(label.cast("string")), r"[\s_\-]+", " ")), " ", "_")
    return F.coalesce(rdd_class(F.upper(s)), s)


def stable_unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / float(1 << 32)


def content_hash(rows: Column) -> Column:
    """Aggregate: a hash of a set of row texts, whatever their order: of the sums of parts of the rows' own hashes, so
    that no list of rows is ever held."""
    h = F.md5(rows)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(13)), 256)


def is_synthetic_model(model_id: Column) -> Column:
    return F.coalesce(model_id.rlike("^(fake|scripted|null)-"), F.lit(False))


def file_kind(path: Column) -> Column:
    """What retention calls a file, by suffix and folder: raw_video, frames, or null for what has no rule of age."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    parent = F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1)
    return F.when(suffix.isin("mp4", "mov", "mkv", "avi", "m4v"), "raw_video").when(suffix.isin("jpg", "jpeg", "png") & (parent == "frames"), "frames")


def mosaic_block(width: Column, height: Column, across: int = 4, least: int = 8) -> Column:
    return F.greatest(F.lit(least), F.ceil(F.least(width, height) / across).cast("int"))


def describe_accuracy(metres: Column) -> Column:
    return F.when(metres.isNull() | F.isnan(metres) | (metres < 0), "unusable").when(metres <= 10, "good").when(metres <= 25, "fair").otherwise("poor")


def format_elapsed(seconds: Column) -> Column:
    """Minutes and seconds; minutes go on beyond 60."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


#: A pessimistic estimate of how much a minute of video takes, and the shortest recording worth starting; fixed values.
VIDEO_BYTES_PER_MINUTE, MIN_SURVEY_MINUTES = 120 * 1024 * 1024, 10


def describe_storage(free_bytes: Column) -> Column:
    """struct(minutes, ok): how long may be recorded, and whether that is long enough."""
    minutes = F.floor(free_bytes / VIDEO_BYTES_PER_MINUTE).cast("long")
    return F.struct(minutes.alias("minutes"), (minutes >= MIN_SURVEY_MINUTES).alias("ok"))


def survey_id_of(now: Column, suffix: Column) -> Column:
    """survey_<UTC time>_<suffix>, safe as a file name; null if the suffix isn't."""
    made = F.concat(F.lit("survey_"), F.date_format(now, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'"), F.lit("_"), suffix)
    return F.when(safe_name(made), made)


def present(reading: Column) -> Column:
    """A negative reading means absent, 0 stays."""
    return F.when(reading >= 0, reading)
