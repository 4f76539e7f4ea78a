"""Queries of the problems tagged llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.groups import boruvka_groups, observation_links
from wayline.llm.leaks import leaks
from wayline.llm.mixing import mix
from wayline.llm.nearest import nearest_in_time
from wayline.llm.quality import BULLET, COMMON, OPENS, PROSE, QUOTED, RULES, STOP, natural_prose, quality
from wayline.llm.runs import collapse_runs, damage_class
from wayline.llm.splits import balanced_splits, entity_splits, picture_groups, split_of
from wayline.session import checkpoint, table

TOLERANCE_MS = 1500
RUN_GAP_MS = 15_000


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Images that belong together, each with the smallest of its group."""
    return picture_groups(table(spark, d, "annotations")).where("image_id <> group_image_id").select("group_image_id", "image_id")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each image with its split: ranges of the hash of its group that end where the shares of images are reached. Also
    the split by ranges of the hash alone."""
    groups = checkpoint(picture_groups(table(spark, d, "annotations")))
    split = balanced_splits(groups, "group_image_id").select(F.col("group").alias("group_image_id"), "split")
    return groups.join(split, "group_image_id").select("image_id", "group_image_id", "split", split_of(F.col("group_image_id")).alias("hash_split"))


def p3_split_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the splits reach, by images and by groups, and by ranges of the hash alone."""
    rows = checkpoint(p3_splits(spark, d))
    one = lambda c: rows.groupBy(F.lit(c).alias("bounds"), F.col(c).alias("split")).agg(F.count("*").alias("n_images"), F.countDistinct("group_image_id").alias("n_groups"))
    total = rows.agg(F.count("*").alias("all_images"))
    return one("split").unionByName(one("hash_split")).crossJoin(F.broadcast(total)).select("bounds", "split", "n_images", "n_groups", F.round(F.col("n_images") / F.col("all_images"), 4).alias("share"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Documents about one survey share a split; documents about none stand alone."""
    return entity_splits(table(spark, d, "documents"), "doc_id", ["survey_id"]).select(F.col("id").cast("long").alias("doc_id"), "component", "split")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each frame with the fix of its survey nearest in time, within 1500 ms."""
    fixes = table(spark, d, "location_records").where("lat is not null and lon is not null")
    found = nearest_in_time(table(spark, d, "frames"), fixes, "frame_id", "record_id", "survey_id", "survey_id", "t_epoch_ms", "t", TOLERANCE_MS)
    return found.select(F.col("left_id").alias("frame_id"), F.col("right_id").alias("record_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Observations linked directly or over others, each with the smallest of its group."""
    links = observation_links(table(spark, d, "candidate_matches"), table(spark, d, "cluster_candidates"))
    found = boruvka_groups(links, "a", "b", "distance_m")
    return found.where("id <> group_id").select(F.col("group_id").alias("group_observation_id"), F.col("id").alias("observation_id"))


def _track_runs(spark: SparkSession, d: str) -> DataFrame:
    detections = table(spark, d, "detections").where("track_id is not null").select("detection_id", "frame_id", "survey_id", "track_id", "damage_class")
    frames = table(spark, d, "frames").select("frame_id", "t_epoch_ms")
    return collapse_runs(detections.join(frames, "frame_id"), ["survey_id", "track_id"], "t_epoch_ms", "detection_id", damage_class(F.col("damage_class")), RUN_GAP_MS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two detections or more of one track and class."""
    return _track_runs(spark, d).where("n >= 2").select("survey_id", "track_id", F.col("first_id").alias("first_detection_id"), F.col("last_id").alias("last_detection_id"))


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """All runs with their class, count and duration."""
    return _track_runs(spark, d).select("survey_id", "track_id", F.col("value").alias("damage_class"), F.col("first_id").alias("first_detection_id"), F.col("last_id").alias("last_detection_id"), F.col("n").alias("n_detections"), F.col("duration").alias("duration_ms"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the item."""
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: which document is used in which slot."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0].drop("place")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].withColumn("actual_share", F.round("actual_share", 6))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't natural prose."""
    return natural_prose(table(spark, d, "documents")).where("not natural").select("doc_id").distinct()


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    """All statistics, with the rules that fail."""
    q = quality(table(spark, d, "documents"))
    return q.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in q.dtypes])


QUERIES = {
    "p3_found": p3_found, "p3_splits": p3_splits, "p3_split_shares": p3_split_shares, "p3_entities": p3_entities, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_runs": p6_runs,
    "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_quality": p10_quality,
}

SQL = {
    "p4_found": """
        WITH r AS (SELECT survey_id, t, min(record_id) AS record_id FROM location_records WHERE t IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND survey_id IS NOT NULL GROUP BY 1, 2),
        a AS (SELECT f.frame_id, f.t_epoch_ms AS ft, r.t, r.record_id FROM frames f ASOF JOIN r ON f.survey_id = r.survey_id AND f.t_epoch_ms >= r.t),
        b AS (SELECT f.frame_id, f.t_epoch_ms AS ft, r.t, r.record_id FROM frames f ASOF JOIN r ON f.survey_id = r.survey_id AND f.t_epoch_ms < r.t),
        u AS (SELECT *, abs(ft - t) AS gap FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE abs(ft - t) <= 1500)
        SELECT DISTINCT frame_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY gap, t, record_id) AS rn FROM u) WHERE rn = 1
    """,
}
_IMAGES = """
    WITH p AS (SELECT DISTINCT image_id, trim(regexp_replace(lower(coalesce(nullif(trim(regexp_replace(country, '[\\s_\\-]+', ' ', 'g')), ''), regexp_extract(image_id, '^\\s*(.+?)_(\\d+)', 1))), '[\\s_\\-]+', ' ', 'g')) AS c,
        coalesce(image_index, try_cast(regexp_extract(image_id, '^\\s*(.+?)_(\\d+)', 2) AS BIGINT)) AS i FROM annotations WHERE image_id IS NOT NULL),
    s AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY c ORDER BY i, image_id) <= 10 THEN 0 ELSE 1 END AS n FROM p WHERE c <> '' AND i IS NOT NULL),
    g AS (SELECT *, sum(n) OVER (PARTITION BY c ORDER BY i, image_id ROWS UNBOUNDED PRECEDING) AS grp FROM s),
    m AS (SELECT image_id, min(image_id) OVER (PARTITION BY c, grp) AS group_image_id FROM g)
"""
SQL["p3_found"] = _IMAGES + "SELECT DISTINCT group_image_id, image_id FROM m WHERE image_id <> group_image_id"
_RUNS = """
    WITH d AS (SELECT d.survey_id, d.track_id, d.detection_id, f.t_epoch_ms AS t, min(CASE regexp_replace(trim(regexp_replace(lower(d.damage_class), '[\\s_\\-]+', ' ', 'g')), ' ', '_', 'g')
            WHEN 'd00' THEN 'longitudinal_crack' WHEN 'd10' THEN 'transverse_crack' WHEN 'd20' THEN 'alligator_crack' WHEN 'd40' THEN 'pothole'
            ELSE regexp_replace(trim(regexp_replace(lower(d.damage_class), '[\\s_\\-]+', ' ', 'g')), ' ', '_', 'g') END) AS c
        FROM detections d JOIN frames f ON d.frame_id = f.frame_id WHERE d.track_id IS NOT NULL AND d.survey_id IS NOT NULL GROUP BY 1, 2, 3, 4),
    s AS (SELECT *, CASE WHEN c IS NOT DISTINCT FROM lag(c) OVER w AND t - lag(t) OVER w <= 15000 THEN 0 ELSE 1 END AS n FROM d WINDOW w AS (PARTITION BY survey_id, track_id ORDER BY t, detection_id)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY survey_id, track_id ORDER BY t, detection_id ROWS UNBOUNDED PRECEDING) AS grp FROM s),
    r AS (SELECT survey_id, track_id, grp, any_value(c) AS damage_class, arg_min(detection_id, (t, detection_id)) AS first_detection_id, arg_max(detection_id, (t, detection_id)) AS last_detection_id, count(*) AS n_detections, max(t) - min(t) AS duration_ms FROM g GROUP BY 1, 2, 3)
"""
SQL["p6_found"] = _RUNS + "SELECT survey_id, track_id, first_detection_id, last_detection_id FROM r WHERE n_detections >= 2"
SQL["p6_runs"] = _RUNS + "SELECT survey_id, track_id, damage_class, first_detection_id, last_detection_id, n_detections, duration_ms FROM r"
SQL["p5_found"] = """
    WITH RECURSIVE k AS (SELECT lower(trim(observation_id)) AS k, min(observation_id) AS id FROM cluster_candidates GROUP BY 1),
    e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM candidate_matches m JOIN k x ON lower(trim(m.observation_id_a)) = x.k JOIN k y ON lower(trim(m.observation_id_b)) = y.k
        WHERE m.distance_m <= m.merge_radius_m AND NOT isnan(m.distance_m) AND NOT isnan(m.merge_radius_m) AND x.id <> y.id),
    l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(id, o) AS (SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.o = l.a)
    SELECT min(o) AS group_observation_id, id AS observation_id FROM r GROUP BY id HAVING min(o) <> id
"""
_UNIT = "(CAST('0x' || substr(md5(concat_ws('|', '0', {0})), 1, 8) AS BIGINT) / 4294967296e0)"
_RANGE = "CASE WHEN {0} < 0.7e0 THEN 'train' WHEN {0} < 0.7e0 + 0.15e0 THEN 'validation' ELSE 'test' END"
_SPLITS = f"""{_IMAGES},
    e AS (SELECT image_id, coalesce(m.group_image_id, image_id) AS group_image_id FROM (SELECT DISTINCT image_id FROM annotations WHERE image_id IS NOT NULL) LEFT JOIN m USING (image_id)),
    z AS (SELECT group_image_id, count(*) AS n, {_UNIT.format('group_image_id')} AS u FROM e GROUP BY 1),
    y AS (SELECT *, (sum(n) OVER (ORDER BY u, group_image_id ROWS UNBOUNDED PRECEDING) - n / 2) / CAST(sum(n) OVER () AS DOUBLE) AS middle FROM z),
    x AS (SELECT image_id, group_image_id, {_RANGE.format('middle')} AS split, {_RANGE.format('u')} AS hash_split FROM e JOIN y USING (group_image_id))"""
SQL["p3_splits"] = _SPLITS + "SELECT image_id, group_image_id, split, hash_split FROM x"
SQL["p3_split_shares"] = _SPLITS + ", w AS (SELECT 'split' AS bounds, split, group_image_id FROM x UNION ALL SELECT 'hash_split', hash_split, group_image_id FROM x) SELECT bounds, split, count(*) AS n_images, count(DISTINCT group_image_id) AS n_groups, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM x), 4) AS share FROM w GROUP BY 1, 2"
SQL["p3_entities"] = f"WITH c AS (SELECT doc_id, coalesce('e|survey_id|' || survey_id, 'r|' || doc_id) AS component FROM documents) SELECT doc_id, component, {_RANGE.format(_UNIT.format('component'))} AS split FROM c"

_COMMON = ", ".join(f"'{w}'" for ws in COMMON.values() for w in ws)
_STOP = ", ".join(f"'{w}'" for ws in STOP.values() for w in ws)
_TRIM = "' ' || chr(9) || chr(160) || chr(8195) || chr(12288)"
_LINES = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents WHERE doc_id IS NOT NULL),
    l0 AS (SELECT doc_id, unnest(string_split(replace(x, chr(13), chr(10)), chr(10))) AS s, generate_subscripts(string_split(replace(x, chr(13), chr(10)), chr(10)), 1) AS i FROM d),
    l1 AS (SELECT *, CASE WHEN ltrim(s, ' ')[1] IN ('|', '>') THEN regexp_replace(s, '{QUOTED}', '', 'g') ELSE s END AS bare, rtrim(s, {_TRIM}) AS e FROM l0 WHERE trim(s, ' ') <> ''),
    l2 AS (SELECT *, regexp_extract_all(lower(bare), '[\\p{{L}}\\p{{N}}]+') AS w, regexp_matches(right(e, 16), '[.!?…][''"”’»)\\]]*$') AS fin FROM l1),
    l3 AS (SELECT *, list_filter(w, lambda v: v IN ({_COMMON})) AS c, len(list_filter(w, lambda v: regexp_matches(v, '\\p{{L}}'))) AS alpha,
        contains(bare, chr(9)) OR length(bare) - length(replace(replace(bare, '|', ''), '›', '')) >= 2 OR regexp_matches(bare, '{OPENS}')
        OR length(bare) - length(replace(bare, ';', '')) - (length(bare) - length(replace(bare, '; ', ''))) // 2 >= 3
        OR length(bare) - length(replace(bare, ',', '')) - (length(bare) - length(replace(bare, ', ', ''))) // 2 - CASE WHEN ends_with(bare, ',') THEN 1 ELSE 0 END >= 3
        OR len(regexp_extract_all(bare, '[^ \\t] {{3,}}')) - CASE WHEN regexp_matches(bare, '[^ \\t] {{3,}}$') THEN 1 ELSE 0 END >= 2 AS built FROM l2),
    l4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, NOT built AND alpha >= 3 AND len(c) * 8 >= greatest(8, alpha) AS runs FROM l3),
    l5 AS (SELECT *, runs OR (NOT built AND fin AND coalesce(lag(runs) OVER (PARTITION BY doc_id ORDER BY k), FALSE)) AS running FROM l4),
    a AS (SELECT doc_id, count(*) AS n_lines, sum(length(s)) AS n, sum(len(w)) AS words, sum(length(array_to_string(w, ''))) AS letters, sum(alpha) AS alpha, sum(len(c)) AS common, sum(len(list_filter(c, lambda v: v IN ({_STOP})))) AS stop,
        sum(CASE WHEN running THEN length(s) ELSE 0 END) AS run_chars, count(*) FILTER (fin) AS punct, count(*) FILTER (regexp_matches(s, '{BULLET}')) AS bullet, count(*) FILTER (ends_with(e, '…') OR ends_with(e, '...')) AS dots, count(*) FILTER (length(s) < 30) AS short FROM l5 GROUP BY 1),
    b AS (SELECT doc_id, sum(length(s)) AS single FROM (SELECT DISTINCT doc_id, s FROM l1) GROUP BY 1),
    q AS (SELECT d.doc_id, x, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0) AS n, coalesce(words, 0) AS words, coalesce(letters, 0) AS letters, coalesce(alpha, 0) AS alpha, coalesce(common, 0) AS common, coalesce(stop, 0) AS stop, coalesce(run_chars, 0) AS run_chars, coalesce(punct, 0) AS punct, coalesce(bullet, 0) AS bullet,
        coalesce(dots, 0) AS dots, coalesce(short, 0) AS short, coalesce(single, 0) AS single, length(translate(x, {_TRIM} || chr(13) || chr(10) || chr(12) || chr(11), '')) AS solid FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id)"""
_OF = lambda part, whole: f"CASE WHEN {whole} > 0 THEN ({part}) / CAST({whole} AS DOUBLE) ELSE 0 END"
_STATISTICS = {
    "n_chars": "CAST(length(x) AS BIGINT)", "n_words": "CAST(words AS BIGINT)", "mean_word_length": _OF("letters", "words"), "symbol_ratio": _OF("solid - letters", "solid"), "hash_word_ratio": _OF("length(x) - length(replace(x, '#', ''))", "words"),
    "ellipsis_word_ratio": _OF("(length(x) - length(replace(x, '...', ''))) / 3 + length(x) - length(replace(x, '…', ''))", "words"), "alpha_word_share": _OF("alpha", "words"), "n_lines": "CAST(n_lines AS BIGINT)", "punct_line_share": _OF("punct", "n_lines"),
    "bullet_line_share": _OF("bullet", "n_lines"), "ellipsis_line_share": _OF("dots", "n_lines"), "short_line_share": _OF("short", "n_lines"), "repeated_line_share": _OF("n - single", "n"), "common_word_share": _OF("common", "words"), "n_stop_words": "CAST(stop AS BIGINT)",
    "n_sentences": "CAST(len(regexp_extract_all(x, '\\p{L}\\p{L}[.!?…]+[''\"”’»)\\]]*(?:\\s|$)|\\d[.!?]+[''\"”’»)\\]]*(?:\\s+\\p{L}|\\s*$)')) AS BIGINT)", "has_curly_bracket": "contains(x, '{')", "running_share": _OF("run_chars", "n"),
}
_WHY = lambda rules, name: f"concat_ws(',', {', '.join(f'CASE WHEN {rule} THEN {chr(39)}{k}{chr(39)} END' for k, rule in rules.items())}) AS {name}"
SQL["p10_quality"] = _LINES + f", s AS (SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in _STATISTICS.items())} FROM q), f AS (SELECT *, {_WHY(RULES, 'reasons')}, {_WHY(PROSE, 'prose_reasons')} FROM s) " + (
    f"SELECT doc_id, {', '.join(f'round({k}, 4) AS {k}' if e.startswith('CASE') else k for k, e in _STATISTICS.items())}, reasons, prose_reasons, prose_reasons = '' AS natural FROM f"
)
SQL["p10_found"] = _LINES + f", s AS (SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in _STATISTICS.items())} FROM q) SELECT DISTINCT doc_id FROM s WHERE {' OR '.join(f'({r})' for r in PROSE.values())}"
