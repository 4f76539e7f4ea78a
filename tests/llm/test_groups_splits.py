import random

import pytest
from pyspark.sql import functions as F

from wayline.llm.groups import boruvka_groups, observation_links
from wayline.llm.splits import balanced_splits, canonical, entity_splits, picture_groups, split_of, star_components


def components(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    out = {}
    for x in list(up):
        out.setdefault(root(x), set()).add(x)
    return {x: min(c) for c in out.values() for x in c}


def graph(kind):
    rng = random.Random(7)
    if kind == "random":
        return [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)]
    if kind == "path":
        order = [f"n{i:03d}" for i in range(60)]
        rng.shuffle(order)
        return list(zip(order, order[1:]))
    return [("hub", f"leaf{i}") for i in range(80)] + [("hub", "hub")]


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_both_ways_find_the_components(spark, kind):
    pairs = graph(kind)
    want = components(pairs)
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(pairs[0][1], pairs[0][0], None), (None, "x", 1.0)], "a string, b string, w double")
    assert {r.id: r.group_id for r in boruvka_groups(df, "a", "b", "w").collect()} == want
    assert {r.node: r.root for r in star_components(df, "a", "b").collect()} == want


def test_nothing(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert boruvka_groups(none, "a", "b").count() == 0 and star_components(none, "a", "b").count() == 0
    images = spark.createDataFrame([], "image_id string, country string, image_index long")
    assert picture_groups(images).count() == 0


def test_links_are_cleaned(spark):
    m = spark.createDataFrame(
        [(" OBS-1", "obs-2 ", 3.0, 12.0), ("obs-2", "obs-1", 30.0, 12.0), ("obs-2", "obs-3", None, 12.0), ("obs-3", None, 1.0, 12.0), ("obs-3", "gone", 1.0, 12.0), ("obs-3", "obs-3", 0.0, 5.0), ("obs-4", "obs-5", float("nan"), 5.0), ("obs-4", "obs-5", 5.0, 5.0)],
        "observation_id_a string, observation_id_b string, distance_m double, merge_radius_m double",
    )
    o = spark.createDataFrame([(f"obs-{i}",) for i in range(1, 6)], "observation_id string")
    assert sorted((r.a, r.b) for r in observation_links(m, o).collect()) == [("obs-1", "obs-2"), ("obs-3", "obs-3"), ("obs-4", "obs-5")]


def test_pictures(spark):
    rows = [
        ("Norvia_00000001", "Norvia", 1), ("Norvia_00000011", " NORVIA\t", 11), ("norvia_21", None, None), ("Norvia_00000032", "Norvia", 32), ("Norvia_00000021_flip", "Norvia", None),
        ("Quorra_00000011", "Quorra", 11), ("what", None, None), ("what", None, None), ("Norvia_00000001", "Norvia", 1), (None, "Norvia", 2), ("Norvia_00000043", "Norvia", 43), ("x", "Norvia", 33),
    ]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "image_id string, country string, image_index long, k int, node string")
    got = {r.image_id: r.group_image_id for r in picture_groups(df).collect()}
    first = "Norvia_00000001"
    assert got == {first: first, "Norvia_00000011": first, "norvia_21": first, "Norvia_00000021_flip": first, "Norvia_00000032": "Norvia_00000032", "x": "Norvia_00000032", "Norvia_00000043": "Norvia_00000032", "Quorra_00000011": "Quorra_00000011", "what": "what"}


def test_pictures_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"C{rng.randrange(3)}_{i}_{k}", f"C{i % 3}", i) for k, i in enumerate(rng.sample(range(3000), 250))]
    got = {r.image_id: r.group_image_id for r in picture_groups(spark.createDataFrame(rows, "image_id string, country string, image_index long")).collect()}
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and abs(a[2] - b[2]) <= 10]
    assert got == components(pairs)


def test_splits(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("g")).select("g", split_of(F.col("g")).alias("s"))
    n = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert abs(n["train"] / 20_000 - 0.7) < 0.02 and abs(n["validation"] / 20_000 - 0.15) < 0.02 and set(n) == {"train", "validation", "test"}
    r = spark.createDataFrame([("a", "x", None), ("b", "x", "q"), ("c", "y", "q"), ("d", None, None), ("e", None, None), (None, "x", "q"), ("a", "x", None)], "id string, author string, site string")
    out = entity_splits(r, "id", ["author", "site"]).collect()
    c = {x.id: x.component for x in out}
    assert len(out) == 5 and c["a"] == c["b"] == c["c"] and len({c["a"], c["d"], c["e"]}) == 3
    assert spark.range(1).select(canonical(F.lit(" \tA__b-\n")).alias("x"), canonical(F.lit("  ")).alias("y")).first() == ("a b", None)


def test_balanced_splits_reach_the_shares_and_keep_groups(spark):
    rng = random.Random(9)
    sizes = [1 + int(rng.expovariate(0.1)) for _ in range(300)] + [700]
    df = spark.createDataFrame([(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)] + [(None,)], "g string")
    rows = balanced_splits(df, "g").collect()
    assert {r.group: r.size for r in rows} == {f"g{i}": n for i, n in enumerate(sizes)}
    got = {s: sum(r.size for r in rows if r.split == s) / sum(sizes) for s in ("train", "validation", "test")}
    assert abs(got["train"] - 0.7) < 0.12 and abs(got["validation"] - 0.15) < 0.12 and abs(got["test"] - 0.15) < 0.12
    small = balanced_splits(df.where("g <> 'g300'"), "g").groupBy("split").agg(F.sum("size").alias("n")).collect()
    assert all(abs(r.n / sum(sizes[:-1]) - {"train": 0.7}.get(r.split, 0.15)) < 0.02 for r in small)
    assert {tuple(r) for r in balanced_splits(df.repartition(3).union(df.limit(0)), "g").collect()} == {tuple(r) for r in rows}
    assert balanced_splits(df.limit(0), "g").count() == 0
