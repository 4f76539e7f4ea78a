"""Splits that keep related records together.

Records are related if they share an entity, directly or over others. Components come from alternating large-star and
small-star steps over edges; the hash of a component's identifier falls into one of the splits' ranges.

For numbered pictures of one country the entities are windows of the numbering: all pictures in a window of `reach` + 1
numbers are within `reach` of each other, so a window is one node, and two windows in a row are one edge if the last
number of the first and the first of the second are close enough. The graph has a node for each window, however many
pictures a country has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.misc import canonical, picture_place, stable_unit  # noqa: F401
from wayline.session import checkpoint, release


def _sum(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _star_large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def _star_small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 64) -> DataFrame:
    """(node, root): every node that an edge names, with the smallest node of its component.

    Edges with a null end don't count; an edge from a node to itself makes the node known; direction and repetition
    don't matter. No edges give no rows. Each round is checkpointed; rows never leave the executors, only a count and
    a checksum do. AQE splits the join's partition of a node with very many edges.
    """
    given = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = checkpoint(given.select(F.col("u").alias("node")).union(given.select("v")).distinct())
    now = checkpoint(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _sum(now)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        large = checkpoint(_star_large(now))
        small = checkpoint(_star_small(large))
        release(now, large)
        now = small
        after = _sum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def picture_groups(images: DataFrame, id_col: str = "image_id", country: str = "country", index: str = "image_index", reach: int = 10) -> DataFrame:
    """(image_id, group_image_id): each distinct id once with the smallest id of its group.

    Two images of one country whose index differs by at most `reach` belong together, also over other images.
    Countries compare without case, blanks, underscores and hyphens at the ends. A missing country or index is read
    from the start of the id (country_index...); an image that tells neither way is its own group, rows without an id
    are left out. An id with several rows joins the groups of all of them. No rows give no rows.
    """
    ids = F.col(id_col).cast("string")
    c, i = picture_place(ids, F.col(country), F.col(index))
    rows = images.where(F.col(id_col).isNotNull()).select(ids.alias("image_id"), c.alias("c"), i.alias("i")).distinct()
    placed = F.col("c").isNotNull() & F.col("i").isNotNull()
    rows = rows.withColumn("k", F.floor(F.col("i") / (reach + 1)).cast("long"))
    # a node is a window (country|k) or an image that has no place
    rows = checkpoint(rows.withColumn("node", F.when(placed, F.concat(F.lit("w|"), "c", F.lit("|"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("i|"), "image_id"))))
    windows = rows.where(placed).groupBy("c", "k", "node").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    nxt = windows.select("c", (F.col("k") - 1).alias("k"), F.col("node").alias("v"), F.col("lo").alias("next_lo"))
    chain = windows.join(nxt, ["c", "k"]).where(F.col("next_lo") - F.col("hi") <= reach).select(F.col("node").alias("u"), "v")
    # an id with several places ties their windows together
    same = rows.groupBy("image_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("image_id", "u")
    same = rows.join(same, "image_id").select("u", F.col("node").alias("v"))
    every = rows.select(F.col("node").alias("u"), F.col("node").alias("v")).distinct()
    roots = star_components(every.union(chain).union(same))
    first = rows.groupBy("node").agg(F.min("image_id").alias("first")).join(roots, "node")
    named = first.groupBy("root").agg(F.min("first").alias("group_image_id"))
    label = first.join(named, "root").select("node", "group_image_id")
    return rows.join(label, "node").groupBy("image_id").agg(F.min("group_image_id").alias("group_image_id"))


SHARES = (("train", 0.70), ("validation", 0.15), ("test", 0.15))


def _bounds(shares) -> list[tuple[float, str]]:
    total, upto, out = float(sum(s for _, s in shares)), 0.0, []
    for name, s in shares:
        upto += s / total
        out.append((upto, name))
    return out


def _range_of(u: Column, shares) -> Column:
    bounds = _bounds(shares)
    out = F.lit(bounds[-1][1])
    for upto, name in reversed(bounds[:-1]):
        out = F.when(u < upto, F.lit(name)).otherwise(out)
    return out


def split_of(group: Column, shares=SHARES, seed: int = 0) -> Column:
    """The split into whose range the hash of a group falls; a null group has none. The shares are reached as far as the
    groups are many and small."""
    return F.when(group.isNotNull(), _range_of(stable_unit(F.lit(str(seed)), group.cast("string")), shares))


#: Ranges of the hash over which sizes are summed, so that no window is over all groups.
RANGES = 4096


def balanced_splits(members: DataFrame, group: str, shares=SHARES, seed: int = 0) -> DataFrame:
    """(group, size, split): groups in the order of their hashes; the ranges end where the sizes of the groups before
    reach the shares, so that the shares of members are met to within the size of a group. A group is in the split in
    whose range its middle lies. Rows with a null group are left out."""
    sizes = checkpoint(members.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count("*").alias("size")).withColumn("u", stable_unit(F.lit(str(seed)), F.col("group").cast("string"))).withColumn("part", F.floor(F.col("u") * RANGES).cast("int")))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("n"))
    every = Window.partitionBy(F.lit(0))  # over at most RANGES rows
    parts = parts.select("part", (F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(every).alias("all"))
    within = Window.partitionBy("part").orderBy("u", "group").rowsBetween(Window.unboundedPreceding, 0)
    at = sizes.join(F.broadcast(parts), "part").withColumn("middle", (F.col("before") + F.sum("size").over(within) - F.col("size") / 2) / F.col("all"))
    return at.select("group", "size", _range_of(F.col("middle"), shares).alias("split"))


def entity_splits(records: DataFrame, id_col: str, entity_cols: list[str], shares=SHARES, seed: int = 0) -> DataFrame:
    """(id, component, split): records that share a value in any of entity_cols, directly or over others, share a
    split. Null values are shared with nobody; an id with several rows has the entities of all of them; rows without
    an id are left out."""
    ids = records.where(F.col(id_col).isNotNull()).select(F.concat(F.lit("r|"), F.col(id_col).cast("string")).alias("u"), *[F.concat(F.lit(f"e|{c}|"), F.col(c).cast("string")).alias(f"e{i}") for i, c in enumerate(entity_cols)])
    edges = ids.select("u", F.col("u").alias("v"))
    for i in range(len(entity_cols)):
        edges = edges.union(ids.select("u", F.col(f"e{i}").alias("v")))
    roots = star_components(edges).where(F.col("node").startswith("r|"))
    return roots.select(F.substring("node", 3, 1 << 30).alias("id"), F.col("root").alias("component"), split_of(F.col("root"), shares, seed).alias("split"))
