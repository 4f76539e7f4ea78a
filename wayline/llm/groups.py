"""Consolidating pairwise matches into groups.

Deterministic Boruvka: every component chooses its smallest outgoing edge by (weight, ends), a total order, so the
only cycles among the choices are two components that chose the same edge; the smaller of them becomes a root. Pointer
doubling collapses the trees, edges are relabelled, those within a component dropped and parallel ones reduced to the
smallest, until no edge is left. Components at least halve in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.session import checkpoint, release


def boruvka_groups(pairs: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """(id, group_id): every id that a pair names, with the smallest id (by byte) of its group.

    Pairs with a null end are ignored, a pair of an id with itself only makes the id known; repeated and turned-round
    pairs count once, with their smallest weight; null weights come last. No pairs give no rows. Choosing and reducing
    edges is pre-aggregated before the shuffle; a component with very many edges is one key of a join on one small row
    each, which AQE splits. Joins are merge joins: a broadcast in every step would pile up in the driver's memory, and
    the tables have no size bound. Nothing but a count goes to the driver.
    """
    w = F.col(weight).cast("double") if weight else F.lit(0.0)
    given = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"), F.coalesce(w, F.lit(float("inf"))).alias("w")
    )
    labels = checkpoint(given.select(F.col("x").alias("id")).union(given.select("y")).distinct().select("id", F.col("id").alias("c")))
    single = given.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("w").alias("w"))
    # a component's edge: (ends as components, what orders it)
    edges = checkpoint(single.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.struct("w", "x", "y").alias("rank")))
    while edges.limit(1).count():
        out = edges.select(F.col("cx").alias("c"), F.struct("rank", F.col("cy").alias("to")).alias("e")).union(edges.select(F.col("cy").alias("c"), F.struct("rank", F.col("cx").alias("to")).alias("e")))
        choice = checkpoint(out.groupBy("c").agg(F.min("e").alias("e")).select("c", F.col("e.to").alias("p")))
        back = choice.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        parent = checkpoint(choice.join(back.hint("merge"), "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        held = parent
        release(choice)
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            doubled = checkpoint(parent.join(up.hint("merge"), "p").select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            release(held)
            parent, held = doubled.select("c", "p"), doubled
            if not doubled.where("moved").limit(1).count():
                break
        old = labels
        labels = checkpoint(labels.join(parent.hint("merge"), "c", "left").select("id", F.coalesce("p", "c").alias("c")))
        release(old)
        moved = edges.join(parent.select(F.col("c").alias("cx"), F.col("p").alias("px")).hint("merge"), "cx").join(parent.select(F.col("c").alias("cy"), F.col("p").alias("py")).hint("merge"), "cy").where("px <> py")
        fewer = checkpoint(moved.groupBy(F.least("px", "py").alias("cx"), F.greatest("px", "py").alias("cy")).agg(F.min("rank").alias("rank")))
        release(edges, held)
        edges = fewer
    least = labels.groupBy("c").agg(F.min("id").alias("group_id"))
    return labels.join(least.hint("merge"), "c").select("id", "group_id")


def observation_links(matches: DataFrame, observations: DataFrame) -> DataFrame:
    """(a, b, distance_m) of the matches within their merge radius, ids as in `observations`.

    Ids compare without case and surrounding blanks. Rows with a missing end, distance or radius (NaN counts as
    missing), and ends that no observation has, are left out.
    """
    key = lambda c: F.regexp_replace(F.lower(F.col(c).cast("string")), r"^\s+|\s+$", "")
    near = matches.where(F.col("distance_m").isNotNull() & ~F.isnan("distance_m") & (F.col("distance_m") <= F.col("merge_radius_m")) & ~F.isnan("merge_radius_m"))
    links = near.select(key("observation_id_a").alias("ka"), key("observation_id_b").alias("kb"), F.col("distance_m").cast("double").alias("distance_m")).where(F.col("ka").isNotNull() & F.col("kb").isNotNull())
    known = observations.where(F.col("observation_id").isNotNull()).groupBy(key("observation_id").alias("k")).agg(F.min(F.col("observation_id").cast("string")).alias("id"))
    links = links.join(known.select(F.col("k").alias("ka"), F.col("id").alias("a")), "ka").join(known.select(F.col("k").alias("kb"), F.col("id").alias("b")), "kb")
    return links.select("a", "b", "distance_m")
