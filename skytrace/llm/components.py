"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.tasks import stored
from skytrace.session import discard


def _all_stars(edges: DataFrame) -> bool:
    """Whether no id of ``edges(u, v)``, u above v, has two edges down or edges down and up: then v is u's component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("down")))
    ids = ends.groupBy("id").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return not ids.where("down > 0 AND n > 1").agg(F.count("*")).first()[0]


def components(links: DataFrame, tasks: int = 0) -> DataFrame:
    """``(id, component)`` for the ends of ``links(u, v)``; a component is its smallest id.

    Both steps keep connectivity and only ever attach ids to smaller ones, so hubs grow by a row per
    member and the number of rounds by the logarithm of the longest chain. Minima are combined
    before the shuffle; a hub's rows meet its minimum in an equi-join that Spark can split. Once all edges form
    stars, which one aggregation tells, no further round follows. Nulls and loops are ignored; an empty table
    gives an empty one. Tables are stored by ``tasks`` tasks at most.
    """
    few = lambda e: e.coalesce(tasks) if tasks else e
    spread = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(few(edges), "links")
    while not _all_stars(edges):
        both = spread(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct().select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stored(few(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()), "links")
        discard(before)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
