"""Connected components of an edge table, distributed.

Alternating large-star and small-star steps: in each, every vertex points its greater (or smaller
or equal) neighbours to its least neighbour. Both keep components and only lower what vertices
point to, until each vertex points straight at the least one of its component; so the rounds end
(they grow with the logarithm of the longest path), and no bound on their number is needed. Each
round is written to the shared folder. Minima are partially aggregated, and the edges of a hub are
never dealt to one task; no neighbourhood is gathered anywhere.

Defined results: an edge with a null end and a loop link nothing; edges may repeat and run either
way; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step over the ``total`` edges (a, b) with a > b; gives such edges."""
    if large:  # each vertex u: its greater neighbours point at the least of u and all neighbours
        back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = edges.withColumn("up", F.lit(0)).unionByName(back.withColumn("up", F.lit(1)))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.sum("up").alias("n"))
        out = spread_join(back, least.where("n > 0"), "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # each vertex u: it and its smaller neighbours point at the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        out = spread_join(edges, least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, total: int | None = None) -> DataFrame:
    """(vertex, root) for each vertex of the links (a, b) that isn't its component's least vertex. ``total``: the
    number of links, where it is known."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges", total)
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        seen = state
        edges = written(_star(edges, True, state[0]), "edges", state[0])
        edges = written(_star(edges, False, state[0]), "edges", state[0])  # a large star makes no more edges than there were
