"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest of itself and its neighbours to its larger neighbours."""
    joined = edges.join(_least(edges), F.col("v") == F.col("n"), "left")
    return joined.select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its other smaller neighbours and to itself."""
    joined = edges.join(_least(edges), F.col("u") == F.col("n"))
    return joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _least(edges: DataFrame) -> DataFrame:
    """(n, m): the smallest neighbour of each node that has a smaller one; edges (u, v) have u > v."""
    return edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links (columns a, b) the smallest node it reaches.

    Alternating large-star and small-star steps. Each step reads one table of the shared folder and writes the next: a
    plan over the steps before it holds each of them several times, and the driver keeps all of that. Rounds end when
    the edges no longer change. Grouping only takes minima, which combine before the shuffle.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        for step in (_large_star, _small_star):
            prev, edges = edges, cut(step(edges), "star")
            drop_cut(prev)
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
