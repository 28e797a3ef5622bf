"""Navigator tree, edge roles per pair, type dossiers, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import settle


def tree(entities: DataFrame) -> DataFrame:
    """(id, path, depth, preorder): ids from the root down, joined by '>'; rows in order of preorder are in preorder.

    preorder joins the same ids by tabs, which come before all that ids hold, so a node's part of the tree follows it.

    Paths double in length each round, so deep trees need few rounds; what runs in a circle is absent.
    """
    ids = entities.select("id", "parent")
    known = ids.select(F.col("id").alias("k"))
    now = ids.join(known, F.col("parent") == F.col("k"), "left").select("id", F.array("id").alias("up"), F.col("k").alias("next"))
    total, reach = None, 1
    while True:
        now = settle(now)
        total = now.count() if total is None else total
        if reach > total or now.filter("next IS NOT NULL").isEmpty():
            break
        reach *= 2
        hop = now.select(F.col("id").alias("h"), F.col("up").alias("up2"), F.col("next").alias("next2"))
        now = now.join(hop, F.col("next") == F.col("h"), "left").select("id", F.concat("up", F.coalesce("up2", F.array().cast("array<string>"))).alias("up"), F.col("next2").alias("next"))
    return now.filter("next IS NULL").select("id", F.array_join(F.reverse("up"), ">").alias("path"), (F.size("up") - 1).alias("depth"), F.array_join(F.reverse("up"), "\t").alias("preorder"))


def dossiers(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Per type: its operations with outgoing facts, how many invocations, reads and writes, and how many leave the corpus."""
    ops = entities.filter(F.array_contains("traits", "TInvocable")).select(F.col("id").alias("from"), F.col("parent").alias("owner"))
    target = entities.select(F.col("id").alias("to"), F.coalesce("is_stub", F.lit(False)).alias("external"))
    facts = edges.select("from", "to", "edge", "is_read", "is_write").join(ops, "from").join(target, "to")
    return facts.groupBy(F.col("owner").alias("id")).agg(
        F.countDistinct("from").alias("operations"),
        F.count_if(F.col("edge") == "invocation").alias("invocations"),
        F.count_if(F.coalesce("is_read", F.lit(False))).alias("reads"),
        F.count_if(F.coalesce("is_write", F.lit(False))).alias("writes"),
        F.count_if("external").alias("external"),
    )


def search(nodes: DataFrame, needle: str, limit: int) -> tuple[DataFrame, bool]:
    """(matches, truncated): nodes whose lower-case id holds the needle; the limit is the report's."""
    hit = nodes.filter(F.contains(F.lower("id"), F.lit(needle.lower()))).orderBy("id").limit(limit + 1)
    return hit.limit(limit), hit.count() > limit
