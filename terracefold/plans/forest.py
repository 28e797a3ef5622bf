"""Numbers of trees by pointer doubling: depth, size and preorder of every node, in rounds that grow with the logarithm of depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import settle
from .order import positions


def jumps(pointers: DataFrame, sums: list[str], lift: str | None = None) -> DataFrame:
    """(id, root, steps, sums...) of pointers (id, next, sums...): where following next ends, in how many steps, and sums of
    columns over the nodes on the way, the last one included.

    lift names a sum that runs the other way: what all nodes whose way leads through a node bring to it, itself included.
    next must be an id of the table or null. Nodes that run in a circle are absent. Each round joins the table with itself
    once; ways double in length, so 100 000 steps take 17 rounds.
    """
    down = [c for c in sums if c != lift]
    now = settle(pointers.select("id", "next", F.col("id").alias("root"), F.lit(0).cast("long").alias("steps"), *sums))
    total, reach = now.count(), 1
    while reach <= total and not now.filter("next IS NOT NULL").isEmpty():
        hop = now.select(F.col("id").alias("h"), F.col("next").alias("n2"), F.col("root").alias("r2"), F.col("steps").alias("s2"), *[F.col(c).alias(f"{c}_2") for c in down])
        met = F.col("h").isNotNull()
        after = now.join(hop, F.col("next") == F.col("h"), "left")
        out = [
            "id",
            F.col("n2").alias("next"),
            F.when(met, F.col("r2")).otherwise(F.col("root")).alias("root"),
            F.when(met, F.col("steps") + F.col("s2") + 1).otherwise(F.col("steps")).alias("steps"),
            *[(F.col(c) + F.coalesce(f"{c}_2", F.lit(0))).alias(c) for c in down],
        ]
        if lift:
            # All that a node has gathered so far goes to the node that its pointer names; sums combine before the shuffle.
            brought = now.filter("next IS NOT NULL").groupBy(F.col("next").alias("b")).agg(F.sum(lift).alias("brought"))
            after = after.join(brought, F.col("id") == F.col("b"), "left")
            out.append((F.col(lift) + F.coalesce("brought", F.lit(0))).alias(lift))
        now = settle(after.select(*out))
        reach *= 2
    return now.filter("next IS NULL").drop("next")


def preorder(nodes: DataFrame, order: list[str]) -> DataFrame:
    """(id, parent, depth, pre, size) of the forest of nodes (id, parent, order...): pre counts from 0, a node's subtree is pre to
    pre + size - 1, siblings and roots stand in the given order (then by id).

    A parent that is no node makes a root. What hangs on a circle is absent. No window or sort spans a parent's children: their
    places, and the sizes before them, come from ranges.
    """
    known, order = nodes.select(F.col("id").alias("k")), [c for c in order if c != "id"]
    linked = settle(nodes.join(known, F.col("parent") == F.col("k"), "left").select("id", F.col("k").alias("next"), *order))
    sized = jumps(linked.select("id", "next", F.lit(1).cast("long").alias("size")), ["size"], lift="size").select("id", F.col("steps").alias("depth"), "size")
    tree = linked.join(sized, "id")
    placed = positions(tree.select(F.col("next").alias("parent"), "id", *order, "depth", "size"), [*order, "id"], "place", ["parent"], {"before": "size"})
    # A child comes one after its parent and the sizes of its earlier siblings; a root after the earlier roots.
    step = F.col("before") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    placed = settle(placed.select("id", "parent", "depth", "size", step.cast("long").alias("pre")))
    summed = jumps(placed.select("id", F.col("parent").alias("next"), "pre"), ["pre"]).select("id", "pre")
    return placed.drop("pre").join(summed, "id").select("id", "parent", "depth", "pre", "size")
