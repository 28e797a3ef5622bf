"""Coupling of a folded graph: fan-in, fan-out, instability, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import u16


def coupling(nodes: DataFrame, edges: DataFrame, self_loops: bool = False, dealt: bool = False) -> DataFrame:
    """(id, fan_out, fan_in, instability, out_edges, in_edges) of every node; isolated ones have zeros.

    dealt: the edges lie dealt by from (a bucketed table, or a shuffle), so that only sums of incoming edges are shuffled.
    """
    e = edges if self_loops else edges.filter(F.col("from") != F.col("to"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    if dealt:
        side = lambda end, way: e.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(f"fan_{way}"), F.sum("count").alias(f"{way}_edges"))
        out = nodes.select("id").join(side("from", "out"), "id", "left").join(side("to", "in"), "id", "left")
        return _shown(out, zero)
    # One aggregation over both directions, so edges are shuffled once.
    both = e.select(F.explode(F.array(F.struct(F.col("from").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in"), "count"), F.struct(F.col("to").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in"), "count"))).alias("x")).select("x.*")
    sums = both.groupBy("id").agg(
        F.sum("out").alias("fan_out"), F.sum("in").alias("fan_in"), F.sum(F.col("out") * F.col("count")).alias("out_edges"), F.sum(F.col("in") * F.col("count")).alias("in_edges")
    )
    return _shown(nodes.select("id").join(sums, "id", "left"), zero)


def _shown(sums: DataFrame, zero) -> DataFrame:
    out = sums.select("id", *[zero(c) for c in ("fan_out", "fan_in", "out_edges", "in_edges")])
    total = F.col("fan_in") + F.col("fan_out")
    return out.withColumn("instability", F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col("fan_out") / total, 6)))


def top_by(table: DataFrame, column: str, n: int) -> DataFrame:
    return table.orderBy(F.col(column).desc(), u16(F.col("id"))).limit(n)
