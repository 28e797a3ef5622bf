"""Incremental planning: fingerprints chained over dependencies, and the status of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import settle
from .components import layers


def chain(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, own, fingerprint): own hash and, layer by layer, the sorted fingerprints of the unit's dependencies."""
    order = settle(layers(units.select("id"), edges).join(units, "id"))
    e = settle(edges.select("from", "to").distinct())
    top = order.agg(F.max("layer")).first()[0]
    done = None
    for layer in range((top if top is not None else -1) + 1):
        here = order.filter(F.col("layer") == layer)
        if done is None:
            below = here.withColumn("deps", F.array().cast("array<string>"))
        else:
            got = e.join(done.select(F.col("id").alias("to"), "fingerprint"), "to").groupBy(F.col("from").alias("id")).agg(F.sort_array(F.collect_list("fingerprint")).alias("deps"))
            below = here.join(got, "id", "left")
        new = below.select("id", "own", F.sha2(F.concat_ws("|", F.col("own"), F.array_join(F.coalesce("deps", F.array().cast("array<string>")), ",")), 256).alias("fingerprint"))
        done = settle(new if done is None else done.union(new))
    return done if done is not None else units.select("id", "own", F.col("own").alias("fingerprint"))


def status(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, status): reuse where the stored fingerprint is the same, stale where it differs, new where there is none."""
    old = stored.select("id", F.col("fingerprint").alias("old"))
    s = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("fingerprint"), "reuse").otherwise("stale")
    return now.join(old, "id", "left").select("id", s.alias("status"))


def retry_scope(failed: DataFrame, edges: DataFrame) -> DataFrame:
    """Failed units and their direct dependents."""
    dependents = edges.join(failed.select(F.col("id").alias("to")), "to", "left_semi").select(F.col("from").alias("id"))
    return failed.select("id").union(dependents).distinct()
