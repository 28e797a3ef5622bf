"""Snapshots: revisions, timelines, lifespans, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def revision_order(revisions: DataFrame) -> DataFrame:
    """(revision, ordinal): by time, those without one last, then by id. Revisions are few; rows are one per snapshot."""
    w = Window.orderBy(F.col("time").isNull(), "time", "id")
    return revisions.select(F.col("id").alias("revision"), F.row_number().over(w).alias("ordinal"))


def lifespans(versions: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(key, appeared, last_seen, versions, kind, in_latest) of each key."""
    last = ordinals.agg(F.max("ordinal").alias("latest")).withColumn("_k", F.lit(1))  # one row
    v = versions.join(ordinals, "revision")
    out = v.groupBy("key").agg(
        F.min("ordinal").alias("appeared"), F.max("ordinal").alias("last_seen"), F.count("*").alias("versions"), F.max_by("kind", "ordinal").alias("kind")
    )
    return out.withColumn("_k", F.lit(1)).join(F.broadcast(last), "_k").select("key", "appeared", "last_seen", "versions", "kind", (F.col("last_seen") == F.col("latest")).alias("in_latest"))


def entity_history(versions: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(key, kind, series): sizes by ordinal as 'ordinal=loc' joined by ';'."""
    v = versions.join(ordinals, "revision")
    series = F.array_sort(F.collect_list(F.struct("ordinal", "loc")))
    out = v.groupBy("key").agg(F.max_by("kind", "ordinal").alias("kind"), series.alias("s"))
    return out.select("key", "kind", F.array_join(F.transform("s", lambda x: F.concat_ws("=", x["ordinal"].cast("string"), x["loc"].cast("string"))), ";").alias("series"))


def heat(versions: DataFrame, ordinals: DataFrame, decay: float = 0.6) -> DataFrame:
    """(key, ordinal, reborn, heat): rebirth after a gap, and decay to the power of revisions since the last change."""
    w = Window.partitionBy("key").orderBy("ordinal")
    v = versions.join(ordinals, "revision").select("key", "ordinal", "loc")
    before, size = F.lag("ordinal").over(w), F.lag("loc").over(w)
    v = v.withColumn("reborn", F.coalesce(F.col("ordinal") - before > 1, F.lit(False))).withColumn("changed", before.isNull() | (size != F.col("loc")))
    mark = F.last(F.when(F.col("changed"), F.col("ordinal")), ignorenulls=True).over(w)
    return v.select("key", "ordinal", "reborn", F.round(F.pow(F.lit(decay), F.col("ordinal") - mark), 6).alias("heat"))


def append_snapshot(store: DataFrame, new: DataFrame, sha: str) -> DataFrame:
    """store with the rows of a new revision, of each key the first by ref; a revision that is there already is refused."""
    if not store.filter(F.col("revision") == sha).isEmpty():
        raise ValueError(f"revision {sha} is in the store already")
    order = F.col("ref") if "ref" in new.columns else F.monotonically_increasing_id()
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(order))).filter("_n = 1").drop("_n")
    return store.unionByName(first.withColumn("revision", F.lit(sha)), allowMissingColumns=True)


def edge_versions(edges: DataFrame) -> DataFrame:
    """(from, to, kind, provenance, count)."""
    return edges.groupBy("from", "to", F.col("edge").alias("kind"), "provenance").agg(F.count("*").alias("count"))
