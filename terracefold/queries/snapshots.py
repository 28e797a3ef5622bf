"""Queries over a snapshot store that the events are appended to, week by week, with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import settle, shared_folder
from ..sources import star
from ..streaming.snapshots import SnapshotStore, append_all, edge_history


def weekly(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows and edges of a snapshot per week: users (their last event's type, number of events) and event types."""
    events = star.table(spark, d, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("user"), "event_type", F.date_trunc("week", "ts").alias("w"))
    events = events.withColumn("sha", F.date_format("w", "yyyy-MM-dd")).withColumn("time", F.unix_timestamp("w"))
    common = [F.lit(False).alias("is_stub"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("disambiguator")]
    users = events.groupBy("sha", "time", "user").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("loc"))
    users = users.select("sha", "time", F.lit(1).alias("ref"), F.lit("user").alias("module"), F.col("user").alias("symbol"), "kind", "loc", *common)
    types = events.groupBy("sha", "time", "event_type").agg(F.countDistinct("user").alias("loc"))
    types = types.select("sha", "time", F.lit(2).alias("ref"), F.lit("type").alias("module"), F.col("event_type").alias("symbol"), F.lit("type").alias("kind"), "loc", *common)
    key = lambda module, symbol: F.struct(F.lit(module).alias("module"), F.col(symbol).alias("symbol"), F.lit(None).cast("string").alias("disambiguator"))
    edges = events.select("sha", key("user", "user").alias("from"), key("type", "event_type").alias("to"), F.lit("access").alias("kind"), F.lit("declared").alias("provenance"))
    return settle(users.unionByName(types)), settle(edges)


def appended(spark: SparkSession, d: str) -> SnapshotStore:
    store = SnapshotStore(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/snapshots-{uuid.uuid4().hex[:12]}")
    append_all(store, *weekly(spark, d))
    return store


def versions(spark: SparkSession, d: str) -> DataFrame:
    return appended(spark, d).versions().select("revision", "sha", "key_id", "module", "symbol", "kind", "loc")


def runs(spark: SparkSession, d: str) -> DataFrame:
    return appended(spark, d).runs()


def edges(spark: SparkSession, d: str) -> DataFrame:
    return edge_history(appended(spark, d))


QUERIES = {"snapshot_versions": versions, "snapshot_runs": runs, "snapshot_edges": edges}

_SQL = """
WITH e AS (SELECT *, date_trunc('week', ts) AS w, user_id::VARCHAR AS u FROM events),
rev AS (SELECT w, row_number() OVER (ORDER BY w) AS revision, strftime(w, '%Y-%m-%d') AS sha FROM (SELECT DISTINCT w FROM e)),
v AS (SELECT w, 'user' AS module, u AS symbol, arg_max(event_type, (ts, event_id)) AS kind, count(*) AS loc FROM e GROUP BY ALL
  UNION ALL SELECT w, 'type', event_type, 'type', count(DISTINCT u) FROM e GROUP BY ALL),
k AS (SELECT module, symbol, row_number() OVER (ORDER BY r, module, symbol) AS key_id FROM (SELECT module, symbol, min(revision) AS r FROM v JOIN rev USING (w) GROUP BY 1, 2)),
x AS (SELECT revision, sha, key_id, module, symbol, kind, loc FROM v JOIN rev USING (w) JOIN k USING (module, symbol))"""
ORACLES = {
    "snapshot_versions": _SQL + " SELECT * FROM x",
    "snapshot_runs": _SQL + """, g AS (SELECT *, revision - row_number() OVER (PARTITION BY key_id, kind, loc ORDER BY revision) AS g FROM x)
      SELECT key_id, min(revision) AS first, max(revision) AS last, kind, loc FROM g GROUP BY key_id, kind, loc, g""",
    "snapshot_edges": _SQL + """, ed AS (SELECT w, a.key_id AS from_key, b.key_id AS to_key, count(*)::BIGINT AS count FROM e JOIN k a ON a.module = 'user' AND a.symbol = u JOIN k b ON b.module = 'type' AND b.symbol = event_type GROUP BY ALL)
      SELECT from_key, to_key, 'access' AS kind, 'declared' AS provenance, min(revision) AS first, max(revision) AS last, count(*) AS revisions, sum(count)::BIGINT AS count FROM ed JOIN rev USING (w) GROUP BY 1, 2""",
}
