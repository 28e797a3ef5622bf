"""Replay of the suppliers' history as a city, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, replay
from ..plans.fixpoint import settle
from ..sources import star
from .evolution import CONFIDENCE, COUPLED_SQL, HISTORY_SQL, LARGEST, SUPPORT


def _sizes(spark: SparkSession, d: str):
    commits = star.commits(spark, d)
    changes = star.changes(spark, d).withColumn("deleted", F.col("deleted") * 9)
    clock = settle(replay.ticks(commits))
    return clock, settle(replay.sizes(commits, changes, clock))


def frames(spark: SparkSession, d: str) -> DataFrame:
    return replay.frames(_sizes(spark, d)[1])


def buildings(spark: SparkSession, d: str) -> DataFrame:
    return replay.buildings(_sizes(spark, d)[1])


def state(spark: SparkSession, d: str) -> DataFrame:
    """The city at every quarter of its time."""
    clock, rows = _sizes(spark, d)
    at = clock.agg(F.max("tick").alias("m")).select(F.explode(F.array(*[F.floor(F.col("m") * k / 4) for k in range(5)])).alias("at"))
    return replay.state_at(replay.frames(rows), at)


def arcs(spark: SparkSession, d: str) -> DataFrame:
    """Co-changing suppliers as arcs between their nations and their regions."""
    pairs = history.logical_coupling(star.changes(spark, d), SUPPORT, CONFIDENCE, LARGEST)
    s = star.table(spark, d, "supplier").join(star.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    raised = s.select(F.col("s_suppkey").alias("file"), F.explode(F.array(F.concat(F.lit("nation:"), "n_nationkey"), F.concat(F.lit("region:"), "n_regionkey"))).alias("building"))
    return replay.arcs(pairs, raised)


QUERIES = {"replay_frames": frames, "replay_buildings": buildings, "replay_state": state, "replay_arcs": arcs}

_H, _F = replay.HEIGHT, replay.FOOTPRINT
_height = lambda v: f"CASE WHEN {v} <= 0 THEN 0.0 ELSE floor(CASE WHEN hi <= 0 THEN {(_H[0] + _H[1]) / 2} ELSE {_H[0]} + greatest(least({v}::DOUBLE / hi, 1.0), 0.0) * {_H[1] - _H[0]} END * 1000 + 0.5) / 1000 END"
_SQL = "WITH" + HISTORY_SQL + f""",
clock AS (SELECT commit, row_number() OVER (ORDER BY time, commit) - 1 AS tick FROM commits),
s AS (SELECT path, tick, added + 9 * deleted AS churn, sum(added - 9 * deleted) OVER w AS s FROM changes JOIN commits USING (commit) JOIN clock USING (commit) WINDOW w AS (PARTITION BY path ORDER BY tick)),
z AS (SELECT path, tick, churn, (s - least(min(s) OVER (PARTITION BY path ORDER BY tick), 0))::BIGINT AS loc FROM s),
top AS (SELECT max(loc)::DOUBLE AS hi FROM z),
fr AS (SELECT path, tick, {_height('loc')} AS height, CASE WHEN loc > 0 THEN 1 ELSE 0 END AS heat FROM z, top)"""
ORACLES = {
    "replay_frames": _SQL + " SELECT * FROM fr",
    "replay_buildings": _SQL + f""", per AS (SELECT path, arg_max(loc, tick) AS loc, max(loc) AS peak, count(*) AS revisions, sum(churn)::BIGINT AS churn FROM z GROUP BY 1), dom AS (SELECT max(peak)::DOUBLE AS hi, min(peak)::DOUBLE AS lo FROM per)
      SELECT path, {_height('loc')} AS height, floor(CASE WHEN hi <= lo THEN {(_F[0] + _F[1]) / 2} ELSE {_F[0]} + greatest(least(sqrt(peak - lo) / sqrt(hi - lo), 1.0), 0.0) * {_F[1] - _F[0]} END * 1000 + 0.5) / 1000 AS side, loc, peak, revisions, churn FROM per, dom""",
    "replay_state": _SQL + """, q AS (SELECT DISTINCT floor((SELECT max(tick) FROM clock) * k / 4.0)::BIGINT AS "at" FROM range(5) t(k))
      SELECT "at", path, arg_max(height, tick) AS height, max(tick) AS since FROM q JOIN fr ON tick <= "at" GROUP BY 1, 2""",
    "replay_arcs": "WITH" + HISTORY_SQL + "," + COUPLED_SQL + """, b AS (SELECT s_suppkey AS file, unnest(['nation:' || n_nationkey, 'region:' || n_regionkey]) AS building FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      m AS (SELECT least(x.building, y.building) AS a, greatest(x.building, y.building) AS b, support, confidence FROM coupled c JOIN b x ON x.file = c.a JOIN b y ON y.file = c.b WHERE x.building <> y.building)
      SELECT a, b, max(support) AS support, arg_max(confidence, (support, confidence)) AS confidence FROM m GROUP BY 1, 2""",
}
