"""Event windows (batch form of the streaming operators), exports and dossiers, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coupling, exports, navigator, planner
from ..sources import star
from ..streaming import events
from . import graph


def _events(spark: SparkSession, d: str) -> DataFrame:
    return star.table(spark, d, "events")


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(_events(spark, d))


def sliding(spark: SparkSession, d: str) -> DataFrame:
    return events.sliding(_events(spark, d))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(_events(spark, d))


def coupling_csv(spark: SparkSession, d: str) -> DataFrame:
    f = graph._folded(spark, d, "module")
    return exports.coupling_csv(coupling.coupling(f.nodes, f.edges)).select("line")


def folded_dot(spark: SparkSession, d: str) -> DataFrame:
    f = graph._folded(spark, d, "module")
    return exports.dot_lines(f.nodes, f.edges)


def folded_plantuml(spark: SparkSession, d: str) -> DataFrame:
    f = graph._folded(spark, d, "module")
    return exports.plantuml_lines(f.nodes, f.edges, "package")


def folded_json(spark: SparkSession, d: str) -> DataFrame:
    f = graph._folded(spark, d, "module")
    return exports.folded_json(f.nodes, f.edges)


def navigator_tree(spark: SparkSession, d: str) -> DataFrame:
    return navigator.tree(star.entities(spark, d))


def dossiers(spark: SparkSession, d: str) -> DataFrame:
    return navigator.dossiers(star.entities(spark, d), star.edges(spark, d))


def unit_status(spark: SparkSession, d: str) -> DataFrame:
    """Units of the nation graph with Merkle fingerprints over their dependencies, held against a store that lacks some."""
    edges, comp = graph._scc(spark, d)
    units = comp.select(F.col("component").alias("id")).distinct()
    hashes = planner.chain(units.withColumn("own", F.sha2(F.col("id").cast("string"), 256)), graph.components.condense(edges, comp))
    stored = hashes.filter("id % 2 = 0")
    return planner.status(hashes, stored).groupBy("status").agg(F.count("*").alias("units"))


QUERIES = {
    "events_tumbling": tumbling,
    "events_sliding": sliding,
    "events_sessions": sessions,
    "export_coupling_csv": coupling_csv,
    "export_folded_dot": folded_dot,
    "export_folded_plantuml": folded_plantuml,
    "export_folded_json": folded_json,
    "navigator_tree": navigator_tree,
    "dossiers": dossiers,
    "unit_status": unit_status,
}

ORACLES = {
    "events_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT start, count(*) AS events FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY 1",
    "events_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS new FROM events),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, n""",
    "navigator_tree": "WITH RECURSIVE " + graph.ENTITY_SQL + """,
      p AS (SELECT id, id AS path, 0 AS depth FROM entity WHERE parent IS NULL OR parent NOT IN (SELECT id FROM entity)
        UNION ALL SELECT e.id, p.path || '>' || e.id, p.depth + 1 FROM entity e JOIN p ON e.parent = p.id)
      SELECT id, path, depth, replace(path, '>', chr(9)) AS preorder FROM p""",
    "dossiers": "WITH " + graph.ENTITY_SQL + "," + graph.EDGE_SQL + """
      SELECT o.parent AS id, count(DISTINCT o.id) AS operations, count(*) FILTER (edge = 'invocation') AS invocations, count(*) FILTER (is_read) AS reads, count(*) FILTER (edge = 'access' AND NOT is_read) AS writes,
        count(*) FILTER (coalesce(t.is_stub, FALSE)) AS external
      FROM entity o JOIN edge e ON e.src = o.id JOIN entity t ON t.id = e.dst WHERE o.kind = 'order' GROUP BY 1""",
    "export_coupling_csv": graph._sql("module", graph.COUPLING_SQL + """ SELECT 'id,fan_in,fan_out,instability,in_edges,out_edges' AS line
      UNION ALL SELECT concat_ws(',', id, fan_in, fan_out, instability::DOUBLE, in_edges, out_edges) FROM coupled"""),
    "export_folded_dot": graph._sql("module", """ SELECT 0 AS part, 'digraph "graph" {' AS line UNION ALL SELECT 3, '}' UNION ALL SELECT DISTINCT 1, '  "' || container || '";' FROM inside
      UNION ALL SELECT 2, '  "' || "from" || '" -> "' || "to" || '" [label="' || count || '", penwidth=' || CASE WHEN count >= 17 THEN 4 WHEN count >= 5 THEN 3 WHEN count >= 2 THEN 2 ELSE 1 END || '];' FROM folded"""),
    "export_folded_plantuml": graph._sql("module", """, a AS (SELECT id, 'n' || row_number() OVER (ORDER BY id) AS alias FROM (SELECT DISTINCT container AS id FROM inside))
      SELECT 0 AS part, '@startuml' AS line UNION ALL SELECT 3, '@enduml' UNION ALL SELECT 1, 'package "' || id || '" as ' || alias FROM a
      UNION ALL SELECT 2, f.alias || ' --> ' || t.alias || ' : ' || count FROM folded JOIN a f ON f.id = "from" JOIN a t ON t.id = "to" """),
    "export_folded_json": graph._sql("module", """ SELECT 'node' AS kind, '{"entities":' || count(*) || ',"id":"' || container || '"}' AS line FROM inside GROUP BY container
      UNION ALL SELECT 'edge', '{"count":' || count || ',"from":"' || "from" || '","kinds":"' || kinds || '","provenances":"' || provenances || '","to":"' || "to" || '"}' FROM folded"""),
    "unit_status": graph._N + " SELECT CASE WHEN id % 2 = 0 THEN 'reuse' ELSE 'new' END AS status, count(*) AS units FROM (SELECT DISTINCT component AS id FROM scc) GROUP BY 1",
}
