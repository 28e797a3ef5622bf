"""Domain dossiers of the star schema, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dossiers
from ..sources import star
from . import graph


def facts(spark: SparkSession, d: str) -> DataFrame:
    return dossiers.as_json(dossiers.dossiers(star.entities(spark, d), star.edges(spark, d)))


def modules(spark: SparkSession, d: str) -> DataFrame:
    rows = dossiers.modules(star.entities(spark, d), star.edges(spark, d), ["reference"])
    return rows.select("id", "name", F.to_json("types").alias("types"), F.to_json("imports").alias("imports"))


QUERIES = {"domain_facts": facts, "domain_modules": modules}

ORACLES = {
    "domain_facts": "WITH " + graph.ENTITY_SQL + "," + graph.EDGE_SQL.replace("l_linenumber AS s FROM li\n", "l_linenumber AS s, (l_linenumber + l_quantity)::BIGINT AS e FROM li\n").replace("l_linenumber FROM li\n", "l_linenumber, (l_linenumber + l_quantity)::BIGINT FROM li\n") + """,
f AS (SELECT edge.*, t.name AS tn, coalesce(t.is_stub, FALSE) AS ext FROM edge JOIN entity t ON t.id = dst WHERE edge <> 'reference'),
i AS (SELECT src, list({'to': dst, 'targetType': dst, 'targetTypeName': tn, 'external': ext, 'provenance': provenance, 'start': s, 'end': e} ORDER BY s, e, dst, provenance) AS x FROM f WHERE edge = 'invocation' GROUP BY 1),
a AS (SELECT src, list({'to': dst, 'field': tn, 'ownerType': dst, 'ownerTypeName': tn, 'isRead': is_read, 'isWrite': NOT is_read, 'external': ext, 'provenance': provenance, 'start': s, 'end': e} ORDER BY s, e, dst, is_read, provenance) AS x FROM f WHERE edge = 'access' GROUP BY 1),
o AS (SELECT e.parent, '{"id":"' || e.id || '","kind":"order","annotations":[],"invocations":' || coalesce(to_json(i.x)::VARCHAR, '[]') || ',"accesses":' || coalesce(to_json(a.x)::VARCHAR, '[]') || ',"throws":[]}' AS j, e.id
  FROM entity e LEFT JOIN i ON i.src = e.id LEFT JOIN a ON a.src = e.id WHERE kind = 'order'),
p AS (SELECT parent, string_agg(j, ',' ORDER BY id) AS j FROM o GROUP BY 1)
SELECT id, '{"id":"' || id || '","kind":"' || kind || '","name":"' || name || '","module":"' || entity.parent || '","supertypes":[],"fields":[],"operations":[' || coalesce(j, '') || ']}' AS facts
FROM entity LEFT JOIN p ON p.parent = id WHERE is_type AND NOT is_stub""",
    "domain_modules": graph._sql("module", """, im AS (SELECT "from", to_json(list({'to': "to", 'name': e.name, 'count': count, 'external': FALSE} ORDER BY "to"))::VARCHAR AS x FROM folded JOIN entity e ON e.id = "to" WHERE NOT self_loop GROUP BY 1),
      ty AS (SELECT parent, to_json(list(id ORDER BY id))::VARCHAR AS x FROM entity WHERE is_type AND NOT is_stub GROUP BY 1)
      SELECT e.id, e.name, coalesce(ty.x, '[]') AS types, coalesce(im.x, '[]') AS imports FROM entity e LEFT JOIN ty ON ty.parent = e.id LEFT JOIN im ON im."from" = e.id WHERE is_module""", edge="e.edge = 'reference'"),
}
