"""Navigator queries, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import navigate
from ..sources import star
from . import graph

CAP, NAMED = 40, ["region:0", "region:2", "nation:3", "brand:Brand#2", "brand:Brand#7"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return navigate.nodes(star.entities(spark, d), star.edges(spark, d))


def _both(spark: SparkSession, d: str, coupled: bool = True):
    return navigate.navigator(star.entities(spark, d), star.edges(spark, d), coupled)


def rows(spark: SparkSession, d: str) -> DataFrame:
    """The tree; -1 where a node has no parent or its category no coupling."""
    return _rows(spark, d).fillna(-1, ["parent", "fan_in", "fan_out"])


def deps(spark: SparkSession, d: str) -> DataFrame:
    """The dependency rows; -1 where no member carries an end."""
    return _both(spark, d, False)[1].fillna(-1, ["member", "to_member"])


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, False)[2]


def subtrees(spark: SparkSession, d: str) -> DataFrame:
    return navigate.subtrees(star.entities(spark, d), star.edges(spark, d), NAMED)


def display(spark: SparkSession, d: str) -> DataFrame:
    """The shown nodes, how many of the shown pairs touch each, and whether more were left out."""
    rows, found, _ = _both(spark, d)
    shown, edges, total = navigate.display(rows, found, CAP)
    ends = edges.select(F.explode(F.array("from", "to")).alias("node"), "count", "all_declared").groupBy("node").agg(F.count("*").alias("pairs"), F.sum("count").alias("edges"), F.count_if("all_declared").alias("declared"))
    one = total.select("total_nodes", "truncated", F.lit(1).alias("_k"))
    return shown.join(ends, "node", "left").fillna(0).withColumn("_k", F.lit(1)).join(one, "_k").select("node", "name", "fan_in", "pairs", "edges", "declared", "total_nodes", "truncated")


def packages(spark: SparkSession, d: str) -> DataFrame:
    word = F.split("p_name", " ")
    name = F.concat_ws(".", F.lower("p_type"), word[0], word[1], F.concat(F.lit("s"), F.col("p_size").cast("string")))
    # Names of a few kinds end earlier, so that modules also stand inside the tree.
    short = F.when(F.col("p_size") <= 2, F.concat_ws(".", F.lower("p_type"), word[0])).when(F.col("p_size") <= 6, F.concat_ws(".", F.lower("p_type"), word[0], word[1])).otherwise(name)
    tree = navigate.packages(star.table(spark, d, "part").select(F.col("p_partkey").alias("id"), short.alias("name"), (F.col("p_size") > 30).alias("is_stub")))
    return tree.fillna(-1, ["id"])  # groups


QUERIES = {"navigator_rows": rows, "navigator_deps": deps, "navigator_diagnostics": diagnostics, "navigator_subtrees": subtrees, "navigator_display": display, "package_tree": packages}

_LEVEL = lambda level: "(WITH " + graph.CONTAINER_SQL.format(level=level) + "," + graph.FOLD_SQL.format(entity="TRUE", edge="TRUE") + graph.COUPLING_SQL + " SELECT * FROM coupled)"
_ROWS = "WITH RECURSIVE " + graph.ENTITY_SQL + "," + graph.EDGE_SQL + f""",
cat AS (SELECT *, CASE WHEN is_module THEN 1 WHEN is_type THEN 2 ELSE 3 END AS rank, coalesce(name, id) AS label FROM entity),
walk AS (SELECT id, parent, 0 AS depth, [{{'r': rank, 'l': label, 'i': id}}] AS path FROM cat WHERE parent IS NULL
  UNION ALL SELECT c.id, c.parent, w.depth + 1, list_append(w.path, {{'r': c.rank, 'l': c.label, 'i': c.id}}) FROM cat c JOIN walk w ON c.parent = w.id),
num AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS node FROM walk),
above AS (SELECT id, unnest(list_transform(path, lambda p: p.i)) AS a FROM walk),
sizes AS (SELECT a AS id, count(*) AS size FROM above GROUP BY 1),
tc AS {_LEVEL('type')}, mc AS {_LEVEL('module')},
metric AS (SELECT id, 2 AS rank, fan_in, fan_out, instability FROM tc UNION ALL SELECT id, 1, fan_in, fan_out, instability FROM mc),
nav AS (SELECT n.node, c.id, c.label AS name, c.kind, ['module', 'type', 'operation'][c.rank] AS category, coalesce(c.is_stub, FALSE) AS is_stub, p.node AS parent, n.depth, s.size,
    (SELECT count(*) FROM entity k WHERE k.parent = c.id) AS children, m.fan_in, m.fan_out, m.instability
  FROM cat c JOIN num n USING (id) JOIN sizes s USING (id) LEFT JOIN num p ON p.id = c.parent LEFT JOIN metric m ON m.id = c.id AND m.rank = c.rank)"""
_DEPS = _ROWS + """,
owner AS (SELECT c.id, CASE WHEN c.rank = 3 THEN p.node ELSE n.node END AS o, CASE WHEN c.rank = 3 THEN n.node END AS m FROM cat c JOIN num n USING (id) LEFT JOIN num p ON p.id = c.parent),
role AS (SELECT *, CASE WHEN edge = 'access' AND is_read THEN 'reads' WHEN edge = 'access' THEN 'writes' WHEN edge = 'invocation' THEN 'calls' ELSE 'references' END AS role FROM edge),
dep AS (SELECT role, a.o AS "from", b.o AS "to", a.m AS member, b.m AS to_member, provenance, count(*)::BIGINT AS n FROM role JOIN owner a ON a.id = src JOIN owner b ON b.id = dst WHERE a.o <> b.o GROUP BY ALL)"""
ORACLES = {
    "navigator_rows": _ROWS + " SELECT * REPLACE (coalesce(parent, -1) AS parent, coalesce(fan_in, -1) AS fan_in, coalesce(fan_out, -1) AS fan_out) FROM nav",
    "navigator_deps": _DEPS + " SELECT * REPLACE (coalesce(member, -1) AS member, coalesce(to_member, -1) AS to_member) FROM dep",
    "navigator_diagnostics": _DEPS + " SELECT (SELECT count(*) FROM edge JOIN owner a ON a.id = src JOIN owner b ON b.id = dst WHERE a.o = b.o) AS self_deps, (SELECT count(*) FROM edge WHERE src NOT IN (SELECT id FROM owner WHERE o IS NOT NULL) OR dst NOT IN (SELECT id FROM owner WHERE o IS NOT NULL)) AS dropped_deps",
    "navigator_subtrees": _DEPS + f""", s AS (SELECT id, node AS lo, node + size - 1 AS hi FROM nav WHERE id IN ({', '.join(repr(n) for n in NAMED)}))
      SELECT id, coalesce(sum(n) FILTER ("from" BETWEEN lo AND hi AND "to" BETWEEN lo AND hi), 0)::BIGINT AS inside, coalesce(sum(n) FILTER ("from" BETWEEN lo AND hi AND "to" NOT BETWEEN lo AND hi), 0)::BIGINT AS leaving,
        coalesce(sum(n) FILTER ("from" NOT BETWEEN lo AND hi AND "to" BETWEEN lo AND hi), 0)::BIGINT AS entering FROM s JOIN dep ON "from" BETWEEN lo AND hi OR "to" BETWEEN lo AND hi GROUP BY id""",
    "navigator_display": _DEPS + f""", ok AS (SELECT node, name, coalesce(fan_in, 0) AS fan_in FROM nav WHERE category = 'type' AND NOT is_stub),
      pairs AS (SELECT "from", "to", sum(n)::BIGINT AS c, bool_and(provenance = 'declared') AS d FROM dep WHERE "from" IN (SELECT node FROM ok) AND "to" IN (SELECT node FROM ok) GROUP BY 1, 2),
      t AS (SELECT "from" AS node FROM pairs UNION SELECT "to" FROM pairs), shown AS (SELECT ok.* FROM ok JOIN t USING (node) ORDER BY fan_in DESC, name, node LIMIT {CAP}),
      e AS (SELECT * FROM pairs WHERE "from" IN (SELECT node FROM shown) AND "to" IN (SELECT node FROM shown)), ends AS (SELECT "from" AS node, c, d FROM e UNION ALL SELECT "to", c, d FROM e)
      SELECT s.node, s.name, s.fan_in, count(c) AS pairs, coalesce(sum(c), 0)::BIGINT AS edges, count(*) FILTER (d) AS declared, (SELECT count(*) FROM t) AS total_nodes, (SELECT count(*) FROM t) > {CAP} AS truncated
      FROM shown s LEFT JOIN ends USING (node) GROUP BY s.node, s.name, s.fan_in""",
    "package_tree": """
WITH w AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS s, lower(p_type) AS t, p_size, p_size > 30 AS stub FROM part),
m AS (SELECT id, stub, CASE WHEN p_size <= 2 THEN t || '.' || s[1] WHEN p_size <= 6 THEN t || '.' || s[1] || '.' || s[2] ELSE t || '.' || s[1] || '.' || s[2] || '.s' || p_size END AS name FROM w),
x AS (SELECT id, stub, name, array_to_string(string_split(name, '.')[:k], '.') AS path, array_to_string(string_split(name, '.')[:k - 1], '.') AS up FROM (SELECT *, unnest(range(1, len(string_split(name, '.')) + 1)) AS k FROM m)),
pl AS (SELECT path, any_value(up) AS up, count(*) FILTER (path = name) AS modules, min(id) FILTER (path = name) AS id, bool_and(stub) AS all_stub FROM x GROUP BY 1),
ro AS (SELECT * FROM pl WHERE NOT (modules = 0 AND (SELECT count(*) FROM pl c WHERE c.up = pl.path) = 1)),
ab AS (SELECT r.*, (SELECT arg_max(a.path, length(a.path)) FROM ro a WHERE starts_with(r.path, a.path || '.')) AS parent FROM ro r),
la AS (SELECT *, CASE WHEN parent IS NULL THEN path ELSE substr(path, length(parent) + 2) END AS label FROM ab),
ev AS (SELECT path, CASE WHEN modules = 1 THEN 'module' ELSE 'group' END AS kind, CASE WHEN modules = 1 THEN id END AS id, label, parent, all_stub, FALSE AS inner_ FROM la
  UNION ALL SELECT l.path, 'module', m.id, l.label, l.path, m.stub, TRUE FROM la l JOIN m ON m.name = l.path WHERE l.modules > 1)
SELECT path, kind, coalesce(id, -1) AS id, label, parent, CASE WHEN inner_ THEN 0 ELSE (SELECT count(*) FROM ev c WHERE c.parent = ev.path) END AS children, all_stub FROM ev
""",
}
