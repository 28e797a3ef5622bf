"""Queries over the entity graph, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import has_trait, parse_id, render_id
from ..operators import city, components, conformance, coupling, fold, views
from ..sources import star

ENTITY_SQL = """
entity AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS name, NULL AS parent, FALSE AS is_stub, TRUE AS is_module, FALSE AS is_type FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'region:' || n_regionkey, FALSE, TRUE, FALSE FROM nation
  UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'brand', p_brand, NULL, FALSE, TRUE, FALSE FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'nation:' || s_nationkey, s_acctbal < 0, FALSE, TRUE FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'nation:' || c_nationkey, c_acctbal < 0, FALSE, TRUE FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'brand:' || p_brand, p_size > 45, FALSE, TRUE FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', NULL, 'customer:' || o_custkey, NULL, FALSE, FALSE FROM orders
)"""
EDGE_SQL = """
li AS (SELECT *, CASE l_returnflag WHEN 'N' THEN 'declared' WHEN 'A' THEN 'derived' ELSE 'dynamic-candidate' END AS provenance FROM lineitem),
edge AS (
  SELECT 'invocation' AS edge, 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, provenance, NULL AS is_read, l_linenumber AS s FROM li
  UNION ALL SELECT 'access', 'order:' || l_orderkey, 'supplier:' || l_suppkey, provenance, l_linestatus = 'O', l_linenumber FROM li
  UNION ALL SELECT 'reference', 'supplier:' || l_suppkey, 'part:' || l_partkey, provenance, NULL, l_linenumber FROM li
)"""
CONTAINER_SQL = """
up0 AS (SELECT id, id AS a, 0 AS d FROM entity),
up AS (
  SELECT id, a, 0 AS d FROM up0
  UNION ALL SELECT e.id, e.parent, 1 FROM entity e WHERE e.parent IS NOT NULL
  UNION ALL SELECT e.id, p.parent, 2 FROM entity e JOIN entity p ON p.id = e.parent WHERE p.parent IS NOT NULL
), container AS (
  SELECT u.id, arg_min(u.a, u.d) AS container FROM up u JOIN entity c ON c.id = u.a WHERE c.is_{level} GROUP BY u.id
)"""
FOLD_SQL = """
kept AS (SELECT id FROM entity WHERE {entity}),
inside AS (SELECT c.id, c.container FROM container c WHERE c.id IN (SELECT id FROM kept) AND c.container IN (SELECT id FROM kept)),
folded AS (
  SELECT a.container AS "from", b.container AS "to", count(*)::BIGINT AS count,
         array_to_string(list_sort(list(DISTINCT e.edge)), ';') AS kinds, array_to_string(list_sort(list(DISTINCT e.provenance)), ';') AS provenances,
         a.container = b.container AS self_loop
  FROM edge e JOIN inside a ON a.id = e.src JOIN inside b ON b.id = e.dst WHERE {edge} GROUP BY ALL
)"""


def _sql(level: str, body: str, entity: str = "TRUE", edge: str = "TRUE") -> str:
    return "WITH " + ",".join([ENTITY_SQL, EDGE_SQL, CONTAINER_SQL.format(level=level), FOLD_SQL.format(entity=entity, edge=edge)]) + body


COUPLING_SQL = """
, e2 AS (SELECT * FROM folded WHERE NOT self_loop),
o AS (SELECT "from" AS id, count(*) AS n, sum(count) AS c FROM e2 GROUP BY 1), i AS (SELECT "to" AS id, count(*) AS n, sum(count) AS c FROM e2 GROUP BY 1),
nodes AS (SELECT DISTINCT container AS id FROM inside),
coupled AS (
  SELECT nodes.id, coalesce(o.n, 0)::BIGINT AS fan_out, coalesce(i.n, 0)::BIGINT AS fan_in, coalesce(o.c, 0)::BIGINT AS out_edges, coalesce(i.c, 0)::BIGINT AS in_edges,
         CASE WHEN o.n IS NULL AND i.n IS NULL THEN 0.0 ELSE round(coalesce(o.n, 0)::DOUBLE / (coalesce(o.n, 0) + coalesce(i.n, 0)), 6) END AS instability
  FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id)
)"""
INTERNAL, DECLARED = "NOT coalesce(is_stub, FALSE)", "e.provenance = 'declared'"


def _folded(spark: SparkSession, d: str, level: str, view=None, kinds=None, drop=False) -> fold.Folded:
    return fold.fold(star.entities(spark, d), star.edges(spark, d), level, view, kinds, drop)


def fan_in_top20(spark: SparkSession, d: str) -> DataFrame:
    top = star.edges(spark, d).groupBy(F.col("to").alias("id")).agg(F.count("*").alias("fan_in"))
    return coupling.top_by(top, "fan_in", 20)


def containers(level: str):
    return lambda spark, d: fold.containers(star.entities(spark, d), level)


def fold_edges(level: str, view=None, kinds=None):
    return lambda spark, d: _folded(spark, d, level, view() if view else None, kinds).edges


def fold_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d, "module").nodes


def fold_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d, "type", views.internal_only()).diagnostics


def coupled(level: str, view=None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = _folded(spark, d, level, view() if view else None)
        return coupling.coupling(f.nodes, f.edges)

    return run


def coupling_top(column: str):
    return lambda spark, d: coupling.top_by(coupled("module")(spark, d), column, 10)


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    return fold.dependencies_of(_folded(spark, d, "module").edges, "nation:3")


def dependents(spark: SparkSession, d: str) -> DataFrame:
    return fold.dependents_of(_folded(spark, d, "module").edges, "nation:3")


def inverse_counts(kind: str):
    return lambda spark, d: fold.inverse(star.edges(spark, d), kind).groupBy("id").agg(F.count("*").alias("n"))


def children(spark: SparkSession, d: str) -> DataFrame:
    return fold.children(star.entities(spark, d))


def projected_edges(spark: SparkSession, d: str) -> DataFrame:
    view = views.compose_views(views.internal_only(), views.provenance_only("declared", "derived"))
    kept = views.kept_edges(star.edges(spark, d), star.entities(spark, d), view)
    return kept.groupBy("edge", "provenance").agg(F.count("*").alias("n"))


def ids(spark: SparkSession, d: str) -> DataFrame:
    """Rendered ids of parts and what parsing gives back."""
    p = star.table(spark, d, "part").select(render_id(F.lit("star"), F.concat(F.lit("brand."), F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))), F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.when(F.col("p_size") > 25, F.col("p_size").cast("string"))).alias("id"))
    return p.select("id", parse_id(F.col("id")).alias("k")).select("id", "k.*")


def roles(spark: SparkSession, d: str) -> DataFrame:
    """Reads, writes and calls of each target, from classified edges."""
    e = star.edges(spark, d)
    role = F.filter(F.array(F.when(F.col("is_read"), "reads"), F.when(F.col("is_write"), "writes"), F.when(F.col("edge") == "invocation", "calls"), F.when(F.col("edge") == "reference", "references")), lambda x: x.isNotNull())
    return e.select("to", F.explode(role).alias("role")).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("to").alias("targets"))


def _nation_edges(spark: SparkSession, d: str) -> DataFrame:
    return star.nation_edges(spark, d, NATION_SUPPORT)


NATION_SUPPORT = 110
NATION_SQL = f"""
ne AS (
  SELECT c_nationkey AS "from", s_nationkey AS "to", count(*)::BIGINT AS count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2 HAVING count(*) >= {NATION_SUPPORT}
)"""
REACH_SQL = """
reach(a, b) AS (SELECT "from", "to" FROM ne UNION SELECT r.a, e."to" FROM reach r JOIN ne e ON e."from" = r.b)"""
SCC_SQL = """
scc AS (
  SELECT n_nationkey AS id, least(n_nationkey, coalesce((SELECT min(r.b) FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a WHERE r.a = n_nationkey), n_nationkey)) AS component FROM nation
)"""


def reachability(spark: SparkSession, d: str) -> DataFrame:
    nodes = star.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return components.reachable(_nation_edges(spark, d), nodes)


def _scc(spark: SparkSession, d: str):
    nodes = star.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    edges = components.settle(_nation_edges(spark, d))
    return edges, components.strong_components(nodes, edges)


def scc(spark: SparkSession, d: str) -> DataFrame:
    return _scc(spark, d)[1]


def condensation(spark: SparkSession, d: str) -> DataFrame:
    return components.condense(*_scc(spark, d))


def cycles(spark: SparkSession, d: str) -> DataFrame:
    return components.cycle_report(*_scc(spark, d))


def layering(spark: SparkSession, d: str) -> DataFrame:
    edges, comp = _scc(spark, d)
    return components.layers(comp.select(F.col("component").alias("id")).distinct(), components.condense(edges, comp))


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return components.feedback_arc_set(*_scc(spark, d))


def findings(spark: SparkSession, d: str) -> DataFrame:
    internal = star.entities(spark, d).filter(~F.coalesce("is_stub", F.lit(False)))
    return conformance.counts(conformance.check(internal, star.edges(spark, d)))


def compositions(spark: SparkSession, d: str) -> DataFrame:
    required = {"region": ["TModule"], "nation": ["TModule", "TChildOf"], "supplier": ["TType"], "part": ["TType"], "order": ["TInvocable"], "customer": ["TType"]}
    allowed = {k: ["TNamed", "TChildOf"] for k in ("region", "nation", "supplier", "part", "customer")}
    return conformance.composition(star.entities(spark, d), required, allowed)


def city_buildings(spark: SparkSession, d: str) -> DataFrame:
    f = _folded(spark, d, "type")
    return city.buildings(star.entities(spark, d), coupling.coupling(f.nodes, f.edges))


def city_districts(spark: SparkSession, d: str) -> DataFrame:
    return city.districts(city.sized(city_buildings(spark, d), "degree"))


def city_layout(spark: SparkSession, d: str) -> DataFrame:
    return city.layout(city.sized(city_buildings(spark, d), "degree"))


def trait_counts(spark: SparkSession, d: str) -> DataFrame:
    return star.entities(spark, d).select(F.explode("traits").alias("trait")).groupBy("trait").agg(F.count("*").alias("n"))


def module_members(spark: SparkSession, d: str) -> DataFrame:
    e = star.entities(spark, d)
    return e.filter(has_trait(F.col("traits"), "TType")).groupBy("parent", "kind").agg(F.count("*").alias("types"), F.count_if("is_stub").alias("stubs"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus at a glance, in SQL over registered views."""
    star.entities(spark, d).createOrReplaceTempView("node")
    star.edges(spark, d).createOrReplaceTempView("dep")
    return spark.sql("SELECT edge, provenance, count(*) AS edges, count(DISTINCT `from`) AS sources, count(DISTINCT `to`) AS targets FROM dep GROUP BY edge, provenance")


QUERIES = {
    "fan_in_top20": fan_in_top20,
    "containers_type": containers("type"),
    "containers_module": containers("module"),
    "fold_type": fold_edges("type"),
    "fold_module": fold_edges("module"),
    "fold_module_internal_declared": fold_edges("module", lambda: views.compose_views(views.internal_only(), views.declared_only())),
    "fold_type_invocations": fold_edges("type", kinds=["invocation"]),
    "fold_nodes_module": fold_nodes,
    "fold_diagnostics": fold_diagnostics,
    "coupling_type": coupled("type"),
    "coupling_module": coupled("module"),
    "coupling_internal": coupled("type", views.internal_only),
    "coupling_top_fan_in": coupling_top("fan_in"),
    "coupling_top_fan_out": coupling_top("fan_out"),
    "dependencies_of": dependencies,
    "dependents_of": dependents,
    "callers": inverse_counts("invocation"),
    "accessors": inverse_counts("access"),
    "children": children,
    "view_edges": projected_edges,
    "rendered_ids": ids,
    "edge_roles": roles,
    "reachability": reachability,
    "scc_nation": scc,
    "condensation_nation": condensation,
    "cycles_nation": cycles,
    "layers_nation": layering,
    "feedback_arcs_nation": feedback,
    "conformance_findings": findings,
    "conformance_composition": compositions,
    "city_buildings": city_buildings,
    "city_districts": city_districts,
    "city_layout": city_layout,
    "trait_counts": trait_counts,
    "module_members": module_members,
    "corpus_glance": corpus,
}

_N = "WITH RECURSIVE " + NATION_SQL + "," + REACH_SQL + "," + SCC_SQL
_COND = ', cond AS (SELECT DISTINCT a.component AS "from", b.component AS "to" FROM ne JOIN scc a ON a.id = ne."from" JOIN scc b ON b.id = ne."to" WHERE a.component <> b.component)'
_BUILT = _sql("type", COUPLING_SQL + """
, built AS (
  SELECT e.id, e.parent AS district, coalesce(m.n, 0)::BIGINT AS members, coalesce(c.fan_in, 0)::BIGINT AS fan_in, coalesce(c.fan_out, 0)::BIGINT AS fan_out,
         (coalesce(c.fan_in, 0) + coalesce(c.fan_out, 0))::BIGINT AS degree
  FROM entity e LEFT JOIN (SELECT parent, count(*) AS n FROM entity GROUP BY 1) m ON m.parent = e.id LEFT JOIN coupled c ON c.id = e.id
  WHERE e.is_type AND NOT coalesce(e.is_stub, FALSE)
)""")  # fmt: skip
ORACLES = {
    "fan_in_top20": "WITH" + EDGE_SQL + " SELECT dst AS id, count(*) AS fan_in FROM edge GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "containers_type": _sql("type", " SELECT id, container FROM container"),
    "containers_module": _sql("module", " SELECT id, container FROM container"),
    "fold_type": _sql("type", " SELECT * FROM folded"),
    "fold_module": _sql("module", " SELECT * FROM folded"),
    "fold_module_internal_declared": _sql("module", " SELECT * FROM folded", INTERNAL, DECLARED),
    "fold_type_invocations": _sql("type", " SELECT * FROM folded", "TRUE", "e.edge = 'invocation'"),
    "fold_nodes_module": _sql("module", " SELECT container AS id, count(*) AS entities FROM inside GROUP BY 1"),
    "fold_diagnostics": _sql("type", """
      SELECT (SELECT count(*) FROM kept WHERE id NOT IN (SELECT id FROM inside)) AS unfoldable_entities,
             (SELECT count(*) FROM edge e JOIN kept a ON a.id = e.src JOIN kept b ON b.id = e.dst WHERE e.src NOT IN (SELECT id FROM inside) OR e.dst NOT IN (SELECT id FROM inside)) AS dropped_edges,
             (SELECT count(*) FROM edge e JOIN inside a ON a.id = e.src JOIN inside b ON b.id = e.dst) AS folded_edges""", INTERNAL),
    "coupling_type": _sql("type", COUPLING_SQL + " SELECT * FROM coupled"),
    "coupling_module": _sql("module", COUPLING_SQL + " SELECT * FROM coupled"),
    "coupling_internal": _sql("type", COUPLING_SQL + " SELECT * FROM coupled", INTERNAL),
    "coupling_top_fan_in": _sql("module", COUPLING_SQL + " SELECT * FROM coupled ORDER BY fan_in DESC, id LIMIT 10"),
    "coupling_top_fan_out": _sql("module", COUPLING_SQL + " SELECT * FROM coupled ORDER BY fan_out DESC, id LIMIT 10"),
    "dependencies_of": _sql("module", """ SELECT "to" AS id FROM folded WHERE "from" = 'nation:3' AND NOT self_loop"""),
    "dependents_of": _sql("module", """ SELECT "from" AS id FROM folded WHERE "to" = 'nation:3' AND NOT self_loop"""),
    "callers": "WITH" + EDGE_SQL + " SELECT dst AS id, count(DISTINCT src) AS n FROM edge WHERE edge = 'invocation' GROUP BY 1",
    "accessors": "WITH" + EDGE_SQL + " SELECT dst AS id, count(DISTINCT src) AS n FROM edge WHERE edge = 'access' GROUP BY 1",
    "children": "WITH" + ENTITY_SQL + " SELECT parent AS id, count(DISTINCT id) AS children FROM entity WHERE parent IS NOT NULL GROUP BY 1",
    "view_edges": "WITH" + ENTITY_SQL + "," + EDGE_SQL + f", k AS (SELECT id FROM entity WHERE {INTERNAL}) SELECT edge, provenance, count(*) AS n FROM edge WHERE provenance IN ('declared', 'derived') AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY 1, 2",
    "rendered_ids": """SELECT 'star:' || m || '/' || y || coalesce('#' || dis, '') AS id, 'star' AS lang, m AS module, y AS symbol, dis AS disambiguator FROM (
      SELECT 'brand.' || replace(p_brand, '#', '-') AS m, 'P' || p_partkey AS y, CASE WHEN p_size > 25 THEN p_size::VARCHAR END AS dis FROM part)""",
    "edge_roles": "WITH" + EDGE_SQL + """, r AS (
      SELECT dst, CASE WHEN edge = 'access' AND is_read THEN 'reads' WHEN edge = 'access' AND NOT is_read THEN 'writes' WHEN edge = 'invocation' THEN 'calls' ELSE 'references' END AS role FROM edge)
      SELECT role, count(*) AS n, count(DISTINCT dst) AS targets FROM r GROUP BY 1""",
    "reachability": _N + " SELECT a AS start, b AS id FROM reach",
    "scc_nation": _N + " SELECT id, component FROM scc",
    "condensation_nation": _N + _COND + " SELECT * FROM cond",
    "cycles_nation": _N + """ SELECT component, count(*) AS size, array_to_string(list_sort(list(id)), ';') AS members,
      (SELECT count(*) FROM ne JOIN scc a ON a.id = ne."from" JOIN scc b ON b.id = ne."to" WHERE a.component = s.component AND b.component = s.component AND ne."from" <> ne."to") AS edges,
      (SELECT sum(count)::BIGINT FROM ne JOIN scc a ON a.id = ne."from" JOIN scc b ON b.id = ne."to" WHERE a.component = s.component AND b.component = s.component) AS weight
      FROM scc s GROUP BY component HAVING count(*) >= 2""",
    "layers_nation": _N + _COND + """, paths(id, n) AS (SELECT DISTINCT component, 0 FROM scc UNION SELECT c."from", p.n + 1 FROM paths p JOIN cond c ON c."to" = p.id)
      SELECT id, max(n)::INT AS layer FROM paths GROUP BY 1""",
    "conformance_findings": "WITH" + ENTITY_SQL + "," + EDGE_SQL + f""", k AS (SELECT * FROM entity WHERE {INTERNAL}),
      refs AS (SELECT parent AS id, 'parent' AS how FROM k WHERE parent IS NOT NULL UNION ALL SELECT src, 'from' FROM edge UNION ALL SELECT dst, 'to' FROM edge)
      SELECT 'closure' AS rule, 'error' AS severity, count(*) AS findings FROM (SELECT DISTINCT id, how FROM refs WHERE id NOT IN (SELECT id FROM k)) HAVING count(*) > 0""",
    "conformance_composition": """SELECT 'unknown-kind' AS rule, 'error' AS severity, 'brand' AS subject, ':' || count(DISTINCT p_brand) AS detail FROM part
      UNION ALL SELECT 'missing-required-trait', 'error', 'nation', 'TChildOf:' || count(*) FROM nation UNION ALL SELECT 'trait-not-allowed', 'error', 'order', 'TChildOf:' || count(*) FROM orders""",
    "city_buildings": _BUILT + " SELECT * FROM built",
    "city_districts": _BUILT + """, dom AS (SELECT min(degree)::DOUBLE AS lo, max(degree)::DOUBLE AS hi FROM built), sz AS (
      SELECT district, floor((1 + CASE WHEN hi <= lo THEN 4.5 ELSE sqrt(degree - lo) / sqrt(hi - lo) * 9.0 END) * 1000 + 0.5) / 1000 AS size FROM built, dom)
      SELECT district, count(*) AS buildings, round(sum(size * size), 3) AS footprint FROM sz GROUP BY 1""",
    "trait_counts": "WITH" + ENTITY_SQL + """, t AS (SELECT unnest(CASE WHEN is_module THEN ['TNamed', 'TModule'] WHEN is_type THEN ['TNamed', 'TChildOf', 'TType'] ELSE ['TChildOf', 'TInvocable'] END) AS trait FROM entity)
      SELECT trait, count(*) AS n FROM t GROUP BY 1""",
    "module_members": "WITH" + ENTITY_SQL + " SELECT parent, kind, count(*) AS types, count(*) FILTER (is_stub) AS stubs FROM entity WHERE is_type GROUP BY 1, 2",
    "corpus_glance": "WITH" + EDGE_SQL + " SELECT edge, provenance, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edge GROUP BY 1, 2",
}
