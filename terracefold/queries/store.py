"""Queries over the imported graph, with the oracle SQL of their unstored forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coupling, views
from ..sources import star, store
from ..sources.store import Store, fingerprint, open_store
from . import graph

TABLES = ["region", "nation", "part", "supplier", "customer", "orders", "lineitem"]


def opened(spark: SparkSession, d: str, tables: list[str] = store.TABLES) -> Store:
    """The store of the star schema's graph in d, with these tables, imported by the first query that needs them."""
    key = fingerprint(spark, [f"{d}/{t}.parquet" for t in TABLES])
    return open_store(spark, key, lambda: (star.entities(spark, d), star.edges(spark, d)), tables)


def _folds(spark: SparkSession, d: str, level: str) -> Store:
    return opened(spark, d, [f"fold_{level}", f"node_{level}"])


def store_import(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the store's entity and edge tables by kind; imports where that has not been done."""
    s = opened(spark, d)
    entities = s.table("entity").groupBy("kind").agg(F.count("*").alias("rows"))
    edges = s.table("edge").groupBy(F.col("edge").alias("kind")).agg(F.sum("n").alias("rows"))
    return entities.unionByName(edges)


def fan_in(spark: SparkSession, d: str) -> DataFrame:
    return opened(spark, d, ["edge"]).fan_in(20)


def folded(level: str, view=None, kinds=None, drop=False):
    return lambda spark, d: _folds(spark, d, level).fold(level, view() if view else None, kinds, drop).edges


def coupled(level: str, view=None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = _folds(spark, d, level).fold(level, view() if view else None)
        return coupling.coupling(f.nodes, f.edges, dealt=True)

    return run


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _folds(spark, d, "type").fold("type", views.internal_only()).diagnostics


def members(spark: SparkSession, d: str) -> DataFrame:
    return opened(spark, d, []).members("nation:3").select("id", "kind", "type")


QUERIES = {
    "store_import": store_import,
    "store_fan_in": fan_in,
    "store_fold_type": folded("type"),
    "store_fold_module": folded("module"),
    "store_fold_module_internal_declared": folded("module", lambda: views.compose_views(views.internal_only(), views.declared_only())),
    "store_fold_invocations": folded("type", kinds=["invocation"], drop=True),
    "store_coupling_type": coupled("type"),
    "store_coupling_module": coupled("module"),
    "store_coupling_internal": coupled("type", views.internal_only),
    "store_diagnostics": diagnostics,
    "store_members": members,
}

ORACLES = {
    "store_import": "WITH" + graph.ENTITY_SQL + "," + graph.EDGE_SQL + " SELECT kind, count(*) AS rows FROM entity GROUP BY 1 UNION ALL SELECT edge, count(*) FROM edge GROUP BY 1",
    "store_fan_in": graph.ORACLES["fan_in_top20"],
    "store_fold_type": graph.ORACLES["fold_type"],
    "store_fold_module": graph.ORACLES["fold_module"],
    "store_fold_module_internal_declared": graph.ORACLES["fold_module_internal_declared"],
    "store_fold_invocations": graph.ORACLES["fold_type_invocations"] + " WHERE NOT self_loop",
    "store_coupling_type": graph.ORACLES["coupling_type"],
    "store_coupling_module": graph.ORACLES["coupling_module"],
    "store_coupling_internal": graph.ORACLES["coupling_internal"],
    "store_diagnostics": graph.ORACLES["fold_diagnostics"],
    "store_members": graph._sql("module", ", t AS (SELECT id, CASE WHEN is_type THEN id WHEN kind = 'order' THEN parent END AS type FROM entity) SELECT c.id, e.kind, t.type FROM container c JOIN entity e ON e.id = c.id JOIN t ON t.id = c.id WHERE c.container = 'nation:3'"),
}
