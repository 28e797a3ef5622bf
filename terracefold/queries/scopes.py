"""Vocabularies by scope and concern drift, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import has_trait
from ..operators import scopes
from ..sources import star
from . import graph

KEYWORDS, TECHNICAL = ["part", "of"], ["brand", "customer", "supplier", "steel", "gear"]


def names(spark: SparkSession, d: str) -> DataFrame:
    """Kept entities with the module and type around them: types under their parent, orders under their customer's nation."""
    e = star.entities(spark, d).filter("NOT coalesce(is_stub, false)")
    module, type_ = has_trait(F.col("traits"), "TModule"), has_trait(F.col("traits"), "TType")
    up = star.entities(spark, d).filter(has_trait(F.col("traits"), "TType")).select(F.col("id").alias("u"), F.col("parent").alias("up"), F.coalesce("is_stub", F.lit(False)).alias("u_stub"))
    e = e.join(up, F.col("parent") == F.col("u"), "left")
    return e.select(
        F.col("id").alias("entity"),
        F.when(module, F.col("id")).when(type_, F.col("parent")).otherwise(F.col("up")).alias("module"),
        F.when(type_, F.col("id")).when(~module & ~F.col("u_stub"), F.col("u")).alias("type"),
        F.when(module, "module").when(type_, "type").otherwise("operation").alias("role"),
        "name",
    )


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return scopes.terms(names(spark, d), KEYWORDS, TECHNICAL)


def totals(spark: SparkSession, d: str) -> DataFrame:
    n = names(spark, d)
    return scopes.scopes(n, scopes.terms(n, KEYWORDS, TECHNICAL))


def spread(spark: SparkSession, d: str) -> DataFrame:
    return scopes.spread(vocabulary(spark, d))


def judgements(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as judgements of a supplier's words: the word and the sense from the text's language and source."""
    docs = star.table(spark, d, "documents").select("doc_id", "lang", "source")
    rows = star.table(spark, d, "labels").join(docs, "doc_id")
    word = F.when(F.col("lang") == "en", "supplier").when(F.col("lang") == "fr", "order").when(F.col("lang") == "de", "steel").otherwise("part")
    concern = F.when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 1, "domain").otherwise("technical")
    return rows.select(F.concat(F.lit("supplier:"), F.col("doc_id").cast("string")).alias("id"), word.alias("word"), concern.alias("concern"), F.col("source").alias("sense"), (F.col("quality") * 0.5 + 0.25).alias("confidence"))


def _drift(spark: SparkSession, d: str):
    return scopes.concern_drift(judgements(spark, d), star.entities(spark, d).select("id", "is_stub"), KEYWORDS, TECHNICAL)


def drift(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d)[0]


def left_out(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d)[1]


def contradicted(spark: SparkSession, d: str) -> DataFrame:
    return scopes.contradicted(_drift(spark, d)[0], 3)


QUERIES = {"vocabulary_scopes": vocabulary, "vocabulary_scope_totals": totals, "vocabulary_scope_spread": spread, "concern_drift": drift, "concern_left_out": left_out, "concern_contradicted": contradicted}

_list = lambda xs: ", ".join(repr(x) for x in xs)
_CLASS = lambda c: f"CASE WHEN {c} IN ({_list(KEYWORDS)}) THEN 'keyword' WHEN length({c}) <= 1 THEN 'short' WHEN {c} IN ({_list(TECHNICAL)}) THEN 'technical' ELSE 'domain' END"
_SQL = "WITH " + graph.ENTITY_SQL + f""",
n AS (SELECT e.id AS entity, CASE WHEN e.is_module THEN e.id WHEN e.is_type THEN e.parent ELSE p.parent END AS module, CASE WHEN e.is_type THEN e.id WHEN NOT e.is_module AND NOT coalesce(p.is_stub, FALSE) THEN p.id END AS type,
  CASE WHEN e.is_module THEN 'module' WHEN e.is_type THEN 'type' ELSE 'operation' END AS role, e.name FROM entity e LEFT JOIN entity p ON p.id = e.parent AND p.is_type WHERE NOT coalesce(e.is_stub, FALSE)),
pc AS (SELECT n.*, unnest(regexp_extract_all(coalesce(name, ''), '[A-Z]?[a-z][a-z0-9]*|[A-Z]+[0-9]*|[0-9]+')) AS w FROM n),
tk AS (SELECT *, lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) AS term FROM pc WHERE NOT regexp_matches(w, '^[0-9]*[^A-Za-z0-9]*$')),
sc AS (SELECT 'corpus' AS level, NULL AS id, entity, term FROM tk UNION ALL SELECT 'module', module, entity, term FROM tk WHERE module IS NOT NULL UNION ALL SELECT 'type', type, entity, term FROM tk WHERE type IS NOT NULL),
vt AS (SELECT level, id, term, {_CLASS('term')} AS class, 8 * count(*)::BIGINT AS weight, count(*) AS occurrences, count(DISTINCT entity) AS carriers FROM sc GROUP BY ALL)"""
_DRIFT = "WITH " + graph.ENTITY_SQL + f""",
j AS (SELECT 'supplier:' || doc_id AS id, CASE lang WHEN 'en' THEN 'supplier' WHEN 'fr' THEN 'order' WHEN 'de' THEN 'steel' ELSE 'part' END AS word,
  CASE WHEN toxic = 1 THEN 'ambiguous' WHEN quality = 1 THEN 'domain' ELSE 'technical' END AS concern, source AS sense, quality * 0.5 + 0.25 AS confidence FROM labels JOIN documents USING (doc_id)),
k AS (SELECT j.*, e.id AS known, coalesce(e.is_stub, FALSE) AS stub, {_CLASS('word')} AS class FROM j LEFT JOIN entity e USING (id)),
o AS (SELECT *, (class = 'domain' AND concern = 'technical') OR (class = 'technical' AND concern = 'domain') AS odd FROM k WHERE known IS NOT NULL AND NOT stub),
dr AS (SELECT word, class, count(*) FILTER (concern = 'domain') AS domain, count(*) FILTER (concern = 'technical') AS technical, count(*) FILTER (concern = 'ambiguous') AS ambiguous, count(*) FILTER (odd) AS against,
  arg_min(id, (-confidence, id, sense)) FILTER (odd) AS surest FROM o GROUP BY 1, 2)"""
ORACLES = {
    "vocabulary_scopes": _SQL + " SELECT * FROM vt",
    "vocabulary_scope_totals": _SQL + """, ns AS (SELECT *, coalesce(name, '') = '' AS unnamed, entity IN (SELECT entity FROM tk) AS speaks, (SELECT count(*) FROM pc WHERE pc.entity = n.entity AND regexp_matches(w, '^[0-9]+$')) AS num FROM n),
      sn AS (SELECT 'corpus' AS level, NULL AS id, * FROM ns UNION ALL SELECT 'module', module, * FROM ns WHERE module IS NOT NULL UNION ALL SELECT 'type', type, * FROM ns WHERE type IS NOT NULL),
      a AS (SELECT level, id, count(*) AS entities, count(*) FILTER (unnamed) AS unnamed, sum(num)::BIGINT AS "numeric", count(*) FILTER (role = 'module' AND speaks) AS modules, count(*) FILTER (role = 'type' AND speaks) AS types,
        count(*) FILTER (role = 'operation' AND speaks) AS operations, 0::BIGINT AS attributes, 0::BIGINT AS parameters FROM sn GROUP BY 1, 2),
      b AS (SELECT level, id, count(*) AS distinct_terms, count(*) FILTER (class = 'domain') AS distinct_domain, sum(weight)::BIGINT AS weight, sum(occurrences)::BIGINT AS occurrences FROM vt GROUP BY 1, 2)
      SELECT a.*, coalesce(distinct_terms, 0) AS distinct_terms, coalesce(distinct_domain, 0) AS distinct_domain, coalesce(weight, 0) AS weight, coalesce(occurrences, 0) AS occurrences FROM a LEFT JOIN b ON a.level = b.level AND a.id IS NOT DISTINCT FROM b.id""",
    "vocabulary_scope_spread": _SQL + " SELECT term, class, count(*) FILTER (level = 'module') AS modules, count(*) FILTER (level = 'type') AS types, CASE WHEN count(*) FILTER (level = 'module') = 1 THEN min(id) FILTER (level = 'module') END AS exclusive FROM vt GROUP BY 1, 2",
    "concern_drift": _DRIFT + " SELECT * FROM dr",
    "concern_left_out": _DRIFT + " SELECT count(*) FILTER (known IS NOT NULL AND NOT stub) AS entries, count(DISTINCT id) FILTER (known IS NOT NULL AND NOT stub) AS entities, count(DISTINCT id) FILTER (known IS NULL) AS unknown, count(DISTINCT id) FILTER (known IS NOT NULL AND stub) AS not_kept FROM k",
    "concern_contradicted": _DRIFT + " SELECT class, row_number() OVER (PARTITION BY class ORDER BY against DESC, word)::INT AS place, word, against FROM dr WHERE against > 0 QUALIFY place <= 3",
}
