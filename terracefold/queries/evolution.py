"""Queries over history, snapshots, names and insights, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import components, history, insights, temporal, vocabulary
from ..sources import star

HISTORY_SQL = """
commits AS (SELECT o_orderkey AS commit, o_custkey AS author, epoch(o_orderdate)::BIGINT AS time, o_orderpriority = '1-URGENT' AS is_fix, o_orderstatus = 'P' AS is_revert FROM orders),
changes AS (SELECT l_orderkey AS commit, l_suppkey AS path, sum(l_quantity)::BIGINT AS added, sum(l_linenumber)::BIGINT AS deleted FROM lineitem GROUP BY 1, 2)"""
SUPPORT, CONFIDENCE, LARGEST = 3, 0.02, 8
COUPLED_SQL = f"""
revs AS (SELECT path, count(*) AS n FROM changes GROUP BY 1),
small AS (SELECT * FROM changes WHERE commit IN (SELECT commit FROM changes GROUP BY 1 HAVING count(*) <= {LARGEST})),
coupled AS (
  SELECT a, b, support, round(support / greatest(least(x.n, y.n), 1), 6) AS confidence
  FROM (SELECT s.path AS a, t.path AS b, count(*)::BIGINT AS support FROM small s JOIN small t ON s.commit = t.commit AND s.path < t.path GROUP BY 1, 2 HAVING count(*) >= {SUPPORT})
  JOIN revs x ON x.path = a JOIN revs y ON y.path = b WHERE support / greatest(least(x.n, y.n), 1) >= {CONFIDENCE}
)"""
BY_SQL = "by_author AS (SELECT path, author, sum(added)::BIGINT AS added FROM changes JOIN commits USING (commit) GROUP BY 1, 2)"


def summary(spark: SparkSession, d: str) -> DataFrame:
    return history.summary(star.commits(spark, d), star.changes(spark, d))


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    paths = star.table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"))
    return history.hotspots(paths, star.commits(spark, d), star.changes(spark, d))


def owners(spark: SparkSession, d: str) -> DataFrame:
    return history.file_owners(star.commits(spark, d), star.changes(spark, d))


def authors(spark: SparkSession, d: str) -> DataFrame:
    return history.author_stats(star.commits(spark, d), star.changes(spark, d))


def bus_factor(spark: SparkSession, d: str) -> DataFrame:
    n = star.table(spark, d, "supplier").count()
    return history.bus_factor(authors(spark, d), n)


def coupled(spark: SparkSession, d: str) -> DataFrame:
    return history.logical_coupling(star.changes(spark, d), SUPPORT, CONFIDENCE, LARGEST)


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    return history.file_dependencies(*star.file_facts(spark, d))


PART_COUPLED = 2
DEPS_SQL = """
ends AS (SELECT l_orderkey AS id, min((l_linenumber, l_partkey, l_returnflag)) AS a, max((l_linenumber, l_partkey, l_returnflag)) AS z FROM lineitem GROUP BY 1),
facts AS (SELECT a[2] AS file, a[3] AS flag, lag(z[2]) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, id) AS src FROM ends JOIN orders ON o_orderkey = id),
deps AS (SELECT src AS "from", file AS "to", count(*)::BIGINT AS count FROM facts WHERE flag = 'N' AND src <> file GROUP BY 1, 2)"""
PARTS_SQL = f"""
part_changes AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS path FROM lineitem),
part_revs AS (SELECT path, count(*) AS n FROM part_changes GROUP BY 1),
few AS (SELECT * FROM part_changes WHERE commit IN (SELECT commit FROM part_changes GROUP BY 1 HAVING count(*) <= {LARGEST})),
together AS (SELECT s.path AS a, t.path AS b, count(*)::BIGINT AS support FROM few s JOIN few t ON s.commit = t.commit AND s.path < t.path GROUP BY 1, 2),
coupled AS (SELECT a, b, support, round(support / greatest(least(x.n, y.n), 1), 6) AS confidence FROM together JOIN part_revs x ON x.path = a JOIN part_revs y ON y.path = b
  WHERE support >= {PART_COUPLED} AND support / greatest(least(x.n, y.n), 1) >= {CONFIDENCE})"""


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    return _dependencies(spark, d)


def hidden(spark: SparkSession, d: str) -> DataFrame:
    pairs = history.logical_coupling(star.part_changes(spark, d), PART_COUPLED, CONFIDENCE, LARGEST)
    return history.hidden_coupling(pairs, components.settle(_dependencies(spark, d)))


def dead(spark: SparkSession, d: str) -> DataFrame:
    every = history.logical_coupling(star.part_changes(spark, d), 1, 0.0, LARGEST)
    return history.dead_weight(_dependencies(spark, d), every)


def _part_components(spark: SparkSession, d: str):
    nodes = star.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    edges = components.settle(star.part_successors(spark, d))
    return edges, components.settle(components.strong_components(nodes, edges))


def part_components(spark: SparkSession, d: str) -> DataFrame:
    return _part_components(spark, d)[1]


def part_cycles(spark: SparkSession, d: str) -> DataFrame:
    return components.cycle_report(*_part_components(spark, d))


def part_layers(spark: SparkSession, d: str) -> DataFrame:
    edges, comp = _part_components(spark, d)
    return components.layers(comp.select(F.col("component").alias("id")).distinct(), components.condense(edges, comp))


def part_reaches(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one order of which the first leads to the second by successors."""
    edges, comp = _part_components(spark, d)
    li = star.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    pairs = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).select("a", "b").distinct()
    return components.reaches(comp.select("id"), edges, pairs, comp)


SUCCESSOR_SQL = """
line AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
pair AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM line),
succ AS (SELECT l_partkey AS "from", max((l_orderkey, l_linenumber, nxt))[3] AS "to" FROM pair WHERE nxt IS NOT NULL GROUP BY 1),
way(a, b) AS (SELECT "from", "to" FROM succ UNION SELECT w.a, s."to" FROM way w JOIN succ s ON s."from" = w.b),
both_ways AS (SELECT w.a, min(w.b) AS least FROM way w JOIN way v ON v.a = w.b AND v.b = w.a GROUP BY 1),
comp AS (SELECT p_partkey AS id, least(p_partkey, coalesce(least, p_partkey)) AS component FROM part LEFT JOIN both_ways ON a = p_partkey)"""


def running(spark: SparkSession, d: str) -> DataFrame:
    changes = star.changes(spark, d).withColumn("deleted", F.col("deleted") * 9)
    return history.running_size(changes, star.commits(spark, d))


def path_join(spark: SparkSession, d: str) -> DataFrame:
    url = star.table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path")).distinct()
    return history.path_join(url.select(F.regexp_replace("path", "^[^/]*/", "").alias("path")).distinct(), url)


SNAP_SQL = """
snap AS (SELECT ts::DATE AS revision, user_id AS key, arg_max(event_type, (ts, event_id)) AS kind, count(*) AS loc FROM events GROUP BY 1, 2),
ord AS (SELECT revision, row_number() OVER (ORDER BY revision) AS ordinal FROM (SELECT DISTINCT revision FROM snap)),
v AS (SELECT * FROM snap JOIN ord USING (revision))"""


def _snap(spark: SparkSession, d: str):
    s = star.snapshots(spark, d)
    revisions = s.select(F.col("revision").alias("id"), F.unix_timestamp(F.col("revision").cast("timestamp")).alias("time")).distinct()
    return s, temporal.revision_order(revisions)


def revisions(spark: SparkSession, d: str) -> DataFrame:
    return _snap(spark, d)[1].select(F.col("revision").cast("string").alias("revision"), "ordinal")


def timeline(spark: SparkSession, d: str) -> DataFrame:
    return temporal.lifespans(*_snap(spark, d))


def entity_history(spark: SparkSession, d: str) -> DataFrame:
    return temporal.entity_history(*_snap(spark, d))


def heat(spark: SparkSession, d: str) -> DataFrame:
    return temporal.heat(*_snap(spark, d))


def edge_versions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.edge_versions(star.edges(spark, d)).groupBy("kind", "provenance").agg(F.count("*").alias("pairs"), F.max("count").alias("most"))


TECHNICAL = ["brand", "customer", "supplier", "part"]
BUSINESS = ["standard steel", "Customer order", "small brass", "region"]
TERMS_SQL = """
named AS (SELECT id AS entity, coalesce(parent, id) AS scope, CASE WHEN is_module THEN 'module' ELSE 'type' END AS role, name FROM entity WHERE name IS NOT NULL AND NOT coalesce(is_stub, FALSE)),
piece AS (SELECT entity, scope, unnest(regexp_extract_all(name, '[A-Z]?[a-z][a-z0-9]*|[A-Z]+[0-9]*|[0-9]+')) AS w FROM named),
tok AS (SELECT entity, scope, lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) AS term FROM piece WHERE NOT regexp_matches(w, '^[0-9]*[^A-Za-z0-9]*$')),
terms AS (SELECT scope, term, 8 * count(*)::BIGINT AS weight, count(*) AS occurrences, count(DISTINCT entity) AS carriers FROM tok GROUP BY 1, 2)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.tokens(star.names(spark, d))


def terms(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.scope_terms(_tokens(spark, d))


def spread(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.term_spread(terms(spark, d))


def totals(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.scope_totals(terms(spark, d), [], TECHNICAL)


def _business(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in BUSINESS], "business string")


def drift(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.drift(terms(spark, d), _business(spark))


def missing(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.missing_words(terms(spark, d), _business(spark))


INSIGHT_SQL = """
insight AS (SELECT doc_id AS id, source AS level, lang AS concept, quality * 0.5 + toxic * 0.25 AS confidence, d.text FROM documents d JOIN labels USING (doc_id)),
word AS (SELECT DISTINCT id, level AS module, lower(w) AS word, concept AS sense FROM (SELECT *, unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS w FROM insight))"""


def _insights(spark: SparkSession, d: str):
    docs = star.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("level"), F.col("lang").alias("concept"), "text")
    labels = star.table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 0.5 + F.col("toxic") * 0.25).alias("confidence"))
    made = docs.join(labels, "id")
    words = made.select("id", F.col("level").alias("module"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0)), F.lower))).alias("word"), F.col("concept").alias("sense"))
    return made.drop("text"), words


def insight_stats(spark: SparkSession, d: str) -> DataFrame:
    return insights.stats(*_insights(spark, d))


def insight_query(spark: SparkSession, d: str) -> DataFrame:
    return insights.query(_insights(spark, d)[0], concept="en", low=0.5)


def polysemy(spark: SparkSession, d: str) -> DataFrame:
    return insights.polysemy(_insights(spark, d)[1])


def word_report(spark: SparkSession, d: str) -> DataFrame:
    return _insights(spark, d)[1].groupBy("module").agg(F.countDistinct("word").alias("words"), F.count("*").alias("entries"))


def budget(spark: SparkSession, d: str) -> DataFrame:
    units = star.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("doc_id").alias("ord"), scalar.estimate_tokens(F.col("text")).alias("cost"))
    return insights.budget_plan(units, 20_000, "lang").groupBy("lang").agg(F.count_if("taken").alias("taken"), F.sum(F.when(F.col("taken"), F.col("cost"))).alias("spent"))


def json_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return star.table(spark, d, "events").groupBy("event_type").agg(F.sum(v).alias("total"), F.count(v).alias("measured"))


def scaled(spark: SparkSession, d: str) -> DataFrame:
    p = star.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    made = [scalar.round_half_up(scalar.scale_value(F.col("v"), F.lit(1.0), F.lit(40.0), (1.0, 10.0), k)).alias(k) for k in ("linear", "sqrt", "log1p")]
    return p.select("p_partkey", *made)


def name_pieces(spark: SparkSession, d: str) -> DataFrame:
    return star.table(spark, d, "customer").select("c_custkey", F.array_join(scalar.split_identifier(F.col("c_name")), ";").alias("words"))


QUERIES = {
    "history_summary": summary,
    "hotspots": hotspots,
    "file_owners": owners,
    "author_stats": authors,
    "bus_factor": bus_factor,
    "logical_coupling": coupled,
    "hidden_coupling": hidden,
    "dead_weight": dead,
    "file_dependencies": dependencies,
    "components_part": part_components,
    "cycles_part": part_cycles,
    "layers_part": part_layers,
    "reaches_part": part_reaches,
    "running_size": running,
    "path_join": path_join,
    "revisions": revisions,
    "timeline_user": timeline,
    "entity_history": entity_history,
    "heat": heat,
    "edge_versions": edge_versions,
    "vocabulary_terms": terms,
    "vocabulary_spread": spread,
    "vocabulary_totals": totals,
    "drift_terms": drift,
    "missing_words": missing,
    "insight_stats": insight_stats,
    "insight_query": insight_query,
    "polysemy": polysemy,
    "word_report": word_report,
    "budget_plan": budget,
    "json_values": json_values,
    "scaled_values": scaled,
    "name_pieces": name_pieces,
}

from .graph import EDGE_SQL, ENTITY_SQL  # noqa: E402

_H = "WITH" + HISTORY_SQL
_V = "WITH" + ENTITY_SQL + "," + TERMS_SQL
_OWN = ", own AS (SELECT path, arg_max(author, (added, -author)) AS author FROM by_author GROUP BY 1)"
_AUTHORS = """, a AS (SELECT c.author, c.n AS commits, coalesce(b.added, 0)::BIGINT AS added, coalesce(b.paths, 0)::BIGINT AS paths, coalesce(o.n, 0)::BIGINT AS owns
  FROM (SELECT author, count(*) AS n FROM commits GROUP BY 1) c LEFT JOIN (SELECT author, sum(added) AS added, count(*) AS paths FROM by_author GROUP BY 1) b USING (author)
  LEFT JOIN (SELECT author, count(*) AS n FROM own GROUP BY 1) o USING (author))"""
ORACLES = {
    "history_summary": _H + """ SELECT (SELECT count(*) FROM commits) AS commits, (SELECT count(DISTINCT author) FROM commits) AS authors, round(span, 6) AS span_days, (SELECT count(*) FILTER (is_fix) FROM commits) AS fixes,
      (SELECT count(*) FILTER (is_revert) FROM commits) AS reverts, CASE WHEN span <= 90 THEN 1.0 ELSE round((recent / 90) / (n / span), 6) END AS momentum, (SELECT count(DISTINCT path) FROM changes) AS paths, (SELECT sum(added + deleted)::BIGINT FROM changes) AS churn
      FROM (SELECT (max(time) - min(time)) / 86400 AS span, count(*) AS n, count(*) FILTER (time > (SELECT max(time) FROM commits) - 90 * 86400) AS recent FROM commits)""",
    "hotspots": _H + """ SELECT s_suppkey AS path, coalesce(revisions, 0)::BIGINT AS revisions, coalesce(added, 0)::BIGINT AS added, coalesce(deleted, 0)::BIGINT AS deleted, coalesce(fixes, 0)::BIGINT AS fixes, coalesce(authors, 0)::BIGINT AS authors,
      coalesce(added + deleted, 0)::BIGINT AS churn, CASE WHEN revisions IS NULL THEN 0.0 ELSE round(fixes / revisions, 6) END AS bug_density
      FROM supplier LEFT JOIN (SELECT path, count(*) AS revisions, sum(added) AS added, sum(deleted) AS deleted, count(*) FILTER (is_fix) AS fixes, count(DISTINCT author) AS authors FROM changes JOIN commits USING (commit) GROUP BY 1) ON path = s_suppkey""",
    "file_owners": _H + "," + BY_SQL + " SELECT path, arg_max(author, (added, -author)) AS owner, round(max(added) / sum(added), 6) AS share FROM by_author GROUP BY 1 HAVING max(added) > 0",
    "author_stats": _H + "," + BY_SQL + _OWN + _AUTHORS + " SELECT * FROM a",
    "bus_factor": _H + "," + BY_SQL + _OWN + _AUTHORS + """ SELECT count(*) AS bus_factor FROM (SELECT coalesce(sum(owns) OVER (ORDER BY owns DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a WHERE owns > 0) WHERE before * 2 <= (SELECT count(*) FROM supplier)""",
    "logical_coupling": _H + "," + COUPLED_SQL + " SELECT * FROM coupled",
    "hidden_coupling": "WITH RECURSIVE" + DEPS_SQL + "," + PARTS_SQL + """, starts AS (SELECT a AS s FROM coupled UNION SELECT b FROM coupled),
      r(a, b) AS (SELECT "from", "to" FROM deps WHERE "from" IN (SELECT s FROM starts) UNION SELECT r.a, deps."to" FROM r JOIN deps ON deps."from" = r.b)
      SELECT * FROM coupled c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = c.a AND r.b = c.b) AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = c.b AND r.b = c.a)""",
    "dead_weight": "WITH" + DEPS_SQL + "," + PARTS_SQL + """ SELECT DISTINCT least("from", "to") AS a, greatest("from", "to") AS b FROM deps WHERE (least("from", "to"), greatest("from", "to")) NOT IN (SELECT (a, b) FROM together)""",
    "file_dependencies": "WITH" + DEPS_SQL + " SELECT * FROM deps",
    "components_part": "WITH RECURSIVE" + SUCCESSOR_SQL + " SELECT id, component FROM comp",
    "cycles_part": "WITH RECURSIVE" + SUCCESSOR_SQL + """ SELECT component, count(*) AS size, array_to_string(list_sort(list(id)), ';') AS members,
      (SELECT count(*) FROM succ JOIN comp a ON a.id = "from" JOIN comp b ON b.id = "to" WHERE a.component = c.component AND b.component = c.component AND "from" <> "to") AS edges,
      (SELECT count(*) FROM succ JOIN comp a ON a.id = "from" JOIN comp b ON b.id = "to" WHERE a.component = c.component AND b.component = c.component) AS weight
      FROM comp c GROUP BY 1 HAVING count(*) >= 2""",
    "layers_part": "WITH RECURSIVE" + SUCCESSOR_SQL + """, cond AS (SELECT DISTINCT a.component AS f, b.component AS t FROM succ JOIN comp a ON a.id = "from" JOIN comp b ON b.id = "to" WHERE a.component <> b.component),
      h(id, n) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT f, n + 1 FROM h JOIN cond ON t = h.id) SELECT id, max(n)::INT AS layer FROM h GROUP BY 1""",
    "reaches_part": "WITH RECURSIVE" + SUCCESSOR_SQL + " SELECT DISTINCT a, b FROM (SELECT min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY l_orderkey) JOIN way USING (a, b)",
    "running_size": _H + """, s AS (SELECT path, time, commit, sum(added - 9 * deleted) OVER (PARTITION BY path ORDER BY time, commit) AS s FROM changes JOIN commits USING (commit))
      SELECT path, time, commit, (s - least(min(s) OVER (PARTITION BY path ORDER BY time, commit), 0))::BIGINT AS size FROM s""",
    "path_join": r"""WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages), m AS (SELECT DISTINCT regexp_replace(path, '^[^/]*/', '') AS path FROM h),
      p AS (SELECT m.path AS model_path, h.path AS history_path FROM m JOIN h ON m.path = h.path OR suffix(h.path, '/' || m.path) OR suffix(m.path, '/' || h.path))
      SELECT * FROM p WHERE model_path IN (SELECT model_path FROM p GROUP BY 1 HAVING count(*) = 1) AND history_path IN (SELECT history_path FROM p GROUP BY 1 HAVING count(*) = 1)""",
    "revisions": "WITH" + SNAP_SQL + " SELECT revision::VARCHAR AS revision, ordinal::INT AS ordinal FROM ord",
    "timeline_user": "WITH" + SNAP_SQL + " SELECT key, min(ordinal)::INT AS appeared, max(ordinal)::INT AS last_seen, count(*) AS versions, arg_max(kind, ordinal) AS kind, max(ordinal) = (SELECT max(ordinal) FROM ord) AS in_latest FROM v GROUP BY 1",
    "entity_history": "WITH" + SNAP_SQL + " SELECT key, arg_max(kind, ordinal) AS kind, string_agg(ordinal || '=' || loc, ';' ORDER BY ordinal) AS series FROM v GROUP BY 1",
    "heat": "WITH" + SNAP_SQL + """, w AS (SELECT key, ordinal, loc, lag(ordinal) OVER p AS po, lag(loc) OVER p AS pl FROM v WINDOW p AS (PARTITION BY key ORDER BY ordinal)),
      c AS (SELECT *, max(CASE WHEN po IS NULL OR pl <> loc THEN ordinal END) OVER (PARTITION BY key ORDER BY ordinal) AS mark FROM w)
      SELECT key, ordinal::INT AS ordinal, coalesce(ordinal - po > 1, FALSE) AS reborn, round(pow(0.6, ordinal - mark), 6) AS heat FROM c""",
    "edge_versions": "WITH" + EDGE_SQL + " SELECT kind, provenance, count(*) AS pairs, max(n) AS most FROM (SELECT src, dst, edge AS kind, provenance, count(*) AS n FROM edge GROUP BY ALL) GROUP BY 1, 2",
    "vocabulary_terms": _V + " SELECT * FROM terms",
    "vocabulary_spread": _V + " SELECT term, count(*) AS scopes, sum(weight)::BIGINT AS weight, CASE WHEN count(*) = 1 THEN min(scope) END AS exclusive FROM terms GROUP BY 1",
    "vocabulary_totals": _V + f" SELECT scope, count(*) AS distinct_terms, count(*) FILTER (length(term) > 1 AND term NOT IN ({', '.join(repr(t) for t in TECHNICAL)})) AS distinct_domain, sum(weight)::BIGINT AS weight, sum(occurrences)::BIGINT AS occurrences FROM terms GROUP BY 1",
    "drift_terms": _V + f""", b AS (SELECT DISTINCT business, unnest(string_split(lower(business), ' ')) AS term FROM (VALUES {', '.join(f"('{b}')" for b in BUSINESS)}) t(business)),
      n AS (SELECT business, count(*) AS words FROM b GROUP BY 1), f AS (SELECT business, scope, count(*) AS said FROM b JOIN terms USING (term) GROUP BY 1, 2)
      SELECT business, words, (SELECT count(*) FROM f WHERE f.business = n.business AND said = words) AS scopes FROM n""",
    "missing_words": _V + f" SELECT DISTINCT term FROM (SELECT unnest(string_split(lower(business), ' ')) AS term FROM (VALUES {', '.join(f"('{b}')" for b in BUSINESS)}) t(business)) WHERE term NOT IN (SELECT term FROM terms)",
    "insight_stats": "WITH" + INSIGHT_SQL + " SELECT level, concept, count(*) AS insights, round(avg(confidence), 6) AS confidence, count(*) FILTER (id NOT IN (SELECT id FROM word)) AS without_words FROM insight GROUP BY 1, 2",
    "insight_query": "WITH" + INSIGHT_SQL + " SELECT id, level, concept, confidence FROM insight WHERE concept = 'en' AND confidence >= 0.5",
    "polysemy": "WITH" + INSIGHT_SQL + " SELECT word, count(DISTINCT module) AS modules, count(DISTINCT sense) AS senses FROM word GROUP BY 1 HAVING count(DISTINCT sense) > 1",
    "word_report": "WITH" + INSIGHT_SQL + " SELECT module, count(DISTINCT word) AS words, count(*) AS entries FROM word GROUP BY 1",
    "budget_plan": """WITH u AS (SELECT lang, ceil(length(text) / 4)::BIGINT AS cost, sum(ceil(length(text) / 4)) OVER (PARTITION BY lang ORDER BY doc_id) AS spent FROM documents)
      SELECT lang, count(*) FILTER (spent <= 20000) AS taken, (sum(cost) FILTER (spent <= 20000))::BIGINT AS spent FROM u GROUP BY 1""",
    "json_values": "SELECT event_type, sum((props::JSON ->> '$.k')::INT)::BIGINT AS total, count((props::JSON ->> '$.k')::INT) AS measured FROM events GROUP BY 1",
    "scaled_values": """SELECT p_partkey, floor((1 + greatest(least((p_size - 1) / 39.0::DOUBLE, 1), 0) * 9) * 1000 + 0.5) / 1000 AS linear, floor((1 + greatest(least(sqrt(p_size - 1) / sqrt(39), 1), 0) * 9) * 1000 + 0.5) / 1000 AS sqrt,
      floor((1 + greatest(least(ln(1 + p_size - 1) / ln(40), 1), 0) * 9) * 1000 + 0.5) / 1000 AS log1p FROM part""",
    "name_pieces": "SELECT c_custkey, array_to_string(list_transform(list_filter(regexp_extract_all(c_name, '[A-Za-z]+'), lambda x: TRUE), lambda x: lower(x)), ';') AS words FROM customer",
}
