"""Measures of history and of code spans, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import measures, spans
from ..plans.fixpoint import settle
from ..sources import star
from .evolution import HISTORY_SQL

LONG, RECENT, LARGEST = 900, 200, 8


def history_measures(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as files, seen from the last order on."""
    commits = star.commits(spark, d)
    as_of = commits.agg(F.max("time")).first()[0] or 0
    return measures.file_measures(commits, star.changes(spark, d), as_of, LONG, RECENT, LARGEST)


def measured_paths(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, and half as many again that no history knows, against the measures: rows by side."""
    paths = star.table(spark, d, "supplier").select(F.explode(F.array("s_suppkey", F.lit(1_000_000) + F.col("s_suppkey"))).alias("path"))
    joined, odd = measures.join_measures(paths, history_measures(spark, d))
    return joined.select("path", F.lit("both").alias("side")).unionByName(odd).groupBy("side").agg(F.count("*").alias("paths"), F.min("path").alias("first"))


def document_spans(spark: SparkSession, d: str):
    """Paragraphs of documents as entities, that begin with the blank lines before them; each of their lines begins a space that
    ends with the paragraph, and the whole text is a unit: (spaces, entities, lines)."""
    texts = star.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.split("text", "\n").alias("t"))
    lines = settle(texts.select("file", F.size("t").alias("n"), F.posexplode("t").alias("k", "text")).select("file", "n", (F.col("k") + 1).alias("line"), "text"))
    run = Window.partitionBy("file").orderBy("line")
    full = F.btrim("text") != ""
    marked = lines.withColumn("full", full).withColumn("new", F.col("full") & ~F.coalesce(F.lag("full").over(run), F.lit(False)))
    marked = marked.withColumn("p", F.sum(F.col("new").cast("int")).over(run)).filter("full")
    per = marked.groupBy("file", "p").agg(F.min("line").alias("first"), F.max("line").alias("end"))
    per = per.withColumn("start", F.coalesce(F.lag("end").over(Window.partitionBy("file").orderBy("p")) + 1, F.lit(1)))
    name = lambda line: F.concat_ws(":", "file", line.cast("string"))
    inner = marked.join(per.select("file", "p", "first", "end"), ["file", "p"])
    kind = F.when(F.col("text").endswith("."), "class").otherwise("function")
    parent = F.when(F.col("line") > F.col("first"), name(F.col("line") - 1)).otherwise(F.concat("file", F.lit(":unit")))
    spaces = inner.select("file", name(F.col("line")).alias("space"), parent.alias("parent"), (F.col("line") - F.col("first") + 1).alias("depth"), F.col("line").alias("start"), "end", kind.alias("kind"))
    units = lines.groupBy("file").agg(F.max("line").alias("end"))
    unit = lambda *c: units.select("file", F.concat("file", F.lit(":unit")).alias(c[0]), *c[1:])
    spaces = spaces.unionByName(unit("space", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(1).alias("start"), "end", F.lit("unit").alias("kind")))
    entities = per.select("file", F.concat_ws(":", "file", F.lit("p"), F.col("p").cast("string")).alias("id"), F.lit(1).alias("depth"), "start", "end", F.lit("invocable").alias("category"), F.lit(False).alias("implicit"))
    entities = entities.unionByName(unit("id", F.lit(0).alias("depth"), F.lit(1).alias("start"), "end", F.lit("unit").alias("category"), F.lit(False).alias("implicit")))
    return settle(spaces), settle(entities), lines.select("file", "line", "text")


def span_charges(spark: SparkSession, d: str) -> DataFrame:
    """Characters of lines charged to the paragraph, or the text, that the line's space belongs to, and how that was joined."""
    spaces, entities, lines = document_spans(spark, d)
    joined = settle(spans.spans(spaces, entities, lines))
    sized = lines.select(F.concat_ws(":", "file", F.col("line").cast("string")).alias("space"), F.lit("chars").alias("key"), F.length("text").alias("value"))
    return spans.charge(sized, spaces, joined).join(joined.select("id", "how").distinct(), "id").select("id", "how", "value")


QUERIES = {"history_measures": history_measures, "measured_paths": measured_paths, "span_charges": span_charges}

_MEASURES = "WITH" + HISTORY_SQL + f""",
now AS (SELECT max(time) AS t FROM commits),
c AS (SELECT commits.*, t, time > t - {RECENT} * 86400 AS recent FROM commits, now WHERE time > t - {LONG} * 86400),
r AS (SELECT x.commit, x.path, added + deleted AS churn, author, time, t, is_fix, is_revert, recent FROM changes x JOIN c USING (commit)),
sp AS (SELECT commit, count(*) AS files, CASE WHEN sum(churn) > 0 THEN greatest(log2(sum(churn)) - sum(CASE WHEN churn > 0 THEN churn * log2(churn) ELSE 0 END) / sum(churn), 0) ELSE 0 END AS h FROM r GROUP BY 1),
a AS (SELECT path, author, sum(churn) AS churn, bool_or(recent) AS recent FROM r GROUP BY 1, 2),
w AS (SELECT path, count(*) AS authors_long, count(*) FILTER (recent) AS authors_recent, round(max(churn) / sum(churn), 6) AS ownership_top_share FROM a GROUP BY 1),
f AS (SELECT r.* FROM r JOIN sp USING (commit) WHERE files BETWEEN 2 AND {LARGEST}),
p AS (SELECT x.path, y.path AS other, count(*) AS n, count(*) FILTER (x.recent) AS rn FROM f x JOIN f y ON x.commit = y.commit AND x.path <> y.path GROUP BY 1, 2),
co AS (SELECT path, round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 6) AS cl, CASE WHEN sum(rn) > 0 THEN round(greatest(log2(sum(rn)) - sum(CASE WHEN rn > 0 THEN rn * log2(rn) ELSE 0 END) / sum(rn), 0), 6) ELSE 0 END AS cr FROM p GROUP BY 1),
b AS (SELECT path, round((min(t) - min(time)) / 86400, 6) AS age_days, round((min(t) - max(time)) / 86400, 6) AS last_modified_days, count(*) AS commits_long, count(*) FILTER (recent) AS commits_recent,
  count(*) FILTER (is_fix) AS bug_fix_commits, count(*) FILTER (is_revert) AS revert_commits, sum(churn)::BIGINT AS churn_long, coalesce(sum(churn) FILTER (recent), 0)::BIGINT AS churn_recent,
  round(avg(h), 6) AS change_entropy_long, coalesce(round(avg(h) FILTER (recent), 6), 0) AS change_entropy_recent FROM r JOIN sp USING (commit) GROUP BY 1),
m AS (SELECT path, age_days, authors_long, authors_recent, bug_fix_commits, round(commits_recent / commits_long, 6) AS burst, change_entropy_long, change_entropy_recent, churn_long, churn_recent,
  coalesce(cl, 0) AS cochange_entropy_long, coalesce(cr, 0) AS cochange_entropy_recent, commits_long, commits_recent, last_modified_days, ownership_top_share, revert_commits FROM b JOIN w USING (path) LEFT JOIN co USING (path))"""
ORACLES = {
    "history_measures": _MEASURES + " SELECT * FROM m",
    "measured_paths": _MEASURES + """, q AS (SELECT s_suppkey AS path FROM supplier UNION ALL SELECT 1000000 + s_suppkey FROM supplier)
      SELECT CASE WHEN m.path IS NULL THEN 'model' WHEN q.path IS NULL THEN 'history' ELSE 'both' END AS side, count(*) AS paths, min(coalesce(q.path, m.path)) AS first FROM q FULL JOIN m USING (path) GROUP BY 1""",
    "span_charges": r"""
WITH l AS (SELECT doc_id, k AS line, t[k] AS text, trim(t[k], ' ') <> '' AS ok FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))),
g AS (SELECT *, sum(CASE WHEN ok AND NOT coalesce(was, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM (SELECT *, lag(ok) OVER (PARTITION BY doc_id ORDER BY line) AS was FROM l)),
s AS (SELECT doc_id, p, min(line) AS first, max(line) AS last, sum(length(text))::BIGINT AS value FROM g WHERE ok GROUP BY 1, 2),
e AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY p) + 1, 1) AS start FROM s)
SELECT doc_id || ':p:' || p AS id, CASE WHEN start = first THEN 'exact' ELSE 'leading' END AS how, value FROM e
""",
}
