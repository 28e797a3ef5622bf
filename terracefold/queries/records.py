"""Checks of model files that the events table is written as, with oracle SQL over the events themselves.

Each user's events are a model file: the event types but the last as kinds, a file per type of the user, an entity per
event whose module is the event's k, and an edge from the event to k. So kinds, modules, ends, files and counts are often wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import records, star


def event_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, line, value): a model file per user."""
    events = star.table(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("to"))
    types = events.agg(F.array_sort(F.collect_set("event_type")).alias("types"))  # one row, a closed vocabulary
    own = Window.partitionBy("user_id")
    numbered = events.withColumn("n", F.row_number().over(own.orderBy("event_id")).cast("long") - 1)
    per = events.groupBy("user_id").agg(F.count("*").alias("c"), F.count_if(F.col("value") >= 5).alias("said"), F.array_sort(F.collect_set("event_type")).alias("files"))
    rows = numbered.join(per, "user_id").crossJoin(F.broadcast(types))  # one row
    path, n, c, at = F.col("user_id").cast("string").alias("path"), F.col("n"), F.col("c"), F.size("files").cast("long") + 1
    number = F.array_position("types", F.col("event_type")) - 1
    e = F.struct(F.lit("e").alias("t"), n.alias("i"), number.alias("k"), F.array(F.lit(0)).alias("tr"), F.col("to").alias("m"), F.col("event_id").cast("string").alias("s"))
    x = F.struct(F.lit("x").alias("t"), F.lit(0).alias("k"), n.alias("f"), F.col("to").alias("o"), (F.col("value") > 40).cast("int").alias("p"), F.array(number, F.lit(1), F.lit(2)).alias("anchor"))
    body = rows.select(path, F.explode(F.array(F.struct((at + n + 1).alias("line"), F.to_json(e).alias("value")), F.struct((at + c + n + 1).alias("line"), F.to_json(x).alias("value")))).alias("l")).select("path", "l.*")
    whole = per.crossJoin(F.broadcast(types))  # one row
    words = F.struct(F.slice("types", 1, F.size("types") - 1).alias("kinds"), F.array(F.lit("TNamed")).alias("traits"), F.array(F.lit("reference")).alias("edges"), F.array(F.lit("declared")).alias("provenance"))
    head = F.struct(F.lit(1).cast("long").alias("line"), F.to_json(F.struct(F.lit("header").alias("t"), F.lit("1.0.0").alias("schemaVersion"), words.alias("dict"))).alias("value"))
    files = F.transform("files", lambda f, i: F.struct((i + 2).cast("long").alias("line"), F.to_json(F.struct(F.lit("f").alias("t"), i.alias("i"), f.alias("path"))).alias("value")))
    counts = F.struct(F.size("files").alias("files"), c.alias("entities"), F.col("said").alias("edges"))
    end = F.struct((at + 2 * c + 1).alias("line"), F.to_json(F.struct(F.lit("eof").alias("t"), counts.alias("counts"))).alias("value"))
    frame = whole.select(path, F.explode(F.concat(F.array(head), files, F.array(end))).alias("l")).select("path", "l.*")
    return frame.unionByName(body)


def record_findings(spark: SparkSession, d: str) -> DataFrame:
    return records.check(event_files(spark, d))


QUERIES = {"record_findings": record_findings}

ORACLES = {
    "record_findings": """
WITH t AS (SELECT list_sort(list(DISTINCT event_type)) AS types FROM events),
ev AS (SELECT user_id, value, (props::JSON ->> '$.k')::BIGINT AS k, list_position(types, event_type) - 1 AS tp, len(types) AS nt,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events, t),
fs AS (SELECT user_id, count(DISTINCT tp) AS f, count(*) AS total, count(*) FILTER (value >= 5) AS said FROM ev GROUP BY 1),
r AS (SELECT ev.*, f, 1 + f + n + 1 AS le, 1 + f + c + n + 1 AS lx FROM ev JOIN fs USING (user_id))
SELECT user_id::VARCHAR AS path, le AS line, 'vocabulary' AS rule, 'kind:' || tp AS detail FROM r WHERE tp >= nt - 1
UNION ALL SELECT user_id::VARCHAR, lx, 'vocabulary', 'provenance:1' FROM r WHERE value > 40
UNION ALL SELECT user_id::VARCHAR, le, 'module-later', k::VARCHAR FROM r WHERE k > n
UNION ALL SELECT user_id::VARCHAR, le, 'no-entity', 'm:' || k FROM r WHERE k >= c
UNION ALL SELECT user_id::VARCHAR, lx, 'no-entity', 'to:' || k FROM r WHERE k >= c
UNION ALL SELECT user_id::VARCHAR, lx, 'no-file', 'anchor:' || tp FROM r WHERE tp >= f
UNION ALL SELECT user_id::VARCHAR, 0, 'end-counts', 'edges:' || said || '<>' || total FROM fs WHERE said <> total
""",
}
