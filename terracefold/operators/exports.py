"""Text exports of folded graphs, coupling and cycles: CSV, JSON, DOT, PlantUML; lines are columns until they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import csv_field, dot_text, u16
from ..plans.fixpoint import settle
from ..plans.order import positions


def csv_lines(df: DataFrame, columns: list[str], order: list[str], delimiter: str = ",") -> DataFrame:
    """(n, line) with the header as line 0, in canonical order; numbers come from sorted ranges, not from one task."""
    keys = [u16(F.col(f"`{c}`").cast("string")).alias(f"k{i}") for i, c in enumerate(order)]
    lines = df.select(*keys, F.concat_ws(delimiter, *[csv_field(F.col(f"`{c}`"), delimiter) for c in columns]).alias("line"))
    body = positions(lines, [f"k{i}" for i in range(len(order))], "n").select("n", "line")
    head = df.sparkSession.createDataFrame([(0, delimiter.join(columns))], "n long, line string")
    return head.union(body)


def folded_csv(edges: DataFrame) -> DataFrame:
    return csv_lines(edges, ["from", "to", "count", "kinds", "provenances"], ["from", "to"])


def coupling_csv(table: DataFrame) -> DataFrame:
    return csv_lines(table, ["id", "fan_in", "fan_out", "instability", "in_edges", "out_edges"], ["id"])


def cycles_csv(report: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows scc:n of each member, and selfLoop rows."""
    numbered = positions(report.select("members", u16(F.col("members")).alias("k")), ["k"], "n")
    members = numbered.select(F.concat(F.lit("scc:"), (F.col("n") - 1).cast("string")).alias("group"), F.explode(F.split("members", ";")).alias("id"))
    loops = edges.filter(F.col("from") == F.col("to")).select(F.lit("selfLoop").alias("group"), F.col("from").cast("string").alias("id"))
    return csv_lines(members.union(loops), ["group", "id"], ["group", "id"])


def folded_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, line): one JSON object per node and edge, keys in order."""
    a = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("entities", "id")).alias("line"))
    return a.union(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("count", "from", "kinds", "provenances", "to")).alias("line")))


def pen_width(count):
    """Fixed steps: 1, 2, 5 and 17 dependencies."""
    return F.when(count >= 17, 4).when(count >= 5, 3).when(count >= 2, 2).otherwise(1)


def dot_lines(nodes: DataFrame, edges: DataFrame, name: str = "graph") -> DataFrame:
    """(part, line) of a DOT graph; ordered by part, then line."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, f'digraph "{name}" {{'), (3, "}")], "part int, line string")
    a = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), dot_text(F.col("id")), F.lit(";")).alias("line"))
    b = edges.select(F.lit(2).alias("part"), F.format_string('  %s -> %s [label="%d", penwidth=%d];', dot_text(F.col("from")), dot_text(F.col("to")), F.col("count"), pen_width(F.col("count"))).alias("line"))
    return ends.union(a).union(b)


def plantuml_lines(nodes: DataFrame, edges: DataFrame, element: str = "class") -> DataFrame:
    """(part, line) of a PlantUML diagram; aliases number the nodes in canonical order."""
    numbered = positions(nodes.select("id", u16(F.col("id")).alias("k")), ["k"], "n")
    alias = settle(numbered.select("id", F.concat(F.lit("n"), F.col("n").cast("string")).alias("alias")))
    label = F.replace(F.col("id"), F.lit('"'), F.lit("'"))
    ends = nodes.sparkSession.createDataFrame([(0, "@startuml"), (3, "@enduml")], "part int, line string")
    a = alias.select(F.lit(1).alias("part"), F.concat(F.lit(element + ' "'), label, F.lit('" as '), "alias").alias("line"))
    f, t = alias.select(F.col("id").alias("from"), F.col("alias").alias("fa")), alias.select(F.col("id").alias("to"), F.col("alias").alias("ta"))
    b = edges.join(f, "from").join(t, "to").select(F.lit(2).alias("part"), F.concat("fa", F.lit(" --> "), "ta", F.lit(" : "), F.col("count").cast("string")).alias("line"))
    return ends.union(a).union(b)
