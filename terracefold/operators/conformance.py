"""Conformance findings: each rule is a frame (rule, severity, subject, detail); all together are one union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_KINDS, PROVENANCES


def _finding(df: DataFrame, rule: str, severity: str, subject, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


def dangling(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """References to ids that no entity has: parents and both ends of edges."""
    refs = entities.filter("parent IS NOT NULL").select(F.col("parent").alias("id"), F.lit("parent").alias("how")).unionByName(
        edges.select(F.explode(F.array(F.struct(F.col("from").alias("id"), F.lit("from").alias("how")), F.struct(F.col("to").alias("id"), F.lit("to").alias("how")))).alias("x")).select("x.*")
    )
    # Distinct references first: hubs with many edges count once before the join.
    missing = refs.groupBy("id", "how").agg(F.count("*").alias("n")).join(entities.select("id").distinct(), "id", "left_anti")
    return _finding(missing, "closure", "error", F.col("id"), F.concat_ws(":", "how", F.col("n").cast("string")))


def self_edges(edges: DataFrame) -> DataFrame:
    hit = edges.filter(F.col("from") == F.col("to")).groupBy(F.col("from").alias("id"), "edge").agg(F.count("*").alias("n"))
    return _finding(hit, "self-edge", "error", F.col("id"), F.concat_ws(":", "edge", F.col("n").cast("string")))


def invalid_provenance(edges: DataFrame) -> DataFrame:
    hit = edges.groupBy("provenance").agg(F.count("*").alias("n")).filter(F.col("provenance").isNull() | ~F.col("provenance").isin(PROVENANCES))
    return _finding(hit, "provenance", "error", F.coalesce("provenance", F.lit("null")), F.col("n"))


def unknown_edge_kinds(edges: DataFrame, licensed: list[str] | None = None) -> DataFrame:
    hit = edges.groupBy("edge").agg(F.count("*").alias("n")).filter(F.col("edge").isNull() | ~F.col("edge").isin(licensed or EDGE_KINDS))
    return _finding(hit, "edge-kind", "error", F.coalesce("edge", F.lit("null")), F.col("n"))


def bad_anchors(edges: DataFrame) -> DataFrame:
    why = F.when(F.col("start").isNull(), "missing").when(F.col("start") < 1, "not-1-based").when(F.col("end") < F.col("start"), "reversed")
    hit = edges.withColumn("why", why).filter("why IS NOT NULL").groupBy("edge", "why").agg(F.count("*").alias("n"))
    return _finding(hit, "anchor", "error", F.col("why"), F.concat_ws(":", "edge", F.col("n").cast("string")))


def duplicate_ids(entities: DataFrame) -> DataFrame:
    """Ids declared more than once; conflicting where kind or trait set differ."""
    shape = F.struct("kind", F.sort_array(F.array_distinct("traits")))
    hit = entities.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct(shape).alias("shapes")).filter("n > 1")
    return _finding(hit, "duplicate-id", "error", F.col("id"), F.concat_ws(":", F.when(F.col("shapes") > 1, "conflict").otherwise("repeat"), F.col("n").cast("string")))


def composition(entities: DataFrame, required: dict[str, list[str]], allowed: dict[str, list[str]]) -> DataFrame:
    """Kinds and trait sets against a profile, judged on distinct compositions; stubs may lack required traits."""
    distinct = entities.groupBy("kind", F.sort_array(F.array_distinct("traits")).alias("traits"), F.coalesce("is_stub", F.lit(False)).alias("stub")).agg(F.count("*").alias("n"))
    spark = entities.sparkSession
    rows = [(k, required.get(k, []), sorted({*required.get(k, []), *allowed.get(k, [])})) for k in sorted({*required, *allowed})]
    profile = spark.createDataFrame(rows, "k string, required array<string>, allowed array<string>")
    j = distinct.join(profile, F.col("kind") == F.col("k"), "left")
    lacking, extra = F.array_except("required", "traits"), F.array_except("traits", "allowed")
    found = F.filter(
        F.array(
            F.when(F.col("k").isNull(), F.struct(F.lit("unknown-kind").alias("r"), F.lit("").alias("t"))),
            F.when(~F.col("stub") & (F.size(lacking) > 0), F.struct(F.lit("missing-required-trait").alias("r"), F.array_join(lacking, ";").alias("t"))),
            F.when(F.size(extra) > 0, F.struct(F.lit("trait-not-allowed").alias("r"), F.array_join(extra, ";").alias("t"))),
        ),
        lambda x: x.isNotNull(),
    )
    hit = j.select("kind", "n", F.explode(found).alias("f"))
    return hit.select(F.col("f.r").alias("rule"), F.lit("error").alias("severity"), F.col("kind").alias("subject"), F.concat_ws(":", F.col("f.t"), F.col("n").cast("string")).alias("detail"))


def check(entities: DataFrame, edges: DataFrame) -> DataFrame:
    rules = [dangling(entities, edges), self_edges(edges), invalid_provenance(edges), unknown_edge_kinds(edges), bad_anchors(edges), duplicate_ids(entities)]
    return reduce(lambda a, b: a.unionByName(b), rules)


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule", "severity").agg(F.count("*").alias("findings"))


def is_clean(findings: DataFrame) -> bool:
    return findings.filter("severity = 'error'").isEmpty()
