"""Framework wiring: injection points, their candidates and the edges derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roles(annotation_uses: DataFrame, profile: DataFrame) -> DataFrame:
    """(entity, role) from annotation uses (entity, module, name, value) and a profile (module, name, role)."""
    return annotation_uses.join(profile, ["module", "name"]).select("entity", "role", "value")


def bean_name(simple: Column) -> Column:
    """The stated name, else the type's with a small first letter."""
    return F.concat(F.lower(F.substring(simple, 1, 1)), F.substring(simple, F.lit(2), F.length(simple)))


def derive(points: DataFrame, implements: DataFrame, components: DataFrame) -> DataFrame:
    """(point, target, candidates, provenance): where injection points (point, type, qualifier) lead.

    Candidates are components of the point's type or that implement it (from, to). A qualifier, else a primary component,
    narrows several to one: that is derived; what stays ambiguous is a dynamic candidate.
    """
    subtypes = implements.select(F.col("to").alias("type"), F.col("from").alias("target")).union(components.select(F.col("id").alias("type"), F.col("id").alias("target")))
    named = components.select(F.col("id").alias("target"), "name", F.coalesce("is_primary", F.lit(False)).alias("is_primary"))
    all_ = points.join(subtypes, "type").join(named, "target").distinct()
    matches = F.col("qualifier").isNull() | (F.col("qualifier") == F.col("name"))
    kept = all_.filter(matches)
    by = kept.groupBy("point").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("p"))
    out = kept.join(by, "point").filter((F.col("n") == 1) | (F.col("p") != 1) | F.col("is_primary"))
    one = (F.col("n") == 1) | (F.col("p") == 1)
    return out.select("point", "target", F.when(one, F.lit(1)).otherwise(F.col("n")).cast("long").alias("candidates"), F.when(one, "derived").otherwise("dynamic-candidate").alias("provenance"))
