"""Insight records: statistics, word and polysemy reports, merges, plans under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_records(base: DataFrame, journal: DataFrame) -> DataFrame:
    """Records by id; those of the journal win, later ones (by seq) over earlier ones."""
    both = base.withColumn("_from", F.lit(0)).unionByName(journal.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*[c for c in both.columns if c != "_from"])
    return both.groupBy("id").agg(F.max_by(row, F.struct("_from", "seq")).alias("r")).select("r.*")


def query(insights: DataFrame, level: str | None = None, concept: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    out = insights
    for wanted, test in ((level, lambda: F.col("level") == level), (concept, lambda: F.col("concept") == concept), (low, lambda: F.col("confidence") >= low), (high, lambda: F.col("confidence") <= high)):
        out = out if wanted is None else out.filter(test())
    return out


def stats(insights: DataFrame, words: DataFrame) -> DataFrame:
    """Per level and concept: insights, mean confidence, and how many have no words."""
    worded = words.select("id").distinct().withColumn("worded", F.lit(True))
    return (
        insights.join(worded, "id", "left")
        .groupBy("level", "concept")
        .agg(F.count("*").alias("insights"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if(F.col("worded").isNull()).alias("without_words"))
    )


def polysemy(words: DataFrame) -> DataFrame:
    """(word, modules, senses): words with several normalised senses."""
    sense = F.lower(F.regexp_replace(F.trim("sense"), r"\s+", " "))
    return words.groupBy("word").agg(F.countDistinct("module").alias("modules"), F.countDistinct(sense).alias("senses")).filter("senses > 1")


def concerns(words: DataFrame) -> DataFrame:
    return words.groupBy("module").agg(F.countDistinct("word").alias("words"), F.count_if(F.col("concern") == "domain").alias("domain"))


def budget_plan(units: DataFrame, budget: int, group: str) -> DataFrame:
    """units (group, ord, cost) with taken: in order while the sum fits; after the first that does not, none is."""
    w = Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("spent", F.sum("cost").over(w)).withColumn("taken", F.col("spent") <= budget)


def fingerprint(*columns: str):
    """sha256 of the canonical JSON of columns, keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
