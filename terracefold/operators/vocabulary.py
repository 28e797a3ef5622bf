"""Vocabularies of names: weighted terms per scope, classes, spread, drift against business terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import split_identifier

#: Weights of the roles that names have.
WEIGHTS = {"module": 8, "type": 8, "attribute": 4, "operation": 3, "parameter": 1, "local": 1, "qualifier": 1}


def tokens(names: DataFrame) -> DataFrame:
    """(entity, scope, role, term, weight) of (entity, scope, role, name)."""
    weight = F.coalesce(*[F.when(F.col("role") == r, w) for r, w in WEIGHTS.items()], F.lit(1))
    return names.select("entity", "scope", "role", F.explode(split_identifier(F.col("name"))).alias("term"), weight.alias("weight"))


def term_class(term: Column, keywords: list[str], technical: list[str]) -> Column:
    """keyword, short (one letter at most), technical or domain, in this order."""
    return (
        F.when(term.isin(keywords) if keywords else F.lit(False), "keyword")
        .when(F.length(term) <= 1, "short")
        .when(term.isin(technical) if technical else F.lit(False), "technical")
        .otherwise("domain")
    )


def scope_terms(toks: DataFrame) -> DataFrame:
    """(scope, term, weight, occurrences, carriers); an entity carries a term once."""
    return toks.groupBy("scope", "term").agg(
        F.sum("weight").cast("long").alias("weight"), F.count("*").alias("occurrences"), F.countDistinct("entity").alias("carriers")
    )


def term_spread(terms: DataFrame) -> DataFrame:
    """(term, scopes, weight, exclusive): in how many scopes a term is spoken, and the scope if it is one."""
    return terms.groupBy("term").agg(
        F.count("*").alias("scopes"), F.sum("weight").alias("weight"), F.when(F.count("*") == 1, F.min("scope")).alias("exclusive")
    )


def scope_totals(terms: DataFrame, keywords: list[str], technical: list[str]) -> DataFrame:
    """(scope, distinct_terms, distinct_domain, weight, occurrences)."""
    domain = term_class(F.col("term"), keywords, technical) == "domain"
    return terms.groupBy("scope").agg(
        F.count("*").alias("distinct_terms"), F.count_if(domain).alias("distinct_domain"), F.sum("weight").alias("weight"), F.sum("occurrences").alias("occurrences")
    )


def drift(terms: DataFrame, business: DataFrame) -> DataFrame:
    """(business, words, scopes): for each business term in how many scopes all of its words are spoken."""
    words = business.select("business", F.explode(F.array_distinct(split_identifier(F.col("business")))).alias("term"))
    n = words.groupBy("business").agg(F.count("*").alias("words"))
    said = words.join(terms.select("scope", "term"), "term").groupBy("business", "scope").agg(F.countDistinct("term").alias("said"))
    full = said.join(n, "business").filter("said = words").groupBy("business").agg(F.count("*").alias("scopes"))
    return n.join(full, "business", "left").select("business", "words", F.coalesce("scopes", F.lit(0)).cast("long").alias("scopes"))


def missing_words(terms: DataFrame, business: DataFrame) -> DataFrame:
    """Words of business terms that no name speaks."""
    words = business.select(F.explode(split_identifier(F.col("business"))).alias("term")).distinct()
    return words.join(terms.select("term").distinct(), "term", "left_anti")


def carriers(toks: DataFrame, scope: str, term: str, limit: int = 200) -> DataFrame:
    """(entity, weight): who speaks a term in a scope, heaviest first; the limit is the report's."""
    found = toks.filter((F.col("scope") == scope) & (F.col("term") == term)).groupBy("entity").agg(F.sum("weight").cast("long").alias("weight"))
    return found.orderBy(F.col("weight").desc(), "entity").limit(limit)
