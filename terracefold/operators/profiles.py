"""Language profiles as data: which traits kinds require and which edges a language licenses; validation of a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import EDGE_KINDS, TRAITS

#: Kinds and licensed edge kinds by language.
KINDS = {
    "clojure": ["namespace", "var", "function", "protocol", "record", "multimethod", "defmethod", "implBlock", "parameter", "localBinding"],
    "csharp": ["namespace", "class", "interface", "struct", "enum", "record", "delegate", "method", "constructor", "property", "field", "event", "parameter", "localVariable", "lambda"],
    "elixir": ["file", "module", "protocol", "function", "macro", "callback", "field", "attribute", "parameter"],
    "go": ["package", "struct", "interface", "func", "method", "field", "parameter", "localVariable", "typeAlias", "const"],
    "java": ["package", "class", "interface", "enum", "record", "annotation", "method", "constructor", "lambda", "attribute", "parameter", "localVariable"],
    "javascript": ["module", "class", "function", "method", "arrowFunction", "variable", "parameter", "property"],
    "php": ["codeFile", "namespace", "class", "interface", "trait", "enum", "function", "method", "property", "constant", "parameter", "closure"],
    "python": ["module", "class", "function", "method", "attribute", "variable", "parameter", "lambda", "decorator"],
    "ruby": ["file", "class", "module", "method", "field", "constant", "parameter"],
    "rust": ["crate", "module", "struct", "enum", "trait", "impl", "function", "method", "field", "parameter", "localVariable", "typeAlias", "const"],
    "typescript": ["module", "namespace", "class", "abstractClass", "interface", "typeAlias", "enum", "function", "method", "constructor", "arrowFunction", "variable", "parameter", "property"],
}
EDGES = {
    "clojure": ["import", "interfaceImplementation", "invocation", "access", "reference"],
    "csharp": ["import", "inheritance", "interfaceImplementation", "invocation", "access", "reference", "annotationUse", "throws"],
    "elixir": ["import", "interfaceImplementation", "invocation", "access", "reference", "throws"],
    "go": ["import", "interfaceImplementation", "invocation", "access", "reference", "embedding"],
    "java": ["import", "inheritance", "interfaceImplementation", "invocation", "access", "reference", "annotationUse", "throws"],
    "javascript": ["import", "inheritance", "invocation", "access", "reference"],
    "php": ["import", "inheritance", "interfaceImplementation", "invocation", "access", "reference", "traitUsage", "fileInclude"],
    "python": ["import", "inheritance", "interfaceImplementation", "invocation", "access", "reference"],
    "ruby": ["import", "inheritance", "traitUsage", "invocation", "access", "reference", "throws"],
    "rust": ["import", "interfaceImplementation", "invocation", "access", "reference"],
    "typescript": ["import", "inheritance", "interfaceImplementation", "invocation", "access", "reference", "annotationUse", "throws"],
}


def profile(lang: str) -> dict | None:
    """Kinds and edge kinds of a language; None where it is unknown, which is no error."""
    return {"lang": lang, "kinds": KINDS[lang], "edges": EDGES[lang]} if lang in KINDS else None


def profile_table(spark: SparkSession) -> DataFrame:
    """(lang, kind) of all profiles: a small reference table to join with."""
    return spark.createDataFrame([(lang, k) for lang, ks in KINDS.items() for k in ks], "lang string, kind string")


def edge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lang, e) for lang in KINDS for e in EDGES[lang]], "lang string, edge string")


def issues(required: dict[str, list[str]], edges: list[str]) -> list[str]:
    """What is wrong with a profile's own data."""
    out = [f"{k}: unknown trait {t}" for k, ts in sorted(required.items()) for t in ts if t not in TRAITS]
    return out + [f"unknown edge kind {e}" for e in edges if e not in EDGE_KINDS]


def unlicensed(edges: DataFrame) -> DataFrame:
    """(lang, edge, n): edges (lang, edge) that the language's profile does not license; languages without a profile pass."""
    spark = edges.sparkSession
    known = profile_table(spark).select("lang").distinct()
    packed = edges.groupBy("lang", "edge").count().withColumnRenamed("count", "n")
    return packed.join(known, "lang", "left_semi").join(edge_table(spark), ["lang", "edge"], "left_anti")
