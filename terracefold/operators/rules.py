"""The conformance rules of a corpus, one finding per place: what is broken, where it is written, and which id is at fault.

Frames: entities (model_index, ref, id, lang, kind, traits, is_stub, anchor, and the reference columns of REFS that they have),
edges (model_index, ref, lang, edge, from, to, provenance, candidates, anchor); ref is the place in its model, anchor a struct of
file, start and end. Profiles are tables: kinds (lang, kind, required, allowed) and licences (lang, edge).

Closure holds over the whole corpus, stubs included. An empty list of candidates differs from none. Profile rules judge
distinct compositions, which are few, and join them back; a language without profile is a warning, once per model. Ids may
be declared again with the same kind and set of traits, in any order. All rules are one scan of each frame and joins on ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import settle
from ..schema import PROVENANCES

#: Columns that name one entity, and those that name several.
REFS, LISTS = {"parent": "parent", "attached_to": "attachedTo", "declared_type": "declaredType"}, {"parameters": "parameters", "local_variables": "localVariables", "defined_types": "definedTypes"}
#: code -> (rule, severity), in the order of reports.
CODES = {
    "dangling-reference": ("closure", "error"),
    "self-edge": ("self-reference", "error"),
    "invalid-provenance": ("provenance", "error"),
    "candidates-empty": ("candidates", "error"),
    "candidates-without-uncertainty": ("candidates", "error"),
    "candidates-missing": ("candidates", "warning"),
    "missing-anchor": ("anchor", "error"),
    "anchor-file-empty": ("anchor", "error"),
    "anchor-span-not-1-based": ("anchor", "error"),
    "anchor-span-reversed": ("anchor", "error"),
    "unknown-kind": ("profile", "error"),
    "missing-required-trait": ("profile", "error"),
    "trait-not-allowed": ("profile", "error"),
    "edge-not-licensed": ("profile", "error"),
    "unknown-profile": ("profile", "warning"),
    "duplicate-id-conflict": ("duplicate-id", "error"),
}
_PLACE = ["model_index", "section", "ref"]


def _found(df: DataFrame, faults: list[tuple[str, Column, Column, Column]], section: str) -> DataFrame:
    """A row for each fault (code, when, path, id) that a row of df has."""
    each = [F.when(when, F.struct(F.lit(code).alias("code"), path.alias("path"), i.cast("string").alias("id"))) for code, when, path, i in faults]
    hit = df.select("model_index", F.lit(section).alias("section"), "ref", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    return hit.select(*_PLACE, "x.code", "x.path", "x.id")


def _anchors(path: Column, owner: Column, needed: Column) -> list[tuple[str, Column, Column, Column]]:
    a = F.col("anchor")
    there = needed & a.isNotNull()
    at = F.concat(path, F.lit(".anchor"))
    return [
        ("missing-anchor", needed & a.isNull(), path, owner),
        ("anchor-file-empty", there & (F.coalesce(a["file"], F.lit("")) == ""), at, owner),
        ("anchor-span-not-1-based", there & (F.coalesce(a["start"], F.lit(0)) < 1), at, owner),
        ("anchor-span-reversed", there & (a["end"] < a["start"]), at, owner),
    ]


def references(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(model_index, section, ref, path, id): every place that names an entity."""

    def named(df: DataFrame, section: str, one: dict[str, str], many: dict[str, str]) -> DataFrame:
        root = F.concat(F.lit(f"{section}["), F.col("ref").cast("string"), F.lit("]."))
        single = [F.array(F.struct(F.concat(root, F.lit(n)).alias("path"), F.col(f"`{c}`").alias("id"))) for c, n in one.items() if c in df.columns]
        each = lambda n: lambda x, i: F.struct(F.concat(root, F.lit(f"{n}["), i.cast("string"), F.lit("]")).alias("path"), x.alias("id"))
        lists = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), each(n)) for c, n in many.items() if c in df.columns]
        return df.select("model_index", F.lit(section).alias("section"), "ref", F.explode(F.concat(*single, *lists)).alias("x")).select(*_PLACE, "x.path", "x.id").filter("id IS NOT NULL")

    return named(entities, "entities", REFS, LISTS).unionByName(named(edges, "edges", {"from": "from", "to": "to"}, {"candidates": "candidates"}))


def findings(entities: DataFrame, edges: DataFrame, kinds: DataFrame, licences: DataFrame) -> DataFrame:
    """(model_index, section, ref, code, path, id, rule, severity)."""
    known = entities.select("id").distinct()
    lost = references(entities, edges).join(known, "id", "left_anti").withColumn("code", F.lit("dangling-reference"))
    path = F.concat(F.lit("edges["), F.col("ref").cast("string"), F.lit("]"))
    dynamic, given, source = F.col("provenance").eqNullSafe("dynamic-candidate"), F.col("candidates").isNotNull(), F.col("from")
    none = F.size("candidates") == 0
    of_edges = [
        ("self-edge", F.col("from") == F.col("to"), path, source),
        ("invalid-provenance", F.col("provenance").isNull() | ~F.col("provenance").isin(PROVENANCES), F.concat(path, F.lit(".provenance")), source),
        ("candidates-empty", given & none, F.concat(path, F.lit(".candidates")), source),
        ("candidates-without-uncertainty", given & ~none & ~dynamic, F.concat(path, F.lit(".candidates")), source),
        ("candidates-missing", dynamic & ~given, path, source),
        *_anchors(path, source, F.lit(True)),
    ]
    here = F.concat(F.lit("entities["), F.col("ref").cast("string"), F.lit("]"))
    of_entities = _anchors(here, F.col("id"), F.array_contains("traits", "TSourceAnchor"))
    profile = _profile(entities, edges, kinds, licences, here, path)
    shape = F.struct("kind", F.sort_array(F.array_distinct("traits")))
    place = F.struct("model_index", "ref")
    twice = entities.groupBy("id").agg(F.countDistinct(shape).alias("shapes"), F.min(place).alias("p")).filter("shapes > 1")
    twice = twice.select("p.model_index", F.lit("entities").alias("section"), "p.ref", F.lit("duplicate-id-conflict").alias("code"), F.concat(F.lit("entities["), F.col("p.ref").cast("string"), F.lit("]")).alias("path"), "id")
    every = reduce(DataFrame.unionByName, [lost.select(*_PLACE, "code", "path", "id"), _found(edges, of_edges, "edges"), _found(entities, of_entities, "entities"), profile, twice])
    rule, severity = (F.element_at(F.create_map(*[F.lit(x) for code, told in CODES.items() for x in (code, told[k])]), F.col("code")) for k in (0, 1))
    return every.withColumn("rule", rule).withColumn("severity", severity)


def _profile(entities: DataFrame, edges: DataFrame, kinds: DataFrame, licences: DataFrame, here: Column, path: Column) -> DataFrame:
    langs = kinds.select("lang").distinct()
    traits = F.sort_array(F.array_distinct("traits"))
    shaped = entities.select("model_index", "ref", "id", "lang", "kind", traits.alias("traits"), F.coalesce("is_stub", F.lit(False)).alias("stub"))
    shapes = settle(shaped.select("lang", "kind", "traits", "stub").distinct())
    judged = shapes.join(langs, "lang", "left_semi").join(kinds.select("lang", "kind", "required", "allowed"), ["lang", "kind"], "left")
    lacking, extra = F.array_except("required", "traits"), F.array_except("traits", F.array_union("required", "allowed"))
    codes = F.filter(F.array(F.when(F.col("required").isNull(), "unknown-kind"), F.when(~F.col("stub") & (F.size(lacking) > 0), "missing-required-trait"), F.when(F.size(extra) > 0, "trait-not-allowed")), lambda x: x.isNotNull())
    wrong = judged.select("lang", "kind", "traits", "stub", codes.alias("codes")).filter("size(codes) > 0")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("lang", "kind", "traits", "stub")]
    of_entities = shaped.alias("l").join(wrong.alias("r"), reduce(lambda a, b: a & b, on)).select("l.model_index", F.lit("entities").alias("section"), "l.ref", F.explode("r.codes").alias("code"), here.alias("path"), "l.id")
    bad = edges.select("lang", "edge").distinct().join(langs, "lang", "left_semi").join(licences, ["lang", "edge"], "left_anti")
    of_edges = edges.join(bad, ["lang", "edge"], "left_semi").select("model_index", F.lit("edges").alias("section"), "ref", F.lit("edge-not-licensed").alias("code"), path.alias("path"), F.col("from").alias("id"))
    models = entities.select("model_index", "lang").distinct().join(langs, "lang", "left_anti")
    unknown = models.select("model_index", F.lit("lang").alias("section"), F.lit(0).cast("long").alias("ref"), F.lit("unknown-profile").alias("code"), F.lit("lang").alias("path"), F.lit(None).cast("string").alias("id"))
    return of_entities.unionByName(of_edges).unionByName(unknown)


def counts(found: DataFrame) -> DataFrame:
    """(code, rule, severity, findings): true totals."""
    return found.groupBy("code", "rule", "severity").agg(F.count("*").alias("findings"))


def capped(found: DataFrame, max_per_rule: int) -> DataFrame:
    """The first max_per_rule findings of each rule by place, and how many of the rule are suppressed.

    The cap is the report's; its window has a group limit, so a rule that all edges break sends max_per_rule rows a task.
    """
    order = [*_PLACE, "path", "code", "id"]
    kept = found.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy(*order))).filter(F.col("place") <= max_per_rule)
    total = found.groupBy("rule").agg(F.greatest(F.count("*") - max_per_rule, F.lit(0)).alias("suppressed"))
    return kept.join(total, "rule")


def is_clean(found: DataFrame) -> bool:
    return found.filter("severity = 'error'").isEmpty()
