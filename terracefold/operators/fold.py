"""Containment: nearest containers, folding edges to a level, neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import settle
from ..schema import EDGE_KINDS, PROVENANCES
from .views import View, identity_view, kept_entities

LEVELS = {"type": "TType", "module": "TModule"}
#: Words beyond a closed vocabulary that still become bits.
ODD_WORDS = 48


def first_declarations(entities: DataFrame) -> DataFrame:
    """The first declaration of each id by (model_index, ref)."""
    row = F.struct(*entities.columns)
    return entities.groupBy("id").agg(F.min_by(row, F.struct("model_index", "ref")).alias("e")).select("e.*")


def places(entities: DataFrame, level: str) -> DataFrame:
    """(id, container) of every entity: the nearest entity, itself or an ancestor, with the level's trait, or null.

    Pointers to the parent double their reach each round, so rounds grow with the logarithm of the nesting; chains that
    run in a circle never settle on a container; rounds end once the reach exceeds the number of entities. Only entities
    that still look for a container are joined.
    """
    trait = LEVELS[level]
    node = entities.select("id", "parent", F.array_contains("traits", trait).alias("hit"))
    jump = node.select("id", F.when(F.col("hit"), F.col("id")).alias("container"), F.when(~F.col("hit"), F.col("parent")).alias("next"))
    looks = F.col("container").isNull() & F.col("next").isNotNull()
    nodes, reach = None, 1
    while True:
        jump = settle(jump)
        nodes = jump.count() if nodes is None else nodes
        if reach > nodes or jump.filter(looks).isEmpty():
            return jump.select("id", "container")
        reach *= 2
        hop = jump.select(F.col("id").alias("n"), F.col("container").alias("c2"), F.col("next").alias("n2"))
        met = jump.filter(looks).join(hop, F.col("next") == F.col("n"), "left").select("id", F.col("c2").alias("container"), F.when(F.col("c2").isNull(), F.col("n2")).alias("next"))
        jump = jump.filter(~looks).union(met)


def containers(entities: DataFrame, level: str) -> DataFrame:
    """places() of the entities that have a container."""
    return places(entities, level).filter("container IS NOT NULL")


@dataclass
class Folded:
    """nodes (id, entities), edges (from, to, count, kinds, provenances, self_loop) and one row of diagnostics."""

    level: str
    view: View
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame


def coded(edges: DataFrame, column: str, known: list[str]):
    """(code, words): a column's words as small numbers, their places in words. Words beyond the vocabulary are looked up once; a
    column of many more is no vocabulary and stays as it is (words: None)."""
    odd = edges.filter(~F.col(column).isin(known)).select(column).distinct().limit(ODD_WORDS + 1).collect()
    if len(odd) > ODD_WORDS:
        return F.col(column), None
    words = sorted({*known, *(r[0] for r in odd)})
    return (F.array_position(F.array(*map(F.lit, words)), F.col(column)) - 1).cast("int").alias(column), words


def _listed(edges: DataFrame, column: str, known: list[str]):
    """(code, aggregate, spelling) of the distinct words of a column, in order and joined by ';': numbers in the rows and bits of a
    sum, or sets of words where there are too many."""
    code, words = coded(edges, column, known)
    if words is None:
        return code, F.array_join(F.sort_array(F.collect_set(column)), ";").alias(column), lambda c: F.col(c)
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column))).alias(column)
    return code, mask, lambda c: F.concat_ws(";", *[F.when(F.col(c).bitwiseAND(1 << i) != 0, F.lit(w)) for i, w in enumerate(words)])


def fold(entities: DataFrame, edges: DataFrame, level: str, view: View | None = None, kinds: list[str] | None = None, drop_self_loops: bool = False) -> Folded:
    """Edges summed between the containers of their ends; lists come out joined by ';' in order.

    A kept entity whose container the view excludes is unfoldable; an edge is dropped when an end of it is.
    """
    view = view or identity_view()
    ends = places(entities, level)
    if view.entity is not None:
        ids = settle(kept_entities(entities, view).select(F.col("id").alias("k")))
        here = ends.join(ids, F.col("id") == F.col("k"), "left_semi")
        ends = settle(here.join(ids, F.col("container") == F.col("k"), "left").select("id", F.col("k").alias("container")))
    inside = ends.filter("container IS NOT NULL")
    e = edges if kinds is None else edges.filter(F.col("edge").isin(*kinds))
    e = e if view.edge is None else e.filter(view.edge())
    a = ends.select(F.col("id").alias("from"), F.col("container").alias("ca"))
    b = ends.select(F.col("id").alias("to"), F.col("container").alias("cb"))
    (edge_code, edge_mask, edge_words), (from_code, from_mask, from_words) = _listed(edges, "edge", EDGE_KINDS), _listed(edges, "provenance", PROVENANCES)
    # Edges are shuffled once by each end and once by their containers, as two names and two small numbers.
    both = e.select("from", "to", edge_code, from_code).join(a, "from").drop("from").join(b, "to").drop("to")
    ok = both.filter("ca IS NOT NULL AND cb IS NOT NULL")
    if drop_self_loops:
        ok = ok.filter("ca <> cb")
    sums = ok.groupBy(F.col("ca").alias("from"), F.col("cb").alias("to")).agg(F.count("*").alias("count"), edge_mask, from_mask)
    folded = sums.select("from", "to", "count", edge_words("edge").alias("kinds"), from_words("provenance").alias("provenances"), (F.col("from") == F.col("to")).alias("self_loop"))
    nodes = inside.groupBy(F.col("container").alias("id")).agg(F.count("*").alias("entities"))
    unplaced = ends.agg(F.count_if(F.col("container").isNull()).alias("unfoldable_entities"))
    counted = both.agg(
        F.count_if(F.col("ca").isNull() | F.col("cb").isNull()).alias("dropped_edges"),
        F.count_if((F.col("ca") != F.col("cb")) | F.lit(not drop_self_loops) & (F.col("ca") == F.col("cb"))).alias("folded_edges"),
    )
    one = lambda d: d.withColumn("_k", F.lit(1))  # noqa: E731  two one-row tables
    return Folded(level, view, nodes, folded, one(unplaced).join(one(counted), "_k").drop("_k"))


def dependencies_of(folded_edges: DataFrame, node: str) -> DataFrame:
    return folded_edges.filter((F.col("from") == node) & (F.col("to") != node)).select(F.col("to").alias("id")).distinct()


def dependents_of(folded_edges: DataFrame, node: str) -> DataFrame:
    return folded_edges.filter((F.col("to") == node) & (F.col("from") != node)).select(F.col("from").alias("id")).distinct()


def inverse(edges: DataFrame, kind: str) -> DataFrame:
    """(id, by): distinct sources that reach id by this kind (callers, accessors, subtypes, implementers, importers)."""
    return edges.filter(F.col("edge") == kind).select(F.col("to").alias("id"), F.col("from").alias("by")).distinct()


def children(entities: DataFrame) -> DataFrame:
    return entities.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.countDistinct("id").alias("children"))
