"""Views: a predicate on entities, one on edges, and the names of the filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """entity and edge are None where they keep everything, so that no join is planned for them."""

    filters: tuple[str, ...] = ()
    entity: Callable[[], Column] | None = None
    edge: Callable[[], Column] | None = None
    label: str = field(default="", compare=False)


def identity_view() -> View:
    return View()


def make_view(name: str, entity: Callable[[], Column] | None = None, edge: Callable[[], Column] | None = None) -> View:
    return View((name,), entity, edge)


def internal_only() -> View:
    return View(("internal-only",), lambda: ~F.coalesce(F.col("is_stub"), F.lit(False)))


def provenance_only(*kinds: str) -> View:
    return View(("provenance:" + ",".join(sorted(kinds)),), None, lambda: F.col("provenance").isin(*kinds))


def declared_only() -> View:
    return View(("declared-only",), None, lambda: F.col("provenance") == "declared")


def compose_views(*views: View) -> View:
    """The conjunction; filters once each, in order."""

    def both(parts):
        parts = [p for p in parts if p is not None]
        if not parts:
            return None

        def made() -> Column:
            c = parts[0]()
            for p in parts[1:]:
                c = c & p()
            return c

        return made

    names = tuple(dict.fromkeys(n for v in views for n in v.filters))
    return View(names, both(v.entity for v in views), both(v.edge for v in views))


def kept_entities(entities: DataFrame, view: View) -> DataFrame:
    return entities if view.entity is None else entities.filter(view.entity())


def kept_edges(edges: DataFrame, entities: DataFrame, view: View) -> DataFrame:
    """Edges that pass, with both ends present and kept."""
    out = edges if view.edge is None else edges.filter(view.edge())
    ids = kept_entities(entities, view).select("id")
    return out.join(ids, out["from"] == ids["id"], "left_semi").join(ids, out["to"] == ids["id"], "left_semi")


def project_view(entities: DataFrame, edges: DataFrame, view: View) -> tuple[DataFrame, DataFrame]:
    return kept_entities(entities, view), kept_edges(edges, entities, view)
