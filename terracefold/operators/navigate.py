"""The navigator: a tree of the entities that a reader meets, numbered in preorder, and what depends on what along it.

Nodes are modules, types, operations and attributes (parameters and local variables are not). Types hang under types, else
modules; operations and attributes lie flat under their type, else module. A node's number is its place in preorder, with
siblings by category, name and id, so a subtree is an interval of numbers and roll-ups are joins of ranges. Numbers come from
subtree sizes by pointer doubling and prefix sums per parent (plans.forest): nothing is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import has_trait
from ..plans.fixpoint import kept_only, settle, settled_in_turn
from ..plans.forest import jumps, preorder
from ..schema import PROVENANCES
from .coupling import coupling
from .fold import coded

CATEGORIES = ["module", "type", "operation", "attribute"]


def categories(entities: DataFrame) -> DataFrame:
    """(id, category) of what becomes a node: by traits, modules before types before operations; structural entities are
    attributes where their parent is a type or module."""
    t = lambda name: has_trait(F.col("traits"), name)
    holds = entities.select(F.col("id").alias("p"), (t("TModule") | t("TType")).alias("holds"))
    own = F.when(t("TModule"), "module").when(t("TType"), "type").when(t("TInvocable"), "operation").when(t("TStructural") & F.col("holds"), "attribute")
    return entities.join(holds, F.col("parent") == F.col("p"), "left").select("id", own.alias("category")).filter("category IS NOT NULL")


def nearest(entities: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """(id, a column per mark): the nearest of an entity and its ancestors for which the mark holds, in doubling steps."""
    hit = [F.when(m, F.col("id")).alias(name) for name, m in marks.items()]
    now, reach, total = settle(entities.select("id", F.col("parent").alias("next"), *hit)), 1, None
    names = list(marks)
    while True:
        total = now.count() if total is None else total
        missing = F.lit(False)
        for n in names:
            missing = missing | F.col(n).isNull()
        if reach > total or now.filter(F.col("next").isNotNull() & missing).isEmpty():
            return now.select("id", *names)
        hop = now.select(F.col("id").alias("h"), F.col("next").alias("n2"), *[F.col(n).alias(f"{n}_2") for n in names])
        now = settle(now.join(hop, F.col("next") == F.col("h"), "left").select("id", F.col("n2").alias("next"), *[F.coalesce(n, f"{n}_2").alias(n) for n in names]))
        reach *= 2


def owners(entities: DataFrame, kinds: DataFrame) -> DataFrame:
    """(id, owner, member, type, module): the nearest type or module around an entity, itself included, and the first operation or
    attribute on the way there."""
    marked = settle(entities.select("id", "parent").join(kinds, "id", "left"))
    is_ = lambda *c: F.coalesce(F.col("category").isin(*c), F.lit(False))
    near = settle(nearest(marked, {"owner": is_("type", "module"), "member": is_("operation", "attribute"), "type": is_("type"), "module": is_("module")}))
    # A member counts where it lies below the owner: then both have the same owner.
    over = near.select(F.col("id").alias("mid"), F.col("owner").alias("m_owner"))
    met = near.join(over, F.col("member") == F.col("mid"), "left")
    member = F.when(F.col("m_owner") == F.col("owner"), F.col("member"))
    return met.select("id", "owner", member.alias("member"), "type", "module")


def _tree(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes but for their coupling, with numbers, and owners() of all entities."""
    kinds = settle(categories(entities))
    near = settle(owners(entities, kinds))
    up = near.select(F.col("id").alias("u"), F.col("type").alias("u_type"), F.col("module").alias("u_module"))
    own = entities.select("id", "parent", "kind", "name", F.coalesce("is_stub", F.lit(False)).alias("is_stub")).join(kinds, "id")
    own = own.join(up, F.col("parent") == F.col("u"), "left")
    above = F.when(F.col("category") == "module", F.col("u_module")).otherwise(F.coalesce("u_type", "u_module"))
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    placed = settle(own.select("id", above.alias("parent"), rank.alias("rank"), F.coalesce("name", "id").alias("label"), "kind", "category", "is_stub"))
    tree = settle(preorder(placed.select("id", "parent", "rank", "label"), ["rank", "label"]))
    numbers = tree.select(F.col("id").alias("pid"), F.col("pre").alias("parent_node"))
    counts = tree.groupBy(F.col("parent").alias("cid")).agg(F.count("*").alias("children"))
    rows = tree.drop("parent").join(placed, "id").join(numbers, F.col("parent") == F.col("pid"), "left").join(counts, F.col("id") == F.col("cid"), "left")
    return settle(rows.select(F.col("pre").alias("node"), "id", F.col("label").alias("name"), "kind", "category", "is_stub", F.col("parent_node").alias("parent"), "depth", "size", F.coalesce("children", F.lit(0)).cast("long").alias("children"))), near


def _built(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_tree(), without the tables of its rounds, of which there are some twenty."""
    return kept_only(entities.sparkSession, lambda: _tree(entities))


def _numbered(near: DataFrame, rows: DataFrame) -> DataFrame:
    """owners() with numbers of nodes: (id, owner o, member m, type, module). An entity's type and module are those of its owner."""
    number = lambda c: rows.select(F.col("id").alias(c), F.col("node").alias(f"{c}_node"))
    own = near.filter("id = owner").join(number("owner"), "owner").join(number("type"), "type", "left").join(number("module"), "module", "left")
    own = own.select("owner", F.col("owner_node").alias("o"), F.col("type_node").alias("type"), F.col("module_node").alias("module"))
    return near.select("id", "owner", "member").join(own, "owner", "left").join(number("member"), "member", "left").select("id", "o", F.col("member_node").alias("m"), "type", "module")


def _ends(edges: DataFrame, numbered: DataFrame, columns: list[str], how: str) -> DataFrame:
    """edges (from, to, ...) with these columns of both ends in place of their ids (from: a_, to: b_). Each end is a step of its own,
    so that one shuffle of the edges lies on the disk at a time."""

    def step(c: str, p: str):
        return lambda d: d.join(numbered.select(F.col("id").alias(c), *[F.col(x).alias(f"{p}_{x}") for x in columns]), c, how).drop(c)

    return settled_in_turn(edges, step("from", "a"), step("to", "b"))


def _resolved(edges: DataFrame, near: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """Edges with the numbers of what their ends lie in (owner o, member m, type, module; from: a, to: b), and the words of provenance.

    Each edge is shuffled once by either end, words as numbers.
    """
    provenance, words = coded(edges, "provenance", PROVENANCES)
    narrow = edges.select("from", "to", "edge", provenance, "is_read", "is_write")
    return _ends(narrow, settle(_numbered(near, rows)), ["o", "m", "type", "module"], "left"), words


def _coupled(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """rows with the coupling of each category's own level."""
    metrics = None
    for level in ("type", "module"):
        pairs = resolved.select(F.col(f"a_{level}").alias("from"), F.col(f"b_{level}").alias("to")).filter("`from` <> `to`")
        # Pairs of types are many: dealt by from, only their sums by to are shuffled again. Pairs of modules are few, and summed first.
        pairs = (pairs.repartition("from") if level == "type" else pairs).groupBy("from", "to").agg(F.count("*").alias("count"))
        m = coupling(rows.filter(F.col("category") == level).select(F.col("node").alias("id")), pairs, dealt=level == "type")
        m = m.select(F.col("id").alias("node"), "fan_in", "fan_out", "instability")
        metrics = m if metrics is None else metrics.unionByName(m)
    return rows.join(metrics, "node", "left").select(*rows.columns, "fan_in", "fan_out", "instability")


def nodes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, id, name, kind, category, is_stub, parent, depth, size, children, fan_in, fan_out, instability).

    node and parent are preorder numbers from 0; a subtree is node to node + size - 1. Coupling is that of the category's own
    level: types among types, modules among modules.
    """
    rows, near = _built(entities)
    levels = ["type", "module"]
    placed = settle(_numbered(near, rows).select("id", *levels).filter("type IS NOT NULL OR module IS NOT NULL"))
    return _coupled(rows, _ends(edges.select("from", "to"), placed, levels, "inner"))


def dependencies(entities: DataFrame, edges: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(role, from, to, member, to_member, provenance, n), and one row (self_deps, dropped_deps).

    Ends are node numbers of owners, members those of the operations and attributes that carry the edge; equal rows are
    counted. Edges inside one owner are self dependencies; those with an end outside every owner are dropped.
    """
    return _depending(*_resolved(edges, settle(owners(entities, categories(entities))), rows))


def navigator(entities: DataFrame, edges: DataFrame, coupled: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(), and the two frames of dependencies(), with the edges' ends looked up once; coupled=False leaves out what nodes are
    coupled by."""
    rows, near = _built(entities)
    resolved, words = _resolved(edges, near, rows)
    return _coupled(rows, resolved) if coupled else rows, *_depending(resolved, words)


def _roles() -> Column:
    """The roles of an edge: a row of dependencies() each."""
    return F.filter(F.array(F.when(F.col("is_read"), "reads"), F.when(F.col("is_write"), "writes"), F.when(F.col("edge") == "invocation", "calls"), F.when(~F.col("edge").isin("access", "invocation"), F.concat("edge", F.lit("s")))), lambda x: x.isNotNull())


def _depending(both: DataFrame, words: list[str] | None) -> tuple[DataFrame, DataFrame]:
    lost, inside = F.col("a_o").isNull() | F.col("b_o").isNull(), F.col("a_o") == F.col("b_o")
    diagnostics = both.agg(F.count_if(~lost & inside).alias("self_deps"), F.count_if(lost).alias("dropped_deps"))
    kept = both.filter(~lost & ~inside).select(F.explode(_roles()).alias("role"), F.col("a_o").alias("from"), F.col("b_o").alias("to"), F.col("a_m").alias("member"), F.col("b_m").alias("to_member"), "provenance")
    keys = ["role", "from", "to", "member", "to_member", "provenance"]
    counted = kept.groupBy(*keys).agg(F.count("*").alias("n"))
    spelled = F.col("provenance") if words is None else F.element_at(F.array(*map(F.lit, words)), F.col("provenance") + 1)
    return counted.withColumn("provenance", spelled), diagnostics


def subtree(deps: DataFrame, rows: DataFrame, ids: list[str]) -> DataFrame:
    """(id, inside, leaving, entering): dependencies that stay in, leave and enter the subtrees of the named nodes.

    deps: (from, to, n), whose rows are summed where they meet the subtrees; they need not be distinct.
    """
    spans = rows.filter(F.col("id").isin(ids)).select("id", F.col("node").alias("lo"), (F.col("node") + F.col("size") - 1).alias("hi"))
    a, b = F.col("from").between(F.col("lo"), F.col("hi")), F.col("to").between(F.col("lo"), F.col("hi"))
    met = deps.select("from", "to", "n").join(F.broadcast(spans), a | b, "inner")  # as many rows as ids were named
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return met.groupBy("id").agg(total(a & b).alias("inside"), total(a & ~b).alias("leaving"), total(b & ~a).alias("entering"))


def subtrees(entities: DataFrame, edges: DataFrame, ids: list[str]) -> DataFrame:
    """subtree() of the graph's dependencies: sums need neither members nor distinct rows, so edges carry only owners and counts."""
    rows, near = _built(entities)
    number = rows.select(F.col("id").alias("owner"), F.col("node").alias("o"))
    placed = settle(near.select("id", "owner").join(number, "owner").select("id", "o"))
    counted = edges.select("from", "to", F.size(_roles()).cast("long").alias("n")).filter("n > 0")
    both = _ends(counted, placed, ["o"], "inner").filter("a_o <> b_o")
    return subtree(both.select(F.col("a_o").alias("from"), F.col("b_o").alias("to"), "n"), rows, ids)


def display(rows: DataFrame, deps: DataFrame, cap: int, min_fan_in: int = 0, externals: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a type graph shows: (nodes, edges, one row of total_nodes and truncated).

    The cap nodes of most fan-in among those that a dependency touches, ties by name and number, and the pairs between them
    with their counts and whether all of a pair is declared.
    """
    ok = rows.filter("category = 'type'").filter(F.coalesce("fan_in", F.lit(0)) >= min_fan_in)
    ok = settle((ok if externals else ok.filter("NOT is_stub")).select("node", "name", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), "is_stub"))
    pairs = deps.groupBy("from", "to").agg(F.sum("n").alias("count"), F.bool_and(F.col("provenance") == "declared").alias("all_declared"))
    keep = ok.select(F.col("node").alias("k"))
    pairs = settle(pairs.join(keep, F.col("from") == F.col("k"), "left_semi").join(keep, F.col("to") == F.col("k"), "left_semi"))
    touched = pairs.select(F.explode(F.array("from", "to")).alias("node")).distinct()
    shown = ok.join(touched, "node").orderBy(F.desc("fan_in"), "name", "node").limit(cap)
    shown = settle(shown)
    few = F.broadcast(shown.select(F.col("node").alias("k")))  # cap rows
    edges = pairs.join(few, F.col("from") == F.col("k"), "left_semi").join(few, F.col("to") == F.col("k"), "left_semi")
    return shown, edges, touched.agg(F.count("*").alias("total_nodes"), (F.count("*") > cap).alias("truncated"))


def packages(modules: DataFrame) -> DataFrame:
    """The package tree of modules (id, name, is_stub) by the parts of their dotted names, chains without branch folded away.

    (path, kind, id, label, parent, children, all_stub): a row per place in the tree where a module ends or names branch. One
    module at a place is the row; none, or several, make a group, whose several modules come as rows under it. label is the
    path since the parent row; children counts rows below; all_stub says that all modules at or below are stubs.
    """
    parts = F.split("name", r"\.")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("path"), F.when(k > 1, F.array_join(F.slice(parts, 1, k - 1), ".")).alias("up"), (k == F.size(parts)).alias("ends")))
    exploded = modules.select("id", F.coalesce("is_stub", F.lit(False)).alias("is_stub"), F.explode(each).alias("x")).select("id", "is_stub", "x.*")
    # One grouping over all prefixes: what ends there, and whether all below are stubs.
    places = exploded.groupBy("path").agg(F.first("up").alias("up"), F.count_if("ends").alias("modules"), F.min(F.when(F.col("ends"), F.col("id"))).alias("id"), F.bool_and("is_stub").alias("all_stub"))
    kids = places.groupBy(F.col("up").alias("k")).agg(F.count("*").alias("kids"))
    places = places.join(kids, F.col("path") == F.col("k"), "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    places = settle(places.withColumn("folded", (F.col("modules") == 0) & (F.col("kids") == 1)).drop("k"))
    # The nearest place above that is a row: folded places hand on upwards, by doubling.
    way = jumps(places.select(F.col("path").alias("id"), F.when(F.col("folded"), F.col("up")).alias("next")), []).select(F.col("id").alias("w"), "root")
    rows = places.filter("NOT folded").select("path", "id", "modules", "all_stub", "up")
    known = rows.select(F.col("path").alias("parent"))
    above = rows.join(way, F.col("up") == F.col("w"), "left").join(known, F.col("root") == F.col("parent"), "left")
    label = F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.substring("path", F.length("parent") + 2, F.length("path")))
    above = settle(above.select("path", "id", "modules", "all_stub", "parent", label.alias("label")))
    one = above.select("path", F.when(F.col("modules") == 1, "module").otherwise("group").alias("kind"), F.when(F.col("modules") == 1, F.col("id")).alias("id"), "label", "parent", "all_stub")
    several = exploded.filter("ends").join(above.filter("modules > 1").select("path", "label"), "path").select("path", F.lit("module").alias("kind"), "id", "label", F.col("path").alias("parent"), F.col("is_stub").alias("all_stub"))
    every = one.unionByName(several)
    below = every.groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("children"))
    counted = every.join(below, F.col("path") == F.col("p"), "left")
    several_in = (F.col("kind") == "module") & F.col("parent").eqNullSafe(F.col("path"))
    return counted.select("path", "kind", "id", "label", "parent", F.when(several_in, F.lit(0)).otherwise(F.coalesce("children", F.lit(0))).cast("long").alias("children"), "all_stub")
