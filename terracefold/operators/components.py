"""Graph algorithms on (from, to, count) edges: reachability, strong components, condensation, layers, feedback arcs."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import checksum, settle, until_stable
from ..plans.forest import jumps, preorder


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id): what each start reaches by one or more edges; only the newest rows are joined in each round.

    The result is starts x reached; to ask for pairs use reaches().
    """
    e = settle(edges.select(F.col("from").alias("a"), F.col("to").alias("b")).distinct())
    rounds = [settle(starts.select(F.col("id").alias("start")).join(e, F.col("start") == F.col("a")).select("start", F.col("b").alias("id")).distinct())]
    while not rounds[-1].isEmpty():
        step = rounds[-1].join(e, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct()
        # Each round is written once; what was seen is the union of the rounds.
        rounds.append(settle(step.join(reduce(DataFrame.union, rounds), ["start", "id"], "left_anti")))
    return reduce(DataFrame.union, rounds)


def reaches(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of which a reaches b by one or more edges, without listing what else a reaches.

    Components become one node. A spanning forest takes one incoming edge of each, numbered in preorder: a subtree is an
    interval, so a pair inside one is decided by two comparisons. From there on only edges beside the forest count: a round
    joins the intervals that an open pair's start has newly entered to the beside-edges that leave them (by buckets of
    numbers), and a pair closes when its end lies in one.
    Rounds are as many as beside-edges on a way, not as nodes: a path of any length is one interval, and so is a tree whose
    edges lead to or from its root.
    """
    comp = settle(components if components is not None else strong_components(nodes, edges))
    cyclic = comp.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    loops = edges.filter("`from` = `to`").select(F.col("from").alias("id")).distinct().join(comp, "id").select("component")
    cyclic = settle(cyclic.union(loops).distinct())
    named = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    asked = settle(pairs.select("a", "b").distinct().join(named("a"), "a").join(named("b"), "b"))
    same = asked.filter("ca = cb").join(cyclic, F.col("ca") == F.col("component"), "left_semi").select("a", "b")
    dag = settle(condense(edges, comp))
    # Where more nodes have an edge out than in, the graph turned round leaves fewer edges beside the forest.
    heads, tails = dag.agg(F.countDistinct("to"), F.countDistinct("from")).first()
    if tails > heads:
        dag = dag.select(F.col("to").alias("from"), F.col("from").alias("to"))
        asked = asked.select("a", "b", F.col("cb").alias("ca"), F.col("ca").alias("cb"))
    units = comp.select(F.col("component").alias("id")).distinct()
    forest = units.join(dag.groupBy(F.col("to").alias("id")).agg(F.min("from").alias("parent")), "id", "left")
    place = settle(preorder(forest, ["id"]).select("id", "parent", "pre", (F.col("pre") + F.col("size") - 1).alias("last")))
    at = lambda c, *more: place.select(F.col("id").alias(c), F.col("pre").alias(f"{c}_pre"), *[F.col(m).alias(f"{c}_{m}") for m in more])
    beside = dag.join(at("from"), "from").join(at("to", "last", "parent"), "to").filter("NOT (to_parent <=> `from`)").select(F.col("from_pre").alias("x"), F.col("to_pre").alias("y"), F.col("to_last").alias("y_last"))
    total = place.count()
    width = max(1, int(total**0.5))
    beside = settle(beside.withColumn("bucket", F.floor(F.col("x") / width)))
    open_ = asked.filter("ca <> cb").select("ca", "cb").distinct().join(at("ca", "last"), "ca").join(at("cb"), "cb")
    open_ = settle(open_.select("ca", "cb", F.col("ca_pre").alias("s"), F.col("ca_last").alias("s_last"), F.col("cb_pre").alias("t")))
    hit = [settle(open_.filter("t BETWEEN s AND s_last").select("ca", "cb"))]
    left = settle(open_.join(hit[0], ["ca", "cb"], "left_anti"))
    # Intervals entered by each start: (s, lo, hi). A start's own subtree first.
    entered = [settle(left.select("s", F.col("s").alias("lo"), F.col("s_last").alias("hi")).distinct())]
    while not entered[-1].isEmpty():
        spread = entered[-1].withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
        new = spread.join(beside, "bucket").filter("x BETWEEN lo AND hi").select("s", F.col("y").alias("lo"), F.col("y_last").alias("hi")).distinct()
        new = settle(new.join(reduce(DataFrame.union, entered).select("s", "lo"), ["s", "lo"], "left_anti"))
        found = settle(left.join(new, "s").filter("t BETWEEN lo AND hi").select("ca", "cb").distinct())
        hit.append(found)
        left = settle(left.join(found, ["ca", "cb"], "left_anti"))
        entered.append(settle(new.join(left.select("s").distinct(), "s", "left_semi")))
    found = reduce(DataFrame.union, hit).distinct()
    return same.union(asked.join(found, ["ca", "cb"], "left_semi").select("a", "b")).distinct()


def _spread(labels: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Minimum label along edges within one colour, one step."""
    moved = edges.join(labels.select(F.col("id").alias(src), "colour", "label"), src).select(F.col(dst).alias("id"), F.col("colour").alias("c2"), F.col("label").alias("l2"))
    best = moved.groupBy("id", "c2").agg(F.min("l2").alias("l2"))
    out = labels.join(best, (labels["id"] == best["id"]) & labels["colour"].eqNullSafe(best["c2"]), "left")
    return out.select(labels["id"], "colour", F.least("label", F.coalesce("l2", "label")).alias("label"))


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ways through nodes with one edge in and one out become single edges: (edges, members, ways, rings).

    members (id, way) are the nodes on ways, ways (way, from, to) what a way connects, rings (id, next) the nodes of circles
    that nothing else touches. A way is named by its last inner node.
    """
    out = edges.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("o"), F.min("to").alias("after"))
    into = edges.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("i"), F.min("from").alias("before"))
    inner = settle(out.join(into, "id").filter("o = 1 AND i = 1").select("id", "before", "after"))
    mark = inner.select(F.col("id").alias("k"))
    linked = settle(inner.join(mark, F.col("after") == F.col("k"), "left").select("id", "before", "after", F.col("k").alias("next")))
    members = settle(jumps(linked.select("id", "next"), []).select("id", F.col("root").alias("way")))
    rings = settle(linked.join(members, "id", "left_anti").select("id", "next"))
    first = linked.join(mark, F.col("before") == F.col("k"), "left_anti").join(members, "id").select("way", F.col("before").alias("from"))
    last = linked.filter("next IS NULL").select(F.col("id").alias("way"), F.col("after").alias("to"))
    ways = settle(first.join(last, "way"))
    plain = edges.join(mark, F.col("from") == F.col("k"), "left_anti").join(mark, F.col("to") == F.col("k"), "left_anti")
    return settle(plain.union(ways.select("from", "to")).filter("`from` <> `to`").distinct()), members, ways, rings


def _ring_least(rings: DataFrame) -> DataFrame:
    """(id, component) of nodes whose pointers (id, next) run in circles: the least id of each, by doubling."""
    now, before = settle(rings.select("id", "next", F.col("id").alias("least"))), None
    while True:
        hop = now.select(F.col("id").alias("h"), F.col("next").alias("n2"), F.col("least").alias("l2"))
        now = settle(now.join(hop, F.col("next") == F.col("h")).select("id", F.col("n2").alias("next"), F.least("least", "l2").alias("least")))
        mark = now.agg(F.sum(F.xxhash64("id", "least").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            return now.select("id", F.col("least").alias("component"))
        before = mark


def _colour(left: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One forward-backward colouring: (id, component) of the components it settles, and the edges inside colours."""
    start = left.select("id", F.lit(0).alias("colour"), F.col("id").alias("label"))
    forward = until_stable(start, lambda d: _spread(d, e, "from", "to"), checksum)
    coloured = forward.select("id", F.col("label").alias("root"))
    ends = lambda c, r: coloured.select(F.col("id").alias(c), F.col("root").alias(r))
    inside = settle(e.join(ends("from", "r1"), "from").join(ends("to", "r2"), "to").filter("r1 = r2").select("from", "to"))
    back = coloured.select("id", F.lit(0).alias("colour"), F.when(F.col("id") == F.col("root"), 0).otherwise(1).alias("label"))
    reach = until_stable(back, lambda d: _spread(d, inside, "to", "from"), checksum).filter("label = 0")
    return settle(coloured.join(reach.select("id"), "id", "left_semi").select("id", F.col("root").alias("component"))), inside


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is its smallest id.

    First what needs no search goes, again and again: nodes without an edge in or out are components of their own, and ways
    through nodes with one edge in and one out become single edges (a closed way is a component). Both halve long paths and
    trees. What is left is coloured: nodes take the least id that reaches them, and those that reach back to it inside
    the colour are its component and leave. Nodes of a way join the component that has both its ends, if one has.
    """
    every = settle(nodes.select("id").distinct())
    e = settle(edges.select("from", "to").filter("`from` <> `to`").distinct())
    settled, contracted = [], []
    while True:
        before = e.count()
        if not before:
            break
        for _ in range(3):
            tails, heads = e.select(F.col("from").alias("k")).distinct(), e.select(F.col("to").alias("k")).distinct()
            e = settle(e.join(heads, F.col("from") == F.col("k"), "left_semi").join(tails, F.col("to") == F.col("k"), "left_semi"))
        e, members, ways, rings = _contract(e)
        contracted.append((members, ways))
        if not rings.isEmpty():
            settled.append(_ring_least(rings))
        if e.count() >= 0.9 * before:
            break
    kernel = settle(e.select(F.explode(F.array("from", "to")).alias("id")).distinct())
    while not kernel.isEmpty():
        found, inside = _colour(kernel, e)
        settled.append(found)
        kernel = settle(kernel.join(found, "id", "left_anti"))
        e = settle(inside.join(kernel.select(F.col("id").alias("from")), "from", "left_semi").join(kernel.select(F.col("id").alias("to")), "to", "left_semi"))
    known = reduce(DataFrame.unionByName, settled, every.limit(0).select("id", F.col("id").alias("component")))
    # Undo the contractions, last first: a way's nodes join the component that both its ends are in.
    for members, ways in reversed(contracted):
        known = settle(known)
        of = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))  # noqa: E731, B023
        both = ways.join(of("from"), "from", "left").join(of("to"), "to", "left")
        closed = settle(both.withColumn("c", F.coalesce("c_from", "from")).filter(F.col("c") == F.coalesce("c_to", "to")).select("way", "from", "c"))
        ends = closed.select(F.col("from").alias("id"), F.col("c").alias("component")).distinct().join(known.select("id"), "id", "left_anti")
        known = known.union(ends).union(members.join(closed.select("way", F.col("c").alias("component")), "way").select("id", "component"))
    known = settle(known)
    least = known.groupBy("component").agg(F.min("id").alias("least"))
    known = known.join(least, "component").select("id", F.col("least").alias("component"))
    return every.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def condense(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(from, to): distinct edges between components."""
    a = components.select(F.col("id").alias("from"), F.col("component").alias("ca"))
    b = components.select(F.col("id").alias("to"), F.col("component").alias("cb"))
    return edges.join(a, "from").join(b, "to").filter("ca <> cb").select(F.col("ca").alias("from"), F.col("cb").alias("to")).distinct()


def cycle_report(edges: DataFrame, components: DataFrame, min_size: int = 2) -> DataFrame:
    """(component, size, members, edges, weight): components from min_size on; weight counts self-loops."""
    size = components.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list(F.col("id"))), ";").alias("members"))
    a = components.select(F.col("id").alias("from"), F.col("component").alias("ca"))
    b = components.select(F.col("id").alias("to"), F.col("component").alias("cb"))
    inner = edges.join(a, "from").join(b, "to").filter("ca = cb")
    sums = inner.groupBy(F.col("ca").alias("component")).agg(F.count_if(F.col("from") != F.col("to")).alias("edges"), F.sum("count").alias("weight"))
    return size.filter(F.col("size") >= max(1, min_size)).join(sums, "component", "left").fillna(0, ["edges", "weight"])


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer) of an acyclic graph: 0 without dependencies, else one more than the highest of them.

    A node with one dependency lies one above it, so ways through such nodes are followed by doubling; rounds of the
    relaxation count only nodes with several dependencies on the way.
    """
    e = settle(edges.select("from", "to").distinct())
    out = e.groupBy(F.col("from").alias("k")).agg(F.count("*").alias("o"), F.min("to").alias("only"))
    linked = nodes.select("id").join(out, F.col("id") == F.col("k"), "left").select("id", F.when(F.col("o") == 1, F.col("only")).alias("next"), (F.col("o") > 1).alias("several"))
    linked = settle(linked)
    way = settle(jumps(linked.select("id", "next"), []).select("id", "root", "steps"))
    several = linked.filter("several").select(F.col("id").alias("from"))
    up = settle(e.join(several, "from", "left_semi").join(way, F.col("to") == F.col("id")).groupBy("from", "root").agg((F.max("steps") + 1).alias("rise")))
    start = way.select(F.col("root").alias("id")).distinct().withColumn("layer", F.lit(0).cast("long"))

    def step(d: DataFrame) -> DataFrame:
        least = up.join(d.select(F.col("id").alias("root"), "layer"), "root").groupBy("from").agg(F.max(F.col("layer") + F.col("rise")).alias("up"))
        return d.join(least, d["id"] == least["from"], "left").select("id", F.greatest("layer", F.coalesce("up", F.lit(0))).alias("layer"))

    top = until_stable(start, step, checksum).select(F.col("id").alias("root"), F.col("layer").alias("below"))
    return way.join(top, "root").select("id", (F.col("below") + F.col("steps")).cast("int").alias("layer"))


def feedback_arcs(edges: list[tuple]) -> list[tuple]:
    """A small set of edges (from, to, weight) whose removal leaves no cycle: a greedy order, then arcs are put back.

    Nodes without incoming (outgoing) weight go to the front (back); otherwise the one with the largest surplus of
    outgoing weight, ties by id. Arcs against the order are candidates; the heaviest are re-admitted while no cycle closes.
    """
    out: dict = {}
    into: dict = {}
    for a, b, w in edges:
        if a != b:
            out.setdefault(a, {})[b] = out.get(a, {}).get(b, 0) + w
            into.setdefault(b, {})[a] = into.get(b, {}).get(a, 0) + w
    nodes = sorted({*out, *into})
    gain = {n: sum(out.get(n, {}).values()) - sum(into.get(n, {}).values()) for n in nodes}
    degree_in, degree_out = ({n: len(m.get(n, {})) for n in nodes} for m in (into, out))
    heap = [(-gain[n], n) for n in nodes]
    heapq.heapify(heap)
    sinks, sources = [n for n in nodes if not degree_out[n]], [n for n in nodes if not degree_in[n] and degree_out[n]]
    gone: set = set()
    front, back = [], []

    def remove(n) -> None:
        gone.add(n)
        for m, w in out.get(n, {}).items():
            if m not in gone:
                gain[m] += w
                degree_in[m] -= 1
                heapq.heappush(heap, (-gain[m], m))
                if not degree_in[m]:
                    sources.append(m)
        for m, w in into.get(n, {}).items():
            if m not in gone:
                gain[m] -= w
                degree_out[m] -= 1
                heapq.heappush(heap, (-gain[m], m))
                if not degree_out[m]:
                    sinks.append(m)

    while len(gone) < len(nodes):
        if sinks:
            n = sinks.pop()
            if n not in gone:
                back.append(n)
                remove(n)
        elif sources:
            n = sources.pop()
            if n not in gone:
                front.append(n)
                remove(n)
        else:
            g, n = heapq.heappop(heap)
            if n not in gone and -g == gain[n]:
                front.append(n)
                remove(n)
    rank = {n: k for k, n in enumerate(front + back[::-1])}
    keep: dict = {}
    against = []
    for a, targets in out.items():
        for b, w in targets.items():
            if rank[a] < rank[b]:
                keep.setdefault(a, set()).add(b)
            else:
                against.append((a, b, w))
    result = []
    for a, b, w in sorted(against, key=lambda x: (-x[2], x[0], x[1])):
        todo, seen = [b], {b}
        while todo and a not in seen:
            for m in keep.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        if a in seen:
            result.append((a, b, w))
        else:
            keep.setdefault(a, set()).add(b)
    return result


def feedback_arc_set(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, from, to, count): feedback arcs of each cyclic component; components are worked on in parallel."""
    a = components.select(F.col("id").alias("from"), F.col("component").alias("component"))
    b = components.select(F.col("id").alias("to"), F.col("component").alias("cb"))
    inner = edges.join(a, "from").join(b, "to").filter("component = cb AND `from` <> `to`").select("component", "from", "to", "count")
    kind = dict(inner.dtypes)

    def arcs(g: pd.DataFrame) -> pd.DataFrame:
        found = feedback_arcs(list(zip(g["from"], g["to"], g["count"])))
        return pd.DataFrame({"component": [g["component"].iloc[0]] * len(found), "from": [x[0] for x in found], "to": [x[1] for x in found], "count": [x[2] for x in found]})

    return inner.groupBy("component").applyInPandas(arcs, ", ".join(f"`{c}` {kind[c]}" for c in ("component", "from", "to", "count")))
