import random

import pytest
from pyspark.sql import functions as F

from terracefold.operators import components
from terracefold.plans import fixpoint, forest


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for s in {x for e in edges for x in e}:
        seen, todo = set(), list(out.get(s, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[s] = seen
    return reach


def shape(seed):
    """Paths, circles, trees, ladders and dense spots, joined at random."""
    r = random.Random(seed)
    edges, n = [], 0
    for _ in range(r.randint(2, 6)):
        size, kind = r.randint(1, 25), r.choice(["path", "ring", "tree", "dense", "ladder"])
        ids = list(range(n, n + size))
        n += size
        r.shuffle(ids)
        if kind in ("path", "ring"):
            edges += list(zip(ids, ids[1:])) + ([(ids[-1], ids[0])] if kind == "ring" else [])
        elif kind == "tree":
            edges += [(ids[r.randrange(k)], ids[k]) if r.random() < 0.5 else (ids[k], ids[r.randrange(k)]) for k in range(1, size)]
        elif kind == "dense":
            edges += [(r.choice(ids), r.choice(ids)) for _ in range(3 * size)]
        else:
            edges += list(zip(ids, ids[1:])) + list(zip(ids, ids[2:]))
    edges += [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 8))]
    return n + 1, edges + r.choices(edges, k=min(3, len(edges)))  # one node without edges, repeated edges


def frames(spark, n, edges):
    return spark.range(n), spark.createDataFrame(edges, "`from` long, `to` long")


@pytest.mark.parametrize("seed", range(3))
def test_against_closure(spark, seed):
    n, edges = shape(seed)
    nodes, e = frames(spark, n, edges)
    reach = closure(edges)
    got = {r.id: r.component for r in components.strong_components(nodes, e).collect()}
    assert got == {i: min([i, *(j for j in reach.get(i, ()) if i in reach.get(j, ()))]) for i in range(n)}
    comp = fixpoint.settle(spark.createDataFrame(list(got.items()), "id long, component long"))
    r = random.Random(seed)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(150)]
    found = components.reaches(nodes, e, spark.createDataFrame(pairs, "a long, b long"), comp).collect()
    assert sorted(map(tuple, found)) == sorted({(a, b) for a, b in pairs if b in reach.get(a, ())})
    units, dag = comp.select(F.col("component").alias("id")).distinct(), components.condense(e, comp)
    below = closure([(got[a], got[b]) for a, b in edges if got[a] != got[b]])

    def layer(c, known={}):  # noqa: B006
        key = (seed, c)
        if key not in known:
            known[key] = max([1 + layer(got[b]) for a, b in edges if got[a] == c != got[b]], default=0)
        return known[key]

    assert {r.id: r.layer for r in components.layers(units, dag).collect()} == {c: layer(c) for c in set(got.values())}
    assert below is not None


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """100 000 nodes in a row: components, layers and a pair's reachability in under 40 joins of the whole each."""
    n = 100_000
    nodes = spark.range(n)
    e = spark.range(n - 1).select(F.col("id").alias("from"), (F.col("id") + 1).alias("to"))
    rounds = []
    real = forest.settle
    monkeypatch.setattr(forest, "settle", lambda d: rounds.append(1) or real(d))
    comp = fixpoint.settle(components.strong_components(nodes, e))
    assert comp.filter("id <> component").isEmpty() and len(rounds) < 40
    rounds.clear()
    top = components.layers(nodes, e).agg(F.max("layer"), F.sum("layer")).first()
    assert tuple(top) == (n - 1, n * (n - 1) // 2) and len(rounds) < 40


def test_circles_of_their_own(spark):
    n = 5000
    e = spark.range(n).select(F.col("id").alias("from"), ((F.col("id") + 1) % n).alias("to")).union(spark.createDataFrame([(n, n + 1), (n + 1, n), (n + 2, n + 2)], "a long, b long"))
    got = components.strong_components(spark.range(n + 3), e).groupBy("component").count().collect()
    assert sorted(map(tuple, got)) == [(0, n), (n, 2), (n + 2, 1)]
    pairs = spark.createDataFrame([(5, 4), (7, 7), (n, n), (n + 2, n + 2), (0, n)], "a long, b long")
    assert sorted(map(tuple, components.reaches(spark.range(n + 3), e, pairs).collect())) == [(5, 4), (7, 7), (n, n), (n + 2, n + 2)]


def test_preorder(spark):
    r = random.Random(2)
    parents = {k: (None if k % 40 == 0 else r.randrange(max(0, k - 12), k)) for k in range(300)} | {900: 901, 901: 900, 902: 901, 903: 10_000}
    names = {k: r.choice("abc") for k in parents}
    nodes = spark.createDataFrame([(k, p, names[k]) for k, p in parents.items()], "id long, parent long, name string").repartition(5)
    got = {r.id: (r.parent, r.depth, r.pre, r.size) for r in forest.preorder(nodes, ["name"]).collect()}
    expected, count = {}, 0

    def visit(node, parent, depth):
        nonlocal count
        mine, count = count, count + 1
        for child in sorted((k for k, p in parents.items() if p == node), key=lambda k: (names[k], k)):
            visit(child, node, depth + 1)
        expected[node] = (parent, depth, mine, count - mine)

    for root in sorted((k for k, p in parents.items() if p not in parents), key=lambda k: (names[k], k)):
        visit(root, None, 0)
    assert got == expected and 900 not in got and 902 not in got


def test_ways_that_meet_take_no_round_for_each_node(spark, monkeypatch):
    """each node has one edge out, and a leaf of lesser id than the way's own node leads into every node of a way."""
    n = 12
    arcs = [(100 + k, 101 + k, 1) for k in range(n)] + [(k, 100 + k, 1) for k in range(n + 1)]
    edges = spark.createDataFrame(arcs, "`from` long, `to` long, count long")
    comp = spark.createDataFrame([(i, i) for i in {*[a for a, _, _ in arcs], 100 + n}], "id long, component long")
    pairs = spark.createDataFrame([(0, 100 + n), (3, 100 + n), (3, 102), (100, 100), (104, 103), (1, 2), (103, 104)], "a long, b long")
    calls, plain = [], components.settle
    monkeypatch.setattr(components, "settle", lambda d: calls.append(1) or plain(d))
    got = components.reaches(comp.select("id"), edges, pairs, comp)
    assert sorted(map(tuple, got.collect())) == [(0, 100 + n), (3, 100 + n), (103, 104)]
    assert len(calls) < 16
