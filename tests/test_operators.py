"""Hand-made graphs and histories."""

import random

import pytest
from pyspark.sql import functions as F

from terracefold.functions import scalar
from terracefold.operators import components, conformance, coupling, fold, history, insights, temporal, views

ENT = "id string, kind string, traits array<string>, name string, parent string, is_stub boolean"
EDGE = "edge string, `from` string, `to` string, provenance string, start int, `end` long"


@pytest.fixture(scope="module")
def graph(spark):
    e = [
        ("m", "package", ["TModule"], "m", None, False),
        ("n", "package", ["TModule"], "n", None, False),
        ("A", "class", ["TType"], "A", "m", False),
        ("B", "class", ["TType"], "B", "n", False),
        ("S", "class", ["TType"], "S", "n", True),
        ("A.f", "method", ["TInvocable"], "f", "A", None),
        ("A.f.x", "lambda", ["TInvocable"], None, "A.f", None),
        ("loose", "method", ["TInvocable"], None, None, None),
        ("c1", "method", ["TInvocable"], None, "c2", None),
        ("c2", "method", ["TInvocable"], None, "c1", None),
    ]
    x = [
        ("invocation", "A.f.x", "B", "declared", 1, 2),
        ("invocation", "A.f", "B", "derived", 3, 4),
        ("access", "A.f", "A", "declared", 5, 6),
        ("reference", "B", "S", "declared", 0, 1),
        ("invocation", "loose", "A", "odd", 9, 8),
        ("invocation", "A", "gone", "declared", None, 1),
    ]
    return spark.createDataFrame(e, ENT), spark.createDataFrame(x, EDGE)


def test_containers(graph):
    got = {r.id: r.container for r in fold.containers(graph[0], "type").collect()}
    assert got == {"A": "A", "B": "B", "S": "S", "A.f": "A", "A.f.x": "A"}
    assert {r.id: r.container for r in fold.containers(graph[0], "module").collect()}["A.f.x"] == "m"


def test_fold_and_coupling(graph):
    f = fold.fold(*graph, "type")
    got = {(r["from"], r["to"]): (r["count"], r.kinds, r.provenances, r.self_loop) for r in f.edges.collect()}
    assert got == {("A", "B"): (2, "invocation", "declared;derived", False), ("A", "A"): (1, "access", "declared", True), ("B", "S"): (1, "reference", "declared", False)}
    d = f.diagnostics.first()
    assert (d.dropped_edges, d.folded_edges) == (1, 4)
    c = {r.id: (r.fan_in, r.fan_out, r.instability) for r in coupling.coupling(f.nodes, f.edges).collect()}
    assert c == {"A": (0, 1, 1.0), "B": (1, 1, 0.5), "S": (1, 0, 0.0)}
    inner = fold.fold(*graph, "type", views.internal_only())
    assert {r.id for r in inner.nodes.collect()} == {"A", "B"}


def test_views(graph):
    v = views.compose_views(views.internal_only(), views.declared_only(), views.internal_only())
    assert v.filters == ("internal-only", "declared-only")
    assert {(r["from"], r["to"]) for r in views.kept_edges(graph[1], graph[0], v).collect()} == {("A.f.x", "B"), ("A.f", "A")}


def test_conformance(graph):
    found = {(r.rule, r.subject) for r in conformance.check(*graph).collect()}
    assert {("closure", "gone"), ("provenance", "odd"), ("anchor", "missing"), ("anchor", "reversed"), ("anchor", "not-1-based")} <= found


def tarjan(n, edges):
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            reach[a] |= reach[b]
    return {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}


@pytest.mark.parametrize("seed", range(3))
def test_components_partition(spark, seed):
    r = random.Random(seed)
    n = 12
    edges = [(r.randrange(n), r.randrange(n), r.randint(1, 5)) for _ in range(16)]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame(edges, "`from` long, `to` long, count long")
    got = {x.id: x.component for x in components.strong_components(nodes, e).collect()}
    assert got == tarjan(n, [(a, b) for a, b, _ in edges])


@pytest.mark.parametrize("seed", range(20))
def test_feedback_arcs(seed):
    r = random.Random(seed)
    n = 9
    edges = list({(a, b): (a, b, r.randint(1, 6)) for a, b in [(r.randrange(n), r.randrange(n)) for _ in range(25)] if a != b}.values())
    cutset = {(a, b) for a, b, _ in components.feedback_arcs(edges)}

    def acyclic(es):
        es = set(es)
        while True:
            targets = {b for _, b in es}
            gone = {x for x in es if x[0] not in targets}
            if not gone:
                return not es
            es -= gone

    rest = {(a, b) for a, b, _ in edges} - cutset
    assert acyclic(rest)
    assert all(not acyclic(rest | {c}) for c in cutset)


def test_layers_and_reach(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (0, 2, 1)], "`from` long, `to` long, count long")
    assert {r.id: r.layer for r in components.layers(nodes, e).collect()} == {0: 2, 1: 1, 2: 0, 3: 0}
    assert {(r.start, r.id) for r in components.reachable(e, nodes).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_running_size_never_negative(spark):
    steps = [(i, "p", a, d) for i, (a, d) in enumerate([(5, 9), (3, 0), (0, 2), (4, 10), (6, 1)])]
    ch = spark.createDataFrame(steps, "commit long, path string, added long, deleted long")
    cm = spark.createDataFrame([(i, i) for i in range(5)], "commit long, time long")
    assert [r.size for r in history.running_size(ch, cm).orderBy("time").collect()] == [0, 3, 1, 0, 5]


def test_path_join(spark):
    m = spark.createDataFrame([("src/a.py",), ("b.py",), ("x/c.py",), ("y/c.py",)], "path string")
    h = spark.createDataFrame([("repo/src/a.py",), ("q/b.py",), ("c.py",)], "path string")
    assert {tuple(r) for r in history.path_join(m, h).collect()} == {("src/a.py", "repo/src/a.py"), ("b.py", "q/b.py")}


def test_scalars(spark):
    names = [("getHTTPServer2_URL",), ("XMLHttp",), ("a1 22 b",), ("ÄpfelTest",), (None,)]
    got = [r[0] for r in spark.createDataFrame(names, "n string").select(scalar.split_identifier(F.col("n"))).collect()]
    assert got == [["get", "http", "server2", "url"], ["xml", "http"], ["a1", "b"], ["äpfel", "test"], None]
    ordered = spark.createDataFrame([("Ａ",), ("\U00020000",), ("Ascii",)], "s string").orderBy(scalar.u16(F.col("s")))
    assert [r.s for r in ordered.collect()] == ["Ascii", "\U00020000", "Ａ"]
    ids = spark.createDataFrame([("java:m/s#d",), ("java:m",), ("none",)], "i string").select(scalar.parse_id(F.col("i")).alias("k"))
    assert [r.k and tuple(r.k) for r in ids.collect()] == [("java", "m", "s", "d"), ("java", "m", "", None), None]
    half = spark.range(1).select(scalar.round_half_up(F.lit(-0.0005)), scalar.round_half_up(F.lit(0.0005)))
    assert tuple(half.first()) == (0.0, 0.001)


def test_snapshots_refuse_twice(spark):
    store = spark.createDataFrame([("a", "k", "class", 1)], "revision string, key string, kind string, loc long")
    new = store.select("key", "kind", "loc")
    assert temporal.append_snapshot(store, new, "b").count() == 2
    with pytest.raises(ValueError):
        temporal.append_snapshot(store, new, "a")


def test_merge_and_budget(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "id string, seq long, v string")
    log = spark.createDataFrame([("a", 2, "y"), ("a", 3, "z"), ("c", 1, "n")], "id string, seq long, v string")
    assert {r.id: r.v for r in insights.merge_records(base, log).collect()} == {"a": "z", "b": "x", "c": "n"}
    u = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 4, 3, 1])], "g string, ord long, cost long")
    assert [r.taken for r in insights.budget_plan(u, 9, "g").orderBy("ord").collect()] == [True, True, False, False]
