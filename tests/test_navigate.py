from pyspark.sql import functions as F

from terracefold.operators import navigate

ENTITY = "id string, kind string, traits array<string>, name string, parent string, is_stub boolean"
EDGE = "edge string, `from` string, `to` string, provenance string, is_read boolean, is_write boolean"
CODE = [
    ("m", "package", ["TModule"], "m", None, False),
    ("m.sub", "package", ["TModule"], "sub", "m", False),
    ("T", "class", ["TType"], "T", "m", False),
    ("T.Inner", "class", ["TType"], "Inner", "T.f", False),  # a type inside an operation
    ("T.f", "method", ["TInvocable"], "f", "T", False),
    ("T.f.lambda", "lambda", ["TInvocable"], None, "T.f", False),
    ("T.f.p", "parameter", ["TStructural"], "p", "T.f", False),
    ("T.a", "field", ["TStructural"], "a", "T", False),
    ("Inner.g", "method", ["TInvocable"], "g", "T.Inner", False),
    ("loose", "function", ["TInvocable"], "loose", None, False),
    ("U", "class", ["TType"], "U", "m.sub", True),
    ("free", "comment", ["TComment"], "x", "T", False),
]


def rows(spark):
    e = spark.createDataFrame(CODE, ENTITY)
    x = spark.createDataFrame(
        [
            ("invocation", "T.f.lambda", "U", "declared", None, None),
            ("access", "T.f.p", "U", "derived", True, True),
            ("reference", "Inner.g", "T.a", "declared", None, None),
            ("invocation", "T.f", "T.a", "declared", None, None),
            ("invocation", "T.f", "loose", "declared", None, None),
            ("invocation", "T.f", "gone", "declared", None, None),
            ("invocation", "free", "U", "declared", None, None),
        ],
        EDGE,
    )
    return e, x, navigate.nodes(e, x)


def test_tree_of_nested_code(spark):
    e, x, nodes = rows(spark)
    got = {r.id: r for r in nodes.collect()}
    order = [i for i, _ in sorted(got.items(), key=lambda kv: kv[1].node)]
    # Operations lie flat under their type; parameters and comments are no nodes; siblings by category, then name.
    assert order == ["m", "m.sub", "U", "T", "T.Inner", "Inner.g", "T.f.lambda", "T.f", "T.a", "loose"]
    parent = {i: next((k for k, v in got.items() if v.node == r.parent), None) for i, r in got.items()}
    assert parent == {"m": None, "m.sub": "m", "U": "m.sub", "T": "m", "T.Inner": "T", "Inner.g": "T.Inner", "T.f": "T", "T.f.lambda": "T", "T.a": "T", "loose": None}
    assert (got["T"].size, got["T"].children, got["T"].category, got["T.a"].category) == (6, 4, "type", "attribute")
    assert got["T"].fan_out == 1 and got["T.f"].fan_out is None


def test_owners_and_members_of_edges(spark):
    e, x, nodes = rows(spark)
    deps, odd = navigate.dependencies(e, x, nodes)
    name = {r.node: r.id for r in nodes.collect()}
    got = [(r.role, name[r["from"]], name[r.to], name.get(r.member), name.get(r.to_member), r.n) for r in deps.collect()]
    assert sorted(got, key=repr) == [
        ("calls", "T", "U", "T.f.lambda", None, 1),
        ("calls", "T", "U", None, None, 1),
        ("reads", "T", "U", "T.f", None, 1),
        ("references", "T.Inner", "T", "Inner.g", "T.a", 1),
        ("writes", "T", "U", "T.f", None, 1),
    ]
    assert tuple(odd.first()) == (1, 2)  # T.f -> T.a; ends without owner: `loose`, and one that is no entity


def tree(spark, names, stubs=()):
    m = spark.createDataFrame([(k, n, n in stubs) for k, n in enumerate(names)], "id long, name string, is_stub boolean")
    return {(r.path, r.kind, r.id): (r.label, r.parent, r.children, r.all_stub) for r in navigate.packages(m).collect()}


def test_modules_that_share_a_prefix_make_a_group(spark):
    assert tree(spark, ["jakarta.mail.internet", "jakarta.persistence", "org.springframework.core"]) == {
        ("jakarta", "group", None): ("jakarta", None, 2, False),
        ("jakarta.mail.internet", "module", 0): ("mail.internet", "jakarta", 0, False),
        ("jakarta.persistence", "module", 1): ("persistence", "jakarta", 0, False),
        ("org.springframework.core", "module", 2): ("org.springframework.core", None, 0, False),
    }


def test_chains_without_module_fold_into_one_label(spark):
    assert tree(spark, ["org.apache.x.accounting", "org.apache.x.portfolio"], stubs=["org.apache.x.portfolio"]) == {
        ("org.apache.x", "group", None): ("org.apache.x", None, 2, False),
        ("org.apache.x.accounting", "module", 0): ("accounting", "org.apache.x", 0, False),
        ("org.apache.x.portfolio", "module", 1): ("portfolio", "org.apache.x", 0, True),
    }


def test_a_module_adopts_those_it_is_a_prefix_of_and_equal_names_share_a_group(spark):
    assert tree(spark, ["a.b", "a.b.c"]) == {("a.b", "module", 0): ("a.b", None, 1, False), ("a.b.c", "module", 1): ("c", "a.b", 0, False)}
    assert tree(spark, ["a.b", "a.b", "a.b.c.d"], stubs=["a.b", "a.b.c.d"]) == {
        ("a.b", "group", None): ("a.b", None, 3, True),
        ("a.b", "module", 0): ("a.b", "a.b", 0, True),
        ("a.b", "module", 1): ("a.b", "a.b", 0, True),
        ("a.b.c.d", "module", 2): ("c.d", "a.b", 0, True),
    }


def test_display_caps_by_fan_in(spark):
    e, x, nodes = rows(spark)
    deps, _ = navigate.dependencies(e, x, nodes)
    shown, edges, total = navigate.display(nodes, deps, 2, externals=True)
    assert [r.name for r in shown.orderBy(F.desc("fan_in")).collect()][0] in ("T", "U")
    assert tuple(total.first()) == (3, True) and shown.count() == 2 and edges.count() == 1
    assert navigate.display(nodes, deps, 9)[2].first().truncated is False


def test_ends_looked_up_once_for_all(spark):
    """F1-F3, F9: one lookup of the edges' ends serves the coupling and the dependencies, and gives what either gives alone."""
    from terracefold.sources import star

    e, x = (f(spark, "/root/testdata/sf0.001") for f in (star.entities, star.edges))
    rows, found, diagnostics = navigate.navigator(e, x)
    alone = navigate.dependencies(e, x, rows)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, navigate.nodes(e, x).collect()))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, alone[0].collect())) and diagnostics.first() == alone[1].first()


def _settled(spark):
    import glob

    from terracefold.plans.fixpoint import shared_folder

    return set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/{spark.sparkContext.applicationId}/settled-*"))


def test_the_tree_leaves_two_tables_and_edges_one(spark):
    """tables of rounds and of the first lookup go from the disk; what is left gives the same rows."""
    e, x, _ = rows(spark)
    before = _settled(spark)
    got = navigate.nodes(e, x)
    # The tree, owners, their numbers, and the edges with numbers at both ends.
    assert len(_settled(spark) - before) == 4
    assert {r.id: (r.fan_in, r.fan_out) for r in got.collect() if r.fan_in is not None} == {"m": (0, 1), "m.sub": (1, 0), "T": (1, 1), "T.Inner": (0, 1), "U": (1, 0)}


def test_subtrees_from_edges_equal_those_from_dependencies(spark):
    """no edge is grouped; edges of two roles count twice, those inside an owner and without owners not at all."""
    e, x, nodes = rows(spark)
    ids = ["m", "m.sub", "T", "T.Inner", "T.f", "loose"]
    expected = navigate.subtree(navigate.dependencies(e, x, nodes)[0], nodes, ids)
    got = navigate.subtrees(e, x, ids)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) == [("T", 1, 4, 0), ("T.Inner", 0, 1, 0), ("m", 5, 0, 0), ("m.sub", 0, 0, 4)]
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
