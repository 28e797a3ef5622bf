import pytest
from oracle import rows

from terracefold.operators import coupling, fold, views
from terracefold.plans.fixpoint import shared_folder
from terracefold.queries import store as queries
from terracefold.sources import star, store
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ENTITY = "id string, kind string, traits array<string>, name string, parent string, is_stub boolean"
EDGE = "edge string, `from` string, `to` string, provenance string"


@pytest.fixture(scope="module")
def opened(spark):
    return queries.opened(spark, SF)


def graph(spark, entities, edges):
    return spark.createDataFrame(entities, ENTITY), spark.createDataFrame(edges, EDGE)


def test_a_fold_shuffles_no_edges(opened):
    for level in ("type", "module"):
        for view in (None, views.internal_only(), views.declared_only()):
            plan = opened.fold(level, view).edges._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
    assert opened.table("edge").groupBy("target").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


VIEWS = [None, views.internal_only(), views.declared_only(), views.compose_views(views.internal_only(), views.declared_only()), views.provenance_only("declared", "derived"), views.compose_views(views.provenance_only("derived"), views.declared_only())]


@pytest.mark.parametrize("level", ["type", "module"])
@pytest.mark.parametrize("view", VIEWS, ids=lambda v: "all" if v is None else "+".join(v.filters))
def test_equals_the_fold_of_frames(spark, opened, level, view):
    plain = fold.fold(star.entities(spark, SF), star.edges(spark, SF), level, view)
    kept = opened.fold(level, view)
    for a, b in ((kept.nodes, plain.nodes), (kept.edges, plain.edges), (kept.diagnostics, plain.diagnostics)):
        assert rows(a.toPandas()) == rows(b.toPandas())


def test_a_type_named_as_its_module_and_dangling_ends(spark, tmp_path):
    """Ids that differ by a slash stay apart; ends that are no entity, or have no container, are counted and dropped."""
    entities = [
        ("x:A", "package", ["TModule"], "A", None, False),
        ("x:A/A", "class", ["TType"], "A", "x:A", False),
        ("x:A/B", "class", ["TType"], "B", "x:A", True),
        ("x:loose", "function", ["TInvocable"], "f", None, None),
    ]
    edges = [("reference", "x:A/A", "x:A/B", "declared")] * 3 + [("invocation", "x:A/A", "x:A/A", "derived"), ("invocation", "x:loose", "x:A/A", "declared"), ("import", "x:A/A", "x:gone", "declared")]
    e, x = graph(spark, entities, edges)
    name = store.import_graph(e, x, f"file://{tmp_path}/store", buckets=3)
    opened = store.Store(spark, f"file://{tmp_path}/store", name)
    for level in ("type", "module"):
        for view in (None, views.internal_only()):
            for kinds, drop in ((None, False), (["reference"], True)):
                plain, kept = fold.fold(e, x, level, view, kinds, drop), opened.fold(level, view, kinds, drop)
                for a, b in ((kept.nodes, plain.nodes), (kept.edges, plain.edges), (kept.diagnostics, plain.diagnostics)):
                    assert rows(a.toPandas()) == rows(b.toPandas()), (level, view, kinds)
    assert [tuple(r) for r in opened.fan_in(2).collect()] == [("x:A/B", 3), ("x:A/A", 2)]
    assert {r.id for r in opened.members("x:A").collect()} == {"x:A", "x:A/A", "x:A/B"}
    assert sorted(map(tuple, opened.edges().collect())) == [("invocation", "x:A/A", "x:A/A", "derived", 1), ("invocation", "x:loose", "x:A/A", "declared", 1), ("reference", "x:A/A", "x:A/B", "declared", 3)]
    assert rows(opened.entities().toPandas()) == rows(e.toPandas())


def test_imports_once_and_ignores_what_is_half_written(spark, tmp_path):
    e, x = graph(spark, [("x:A", "package", ["TModule"], "A", None, False)], [])
    calls = []

    def make():
        calls.append(1)
        return e, x

    key = f"test-{tmp_path.name}"
    one = store.open_store(spark, key, make)
    # Another import that died: tables, but no row in `imports`.
    e.write.parquet(f"{shared_folder(spark)}/graph-store/{key}/000000000000/entity")
    two = store.open_store(spark, key, make)
    assert calls == [1] and one.name == two.name
    assert two.fold("module").edges.collect() == [] and [tuple(r) for r in two.fold("module").nodes.collect()] == [("x:A", 1)]
    assert two.fan_in(3).collect() == []


def test_opens_in_a_session_that_does_not_know_the_tables(spark, opened):
    for table in ("edge", "fold_type", "fold_module"):
        spark.sql(f"DROP TABLE IF EXISTS `{opened._catalog(table)}`")  # external: the files stay
    again = store.Store(spark, opened.root, opened.name)
    assert rows(again.fold("module").edges.toPandas()) == rows(fold.fold(star.entities(spark, SF), star.edges(spark, SF), "module").edges.toPandas())


def test_other_views_are_refused(opened):
    with pytest.raises(store.UnknownView):
        opened.fold("type", views.make_view("big", lambda: F.length("name") > 3))


def test_fingerprint_follows_the_files(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/t")
    before = store.fingerprint(spark, [f"{tmp_path}/t"])
    assert before == store.fingerprint(spark, [f"{tmp_path}/t"])
    spark.range(4).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    assert before != store.fingerprint(spark, [f"{tmp_path}/t"])


def test_a_query_writes_only_the_tables_it_needs(spark, tmp_path):
    """the coupling of types does not write the other tables; who needs them next writes them to the same import."""
    e, x = graph(spark, [("x:A", "package", ["TModule"], "A", None, False), ("x:A/B", "class", ["TType"], "B", "x:A", True), ("x:A/C", "class", ["TType"], "C", "x:A", None)], [("reference", "x:A/B", "x:A/C", "declared")] * 2 + [("odd", "x:A/C", "x:A", None)])
    key = f"test-{tmp_path.name}"
    few = store.open_store(spark, key, lambda: (e, x), ["fold_type", "node_type"])
    assert set(few.parts) == {"fold_type", "node_type"}
    plan = coupling.coupling(few.fold("type").nodes, few.fold("type").edges, dealt=True)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    whole = store.open_store(spark, key, lambda: (e, x))
    assert whole.name == few.name and set(whole.parts) == set(store.TABLES) and whole.parts["fold_type"] == few.parts["fold_type"]
    for level in ("type", "module"):
        for view in (None, views.internal_only()):
            plain, kept = fold.fold(e, x, level, view), whole.fold(level, view)
            for a, b in ((kept.nodes, plain.nodes), (kept.diagnostics, plain.diagnostics), (kept.edges, plain.edges)):
                assert rows(a.toPandas()) == rows(b.toPandas()), (level, view)
            assert rows(coupling.coupling(kept.nodes, kept.edges, dealt=True).toPandas()) == rows(coupling.coupling(plain.nodes, plain.edges).toPandas())
    assert sorted(map(tuple, whole.edges().collect()), key=repr) == [("odd", "x:A/C", "x:A", None, 1), ("reference", "x:A/B", "x:A/C", "declared", 2)]
