import pytest

from terracefold.operators import fold

ENTITY = "id string, parent string, traits array<string>, is_stub boolean"


@pytest.mark.parametrize("words", [3, 30, 90])
def test_words_beyond_the_vocabulary(spark, words):
    """Kinds that no vocabulary knows are listed with the others, few or many of them; missing ones are not."""
    e = spark.createDataFrame([("A", None, ["TType"], False), ("B", None, ["TType"], False)], ENTITY)
    kinds = ["invocation", "access", *[f"odd{k}" for k in range(words)]]
    rows = [("A", "B", k, p) for k in kinds for p in ("declared", "guessed")] + [("A", "B", None, None), ("B", "A", None, "declared")]
    got = fold.fold(e, spark.createDataFrame(rows, "`from` string, `to` string, edge string, provenance string"), "type").edges
    found = {(r["from"], r.to): (r["count"], r.kinds, r.provenances, r.self_loop) for r in got.collect()}
    assert found == {("A", "B"): (len(rows) - 1, ";".join(sorted(kinds)), "declared;guessed", False), ("B", "A"): (1, "", "declared", False)}


def test_edges_are_shuffled_once_by_each_end_and_once_by_containers(spark):
    """before, equal edges were also gathered by all their columns first."""
    from terracefold.operators import fold

    e = spark.createDataFrame([("A", ["TType"], None), ("B", ["TType"], None), ("f", [], "A")], "id string, traits array<string>, parent string")
    x = spark.createDataFrame([("invocation", "f", "B", "declared")] * 3 + [(None, "B", "A", None)], "edge string, `from` string, `to` string, provenance string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fold.fold(e, x, "type").edges
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 5  # three of edges, one of containers for each end
        assert sorted(map(tuple, found.collect())) == [("A", "B", 3, "invocation", "declared", False), ("B", "A", 1, "", "", False)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
