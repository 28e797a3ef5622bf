from terracefold.operators import rules

ENTITY = "model_index int, ref long, id string, lang string, kind string, traits array<string>, is_stub boolean, parent string, parameters array<string>, anchor struct<file:string,start:long,`end`:long>"
EDGE = "model_index int, ref long, lang string, edge string, `from` string, `to` string, provenance string, candidates array<string>, anchor struct<file:string,start:long,`end`:long>"
OK = ("f", 1, 2)
KINDS = [("x", "class", ["TType"], ["TNamed", "TSourceAnchor"])]


def entity(ref, i, kind="class", traits=("TType",), model=0, lang="x", stub=False, parent=None, parameters=None, anchor=None):
    return (model, ref, i, lang, kind, list(traits), stub, parent, parameters, anchor)


def edge(ref, a="A", b="B", provenance="declared", candidates=None, anchor=OK, kind="reference"):
    return (0, ref, "x", kind, a, b, provenance, candidates, anchor)


def found(spark, entities, edges):
    kinds = spark.createDataFrame(KINDS, "lang string, kind string, required array<string>, allowed array<string>")
    e, x = spark.createDataFrame(entities, ENTITY), spark.createDataFrame(edges, EDGE)
    return rules.findings(e, x, kinds, spark.createDataFrame([("x", "reference")], "lang string, edge string"))


BASE = [entity(0, "A"), entity(1, "B")]
CASES = [
    ("clean", BASE, [edge(0)], []),
    ("dangling", [entity(0, "A", parent="up", parameters=["A", "gone"]), entity(1, "B")], [edge(0, b="no")], [("dangling-reference", "edges[0].to", "no"), ("dangling-reference", "entities[0].parameters[1]", "gone"), ("dangling-reference", "entities[0].parent", "up")]),
    ("self", BASE, [edge(0, b="A")], [("self-edge", "edges[0]", "A")]),
    ("provenance", BASE, [edge(0, provenance="guess"), edge(1, provenance=None)], [("invalid-provenance", "edges[0].provenance", "A"), ("invalid-provenance", "edges[1].provenance", "A")]),
    ("empty list differs from none", BASE, [edge(0, candidates=[]), edge(1, provenance="dynamic-candidate", candidates=[])], [("candidates-empty", "edges[0].candidates", "A"), ("candidates-empty", "edges[1].candidates", "A")]),
    ("certain with candidates", BASE, [edge(0, candidates=["B"])], [("candidates-without-uncertainty", "edges[0].candidates", "A")]),
    ("uncertain without", BASE, [edge(0, provenance="dynamic-candidate"), edge(1, provenance="dynamic-candidate", candidates=["B"])], [("candidates-missing", "edges[0]", "A")]),
    ("anchors", BASE, [edge(0, anchor=None), edge(1, anchor=("", 1, 1)), edge(2, anchor=("f", 0, 1)), edge(3, anchor=("f", 3, 2))], [("missing-anchor", "edges[0]", "A"), ("anchor-file-empty", "edges[1].anchor", "A"), ("anchor-span-not-1-based", "edges[2].anchor", "A"), ("anchor-span-reversed", "edges[3].anchor", "A")]),
    ("anchors of entities", [entity(0, "A", traits=["TType", "TSourceAnchor"]), entity(1, "B")], [], [("missing-anchor", "entities[0]", "A")]),
    ("kinds", [entity(0, "A", kind="odd"), entity(1, "B", traits=["TNamed"]), entity(2, "C", traits=[], stub=True), entity(3, "D", traits=["TType", "TMetrics"])], [], [("unknown-kind", "entities[0]", "A"), ("missing-required-trait", "entities[1]", "B"), ("trait-not-allowed", "entities[3]", "D")]),
    ("licence", BASE, [edge(0, kind="access")], [("edge-not-licensed", "edges[0]", "A")]),
    ("no profile", [*BASE, entity(0, "Z", model=1, lang="y", kind="odd"), entity(1, "Y", model=1, lang="y")], [], [("unknown-profile", "lang", None)]),
    ("declared again", [entity(0, "A", traits=["TType", "TNamed"]), entity(0, "A", traits=["TNamed", "TType", "TType"], model=1), entity(1, "B"), entity(1, "B", traits=["TType", "TNamed"], model=1)], [], [("duplicate-id-conflict", "entities[1]", "B")]),
]


def test_each_code(spark):
    seen = set()
    for name, entities, edges, expected in CASES:
        got = [(r.code, r.path, r.id) for r in found(spark, entities, edges).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr), name
        seen |= {g[0] for g in got}
    assert seen == set(rules.CODES)


def test_caps_and_verdict(spark):
    edges = [edge(k, provenance="guess") for k in range(9)] + [edge(20, provenance="dynamic-candidate")]
    every = found(spark, BASE, edges)
    got = [(r.rule, r.path, r.suppressed) for r in rules.capped(every, 3).orderBy("rule", "place").collect()]
    assert got == [("candidates", "edges[20]", 0), *[("provenance", f"edges[{k}].provenance", 6) for k in range(3)]]
    assert sorted((r.code, r.findings) for r in rules.counts(every).collect()) == [("candidates-missing", 1), ("invalid-provenance", 9)]
    assert not rules.is_clean(every) and rules.is_clean(every.filter("severity = 'warning'"))


def test_listed_parts_are_absent_however_many_parts_there_are(spark, tmp_path):
    """with parts beyond key 1000000, the part that an edge lists in vain stays one that no table has."""
    import duckdb
    from oracle import expected, rows

    from terracefold.queries import rules as queries

    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        more = " UNION ALL SELECT * REPLACE (p_partkey + 1000000 AS p_partkey) FROM t" if t == "part" else ""
        duckdb.sql(f"COPY (WITH t AS (FROM '/root/testdata/sf0.001/{t}.parquet') SELECT * FROM t{more}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for name, query in queries.QUERIES.items():
        assert rows(query(spark, str(tmp_path)).toPandas()) == rows(expected(queries.ORACLES[name], str(tmp_path))), name
