import json

from terracefold.operators import dossiers

ENTITY = "id string, kind string, traits array<string>, name string, parent string, is_stub boolean, declared_type string, start long, `end` long"
EDGE = "edge string, `from` string, `to` string, provenance string, is_read boolean, is_write boolean, file string, start long, `end` long"
CODE = [
    ("m", "package", ["TModule"], "m", None, False, None, None, None),
    ("T", "class", ["TType"], "T", "m", False, None, 1, 90),
    ("T.f", "method", ["TInvocable"], "f", "T", False, None, 10, 20),
    ("T.f.lambda", "lambda", ["TInvocable"], None, "T.f", False, None, None, None),
    ("T.f.p", "parameter", ["TStructural"], "p", "T.f", False, "Ext", None, None),
    ("Local", "class", ["TType"], "Local", "T.f.lambda", False, None, None, None),
    ("Local.g", "method", ["TInvocable"], "g", "Local", False, None, None, None),
    ("T.a", "field", ["TStructural"], "a", "T", False, "Ext", None, None),
    ("Ext", "class", ["TType"], "Ext", "lib", True, None, None, None),
    ("Ext.h", "method", ["TInvocable"], "h", "Ext", None, None, None, None),
    ("lib", "package", ["TModule"], "lib", None, True, None, None, None),
]
EDGES = [
    ("invocation", "T.f.lambda", "Ext.h", "declared", None, None, "f", 15, 15),
    ("invocation", "T.f", "Local.g", "derived", None, None, "f", 12, 12),
    ("invocation", "Local.g", "Ext.h", "declared", None, None, "f", 13, 13),
    ("access", "T.f.lambda", "T.a", "declared", True, False, "f", 14, 14),
    ("throws", "T.f", "Ext", "declared", None, None, "f", 16, 16),
    ("annotationUse", "T.f", "Ext", "declared", None, None, "f", 9, 9),
    ("annotationUse", "T.f.p", "Ext", "declared", None, None, "f", 10, 10),
    ("inheritance", "T", "Ext", "declared", None, None, "f", 1, 1),
    ("import", "m", "lib", "declared", None, None, "f", 1, 1),
]


def test_facts_of_an_operation_and_all_below_but_types(spark):
    e, x = spark.createDataFrame(CODE, ENTITY), spark.createDataFrame(EDGES, EDGE)
    got = {r.id: json.loads(r.facts) for r in dossiers.as_json(dossiers.dossiers(e, x)).collect()}
    assert set(got) == {"T", "Local"}  # stubs have none
    site = lambda k: {"file": "f", "start": k, "end": k}
    call = {"to": "Ext.h", "targetType": "Ext", "targetTypeName": "Ext", "external": True, "provenance": "declared"}
    assert got["T"] == {
        "id": "T",
        "kind": "class",
        "name": "T",
        "module": "m",
        "supertypes": [{"to": "Ext", "relation": "inheritance", "name": "Ext", "external": True, "provenance": "declared"}],
        "fields": [{"id": "T.a", "kind": "field", "name": "a", "declaredType": "Ext", "declaredTypeName": "Ext", "declaredTypeKind": "class", "declaredTypeExternal": True}],
        "operations": [
            {
                "id": "T.f",
                "kind": "method",
                "name": "f",
                "start": 10,
                "end": 20,
                "loc": 11,
                "annotations": [{"annotation": "Ext", "name": "Ext", "module": "lib", **site(9)}],
                "invocations": [{"to": "Local.g", "targetType": "Local", "targetTypeName": "Local", "external": False, "provenance": "derived", **site(12)}, {**call, **site(15)}],
                "accesses": [{"to": "T.a", "field": "a", "ownerType": "T", "ownerTypeName": "T", "isRead": True, "isWrite": False, "external": False, "provenance": "declared", **site(14)}],
                "throws": [{"to": "Ext", "name": "Ext", "external": True, "provenance": "declared", **site(16)}],
            }
        ],
    }
    assert [o["invocations"] for o in got["Local"]["operations"]] == [[{**call, **site(13)}]]
    assert got["Local"]["module"] == "m"


def test_modules(spark):
    e, x = spark.createDataFrame(CODE, ENTITY), spark.createDataFrame(EDGES, EDGE)
    assert [(r.id, r.types, [tuple(i) for i in r.imports]) for r in dossiers.modules(e, x).collect()] == [("m", ["Local", "T"], [("lib", "lib", 1, True)])]


def test_empty_graph(spark):
    e, x = spark.createDataFrame([], ENTITY), spark.createDataFrame([], EDGE)
    assert dossiers.dossiers(e, x).collect() == [] and dossiers.modules(e, x).collect() == []


def test_facts_are_dealt_once_by_their_type(spark):
    """Nested facts are grouped by operation and by type where one shuffle by type has brought them."""
    e, x = spark.createDataFrame(CODE, ENTITY), spark.createDataFrame(EDGES, EDGE)
    plan = dossiers.dossiers(e, x)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(of#") == 1
    assert "Exchange hashpartitioning(operation#" not in plan


def test_words_of_provenance_beyond_the_vocabulary(spark):
    edges = [("invocation", "T.f", "Ext.h", p, None, None, "f", k, k) for k, p in enumerate(["guessed", None, "derived"])]
    edges += [("access", "T.f", "gone", "declared", False, None, "f", 9, 9), ("invocation", "Ext.h", "T.f", "declared", None, None, "f", 9, 9)]
    e, x = spark.createDataFrame(CODE, ENTITY), spark.createDataFrame(edges, EDGE)
    got = {r.id: r.operations for r in dossiers.dossiers(e, x).collect()}
    assert [o.id for o in got["T"]] == ["T.f"] and set(got) == {"T", "Local"}
    assert [i.provenance for i in got["T"][0].invocations] == ["guessed", None, "derived"]
    assert [(a.to, a.field, a.ownerType, a.isRead, a.isWrite, a.external) for a in got["T"][0].accesses] == [("gone", None, None, False, None, True)]
