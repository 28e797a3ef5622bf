"""JSON-line models, git logs, exports, wiring, streams."""

import json

import pytest
from pyspark.sql import functions as F

from terracefold.operators import exports, navigator, planner, wiring
from terracefold.sources import gitlog, jsonl
from terracefold.streaming import events


def model(tmp_path, name="m.jsonl", end=4):
    rows = [
        {"t": "header", "schemaVersion": "1.0.0", "lang": "java", "root": "", "dict": {"kinds": ["class", "method", "package"], "traits": ["TModule", "TType"], "edges": ["invocation"], "provenance": ["declared"]}},
        {"t": "f", "i": 0, "path": "src/A.java"},
        {"t": "e", "i": 0, "k": 2, "tr": [0], "m": 0, "s": "com.x", "name": "x"},
        {"t": "e", "i": 1, "k": 0, "tr": [1], "m": 0, "s": "A", "name": "A", "parent": 0, "anchor": [0, 1, 9], "isStub": False},
        {"t": "e", "i": 2, "k": 1, "tr": [], "m": 0, "s": "A.f", "d": "int", "parent": 1},
        {"t": "e", "i": 3, "k": 1, "tr": [], "m": 0, "s": "A.g", "parent": 1},
        {"t": "x", "k": 0, "f": 2, "o": 3, "p": 0, "anchor": [0, 3, 3]},
        {"t": "eof", "counts": {"files": 1, "entities": end, "edges": 1}},
    ]
    (tmp_path / name).write_text("\n".join(map(json.dumps, rows)) + "\n")
    return str(tmp_path / name)


def test_read_model(spark, tmp_path):
    e, x, wrong = jsonl.read_models(spark, [model(tmp_path)])
    got = {r.id: (r.kind, r.parent, tuple(r.traits), r.anchor and (r.anchor.file, r.anchor.start, r.anchor.end)) for r in e.collect()}
    assert got == {
        "java:com.x": ("package", None, ("TModule",), None),
        "java:com.x/A": ("class", "java:com.x", ("TType",), ("src/A.java", 1, 9)),
        "java:com.x/A.f#int": ("method", "java:com.x/A", (), None),
        "java:com.x/A.g": ("method", "java:com.x/A", (), None),
    }
    assert [(r["from"], r["to"], r.edge, r.provenance) for r in x.collect()] == [("java:com.x/A.f#int", "java:com.x/A.g", "invocation", "declared")]
    assert wrong.count() == 0


def test_findings_of_broken_files(spark, tmp_path):
    bad = model(tmp_path, "bad.jsonl", end=7)
    with open(bad, "a") as f:
        f.write("not json\n")
    details = {r.detail for r in jsonl.read_models(spark, [bad])[2].collect()}
    assert details == {"counts differ from the end record", "no record: not json"}


def test_write_and_read_again(spark, tmp_path):
    e, x, _ = jsonl.read_models(spark, [model(tmp_path)])
    e = e.withColumn("symbol", F.when(F.col("id") == "java:com.x", "").otherwise(F.col("symbol")))
    jsonl.write_model(e, x, "java", f"file://{tmp_path}/out")
    e2, x2, wrong = jsonl.read_models(spark, [f"file://{tmp_path}/out"])
    assert {(r.id, r.kind, r.parent) for r in e2.collect()} == {(r.id, r.kind, r.parent) for r in e.collect()}
    assert [tuple(r) for r in x2.select("from", "to", "edge").collect()] == [tuple(r) for r in x.select("from", "to", "edge").collect()]
    assert wrong.count() == 0


LOG = "\x01c3\x00ann\x003000\x00Fix bug\n1\t2\tb.py\n\x01c2\x00bob\x002000\x00move\n0\t0\ta.py => b.py\n-\t-\timg.png\n\x01c1\x00ann\x001000\x00Revert x\n5\t0\ta.py\n3\t1\tsrc/{old => new}/c.py\n\x01c0\x00ann\x00900\x00empty\n"


def test_git_log(spark, tmp_path):
    (tmp_path / "r.log").write_text(LOG)
    commits, changes = gitlog.read_logs(spark, [str(tmp_path / "r.log")])
    assert {(r.commit, r.is_fix, r.is_revert) for r in commits.collect()} == {("c3", True, False), ("c2", False, False), ("c1", False, True), ("c0", False, False)}
    got = {(r.commit, r.path): (r.added, r.deleted) for r in changes.collect()}
    assert got == {("c3", "b.py"): (1, 2), ("c2", "b.py"): (0, 0), ("c2", "img.png"): (0, 0), ("c1", "b.py"): (5, 0), ("c1", "src/new/c.py"): (3, 1)}
    with pytest.raises(ValueError):
        gitlog.parse("\x01broken")


def test_history_jsonl(spark, tmp_path):
    rows = [{"t": "header", "dict": {"authors": ["ann", "bob"]}}, {"t": "f", "i": 0, "path": "a"}, {"t": "c", "i": 0, "h": "s1", "a": 1, "ts": 5, "fix": True}, {"t": "x", "c": 0, "p": 0, "a": 3, "d": 1}, {"t": "eof"}]
    (tmp_path / "h.jsonl").write_text("\n".join(map(json.dumps, rows)))
    commits, changes = gitlog.read_history(spark, str(tmp_path / "h.jsonl"))
    assert [tuple(r) for r in commits.collect()] == [("s1", "bob", 5, True, False)]
    assert [tuple(r) for r in changes.collect()] == [("s1", "a", 3, 1)]


def test_exports(spark):
    nodes = spark.createDataFrame([('a"x', 1), ("b,c", 2)], "id string, entities long")
    edges = spark.createDataFrame([('a"x', "b,c", 5, "access", "declared")], "`from` string, `to` string, count long, kinds string, provenances string")
    assert [r.line for r in exports.folded_csv(edges).orderBy("n").collect()] == ["from,to,count,kinds,provenances", '"a""x","b,c",5,access,declared']
    dot = [r.line for r in exports.dot_lines(nodes, edges).orderBy("part", "line").collect()]
    assert dot == ['digraph "graph" {', '  "a\\"x";', '  "b,c";', '  "a\\"x" -> "b,c" [label="5", penwidth=3];', "}"]
    uml = [r.line for r in exports.plantuml_lines(nodes, edges).orderBy("part", "line").collect()]
    assert uml[0] == "@startuml" and "n1 --> n2 : 5" in uml


def test_wiring(spark):
    points = spark.createDataFrame([("p1", "I", None), ("p2", "I", "b"), ("p3", "C", None)], "point string, type string, qualifier string")
    impl = spark.createDataFrame([("A", "I"), ("B", "I")], "`from` string, `to` string")
    comp = spark.createDataFrame([("A", "a", False), ("B", "b", False), ("C", "c", True)], "id string, name string, is_primary boolean")
    got = {(r.point, r.target, r.candidates, r.provenance) for r in wiring.derive(points, impl, comp).collect()}
    assert got == {("p1", "A", 2, "dynamic-candidate"), ("p1", "B", 2, "dynamic-candidate"), ("p2", "B", 1, "derived"), ("p3", "C", 1, "derived")}


def test_tree_and_chain(spark):
    e = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x")], "id string, parent string")
    assert {(r.id, r.path, r.depth) for r in navigator.tree(e).collect()} == {("r", "r", 0), ("a", "r>a", 1), ("b", "r>a>b", 2)}
    units = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, own string")
    links = spark.createDataFrame([("a", "b")], "`from` string, `to` string")
    one = {r.id: r.fingerprint for r in planner.chain(units, links).collect()}
    two = {r.id: r.fingerprint for r in planner.chain(units.withColumn("own", F.when(F.col("id") == "b", "3").otherwise(F.col("own"))), links).collect()}
    assert one["a"] != two["a"] and one["b"] != two["b"]


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, events.tumbling(src, late="60 days").collect()))
    q = events.tumbling(events.read(spark, f"{tmp_path}/in"), late="60 days").writeStream.format("memory").queryName("t").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("t").collect())) == want
    q = events.append_snapshots(events.read(spark, f"{tmp_path}/in", 1), f"{tmp_path}/store", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/store").count() == src.count()
