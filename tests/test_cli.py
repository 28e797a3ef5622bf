import json

from test_sources import LOG, model

from terracefold import cli
from terracefold.operators import cloud
from terracefold.sources import sidecars


def test_commands(spark, tmp_path, capsys):
    m = model(tmp_path)
    assert cli.main(["analyze", m, "--report", "deps"]) == 0
    assert "java:com.x/A\tjava:com.x/A\t1\tinvocation\tdeclared\tTrue" in capsys.readouterr().out
    assert cli.main(["validate", m]) == 0
    assert cli.main(["validate", model(tmp_path, "bad.jsonl", end=9)]) == 1
    assert cli.main(["export", m, "--format", "csv", "--level", "module"]) == 0
    assert "from,to,count,kinds,provenances" in capsys.readouterr().out
    assert cli.main(["nonsense"]) == 2 and cli.main(["analyze", str(tmp_path / "none.jsonl")]) == 3
    (tmp_path / "r.log").write_text(LOG)
    assert cli.main(["history", str(tmp_path / "r.log"), "--report", "hotspots"]) == 0
    assert "b.py" in capsys.readouterr().out


def test_sidecars(spark, tmp_path):
    rows = [{"t": "header"}, {"t": "f", "path": "a", "vcs": {"commits": 3}}, {"t": "e", "key": {"lang": "java", "module": "m", "symbol": "A"}, "vcs": {"risk": 0.5}}]
    (tmp_path / "h.jsonl").write_text("\n".join(map(json.dumps, rows)))
    files, entities = sidecars.read_history_metrics(spark, str(tmp_path / "h.jsonl"))
    assert [tuple(r) for r in files.collect()] == [("a", "commits", 3.0)]
    assert [(r.symbol, r.metric, r.value) for r in entities.collect()] == [("A", "risk", 0.5)]
    assert sidecars.first_wins([files, files]).count() == 1
    (tmp_path / "t.txt").write_text("# list\norder line # x\norder line\n\n")
    assert [r.business for r in sidecars.read_terms(spark, str(tmp_path / "t.txt")).collect()] == ["order line"]
    (tmp_path / "w.txt").write_text("Order\nbad word\n")
    good, bad = sidecars.read_words(spark, str(tmp_path / "w.txt"))
    assert [r.word for r in good.collect()] == ["order"] and [r.word for r in bad.collect()] == ["bad word"]
    (tmp_path / "i.jsonl").write_text(json.dumps({"id": "a", "level": "type", "words": [{"word": "w", "concern": "domain"}]}) + '\n{"id": "b", "lev')
    insights, words = sidecars.read_insights(spark, str(tmp_path / "i.jsonl"))
    assert [r.id for r in insights.collect()] == ["a"] and [r.word for r in words.collect()] == ["w"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text("1\n2\n3\n4")
    anchors = spark.createDataFrame([("x", "A.java", 2, 3)], "id string, file string, start int, `end` int")
    assert [tuple(r) for r in sidecars.source_slices(spark, f"{tmp_path}/src", anchors).collect()] == [("x", "2\n3")]


def test_cloud():
    boxes = cloud.layout([("order", 9), ("line", 4), ("<b>", 1)])
    for i, a in enumerate(boxes):
        for b in boxes[:i]:
            assert a["x"] + a["width"] <= b["x"] or b["x"] + b["width"] <= a["x"] or a["y"] + a["height"] <= b["y"] or b["y"] + b["height"] <= a["y"]
    assert "&lt;b&gt;" in cloud.svg(boxes) and cloud.layout([]) == []
