import json
import random

import pytest
from pyspark.sql import functions as F

from terracefold.plans.order import positions
from terracefold.queries import records as queries
from terracefold.sources import records
from terracefold.streaming import records as streamed

SF = "/root/testdata/sf0.001"
HEAD = {"t": "header", "dict": {"kinds": ["class"], "traits": ["TType", "TModule"], "edges": ["reference"], "provenance": ["declared", "derived"]}}
GOOD = [HEAD, {"t": "f", "i": 0, "path": "a"}, {"t": "e", "i": 0, "k": 0, "tr": [0, 1], "m": 0, "anchor": [0, 1, 2], "declaredType": 1}, {"t": "e", "i": 1, "k": 0, "tr": [], "m": 0, "parent": 0, "definedIn": [0]}, {"t": "x", "k": 0, "f": 0, "o": 1, "p": 1, "anchor": [0, 1, 1]}]


def end(files=1, entities=2, edges=1):
    return {"t": "eof", "counts": {"files": files, "entities": entities, "edges": edges}}


def changed(at, **new):
    return [*GOOD[:at], {k: v for k, v in {**GOOD[at], **new}.items() if v is not ...}, *GOOD[at + 1 :], end()]


#: Broken files, and the findings (line, rule, detail) of each.
CASES = {
    "good": ([*GOOD, end()], []),
    "blank": (["", *GOOD[1:], end()], [(2, "before-header", "f"), (3, "before-header", "e"), (4, "before-header", "e"), (5, "before-header", "x"), (6, "before-header", "eof"), (0, "no-header", ""), (3, "vocabulary", "kind:0;trait:0;trait:1"), (4, "vocabulary", "kind:0"), (5, "vocabulary", "edge:0;provenance:1")]),
    "late-header": (["", HEAD, *GOOD[1:], end()], [(2, "header-not-first", "2")]),
    "two-headers": ([*GOOD[:2], HEAD, *GOOD[2:], end()], [(3, "second-header", "")]),
    "repeats": ([{"t": "header", "dict": {**HEAD["dict"], "kinds": ["class", "class"]}}, *GOOD[1:], end()], [(1, "repeated-word", "kinds")]),
    "not-json": ([*GOOD, "{broken", "[1]", '{"t": "zz"}', '{"a": 1}', end()], [(6, "not-json", ""), (7, "no-tag", ""), (8, "unknown-record", "zz"), (9, "no-tag", "")]),
    "no-end": (GOOD, [(0, "no-end", "")]),
    "two-ends": ([*GOOD, end(), end()], [(7, "second-end", "")]),
    "counts": ([*GOOD, end(2, 2, 7)], [(0, "end-counts", "files:2<>1;edges:7<>1")]),
    "after-end": ([*GOOD, end(entities=3), {**GOOD[3], "i": 2}], [(7, "section-closed", "e")]),
    "closed": ([*GOOD[:3], GOOD[4], GOOD[3], end()], [(5, "section-closed", "e")]),
    "dense": (changed(3, i=5), [(4, "not-dense", "5<>1")]),
    "no-number": (changed(1, i=...), [(2, "not-dense", "null<>0")]),
    "words": (changed(2, k=1, tr=[0, 2, -1]), [(3, "vocabulary", "kind:1;trait:2;trait:-1")]),
    "edge-words": (changed(4, k=..., p=2), [(5, "vocabulary", "edge:null;provenance:2")]),
    "module": (changed(2, m=1), [(3, "module-later", "1")]),
    "files": (changed(2, anchor=[1, 1, 1], definedIn=[0, 9]), [(3, "no-file", "anchor:1;definedIn:9")]),
    "edge-files": (changed(4, anchor=..., sourceFile=3), [(5, "no-file", "anchor:null;sourceFile:3")]),
    "entities": (changed(3, declaredType=2, parameters=[0, 8], localVariables=[9]), [(4, "no-entity", "declaredType:2;parameters:8;localVariables:9")]),
    "edge-ends": (changed(4, f=-1, o=2, candidates=[1, 7]), [(5, "no-entity", "from:-1;to:2;candidate:7")]),
    "empty": ([""], [(0, "no-header", ""), (0, "no-end", "")]),
}


def text(records_):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records_)


@pytest.fixture(scope="module")
def expected():
    return sorted((name, *f) for name, (_, found) in CASES.items() for f in found)


def test_lines_of_whole_files(spark, expected):
    files = spark.createDataFrame([(n, text(r)) for n, (r, _) in CASES.items()], "path string, value string")
    got = records.check(records.numbered(files).repartition(5)).collect()
    assert sorted(map(tuple, got)) == expected


def test_state_machine_over_any_pieces(expected):
    for seed in range(6):
        r = random.Random(seed)
        got = []
        for name, (lines, _) in CASES.items():
            whole, cuts = text(lines), []
            cuts = sorted(r.randint(0, len(whole)) for _ in range(r.randint(0, 9)))
            pieces = [(k, whole[a:b], k == len(cuts)) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(whole)]))]
            pieces += r.choices(pieces, k=2)  # repeated
            r.shuffle(pieces)
            state = None
            for piece in pieces:
                file = streamed.FileState(state)
                got += [(name, *f) for f in file.arrive([piece])]
                state = file.saved()
        assert sorted(got) == expected


def test_stream_of_broken_files(spark, tmp_path, expected):
    """Pieces arrive over three runs of one query, lines cut anywhere, a file's last piece before others."""
    folder, out, r = tmp_path / "in", tmp_path / "out", random.Random(1)
    folder.mkdir()
    batches = [{}, {}, {}]
    for name, (lines, _) in CASES.items():
        whole = text(lines) + "\n\n\n\n"
        cuts = sorted(r.sample(range(1, len(whole)), 3))
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(whole)])):
            batches[r.randrange(3)][f"{name}.part{k}{'.last' if k == 3 else ''}"] = whole[a:b]

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    for batch in batches:
        for name, value in batch.items():
            (folder / name).write_text(value)
        pieces = streamed.read_pieces(spark, f"file://{folder}", 1000)
        streamed.findings(pieces).writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(*[str(p) for p in out.iterdir()]).collect()
    assert sorted(map(tuple, got)) == expected


def test_stream_and_batch_agree_on_the_events(spark):
    lines = queries.event_files(spark, SF)
    found = sorted(map(tuple, records.check(lines).collect()))
    files = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("value")).collect()
    got = sorted((r.path, *f) for r in files for f in streamed.FileState().arrive([(0, r.value, True)]))
    assert found == got and len({f[2] for f in found}) >= 4


def test_positions(spark):
    rows = [(k % 3 or None, k * 7 % 50, 1) for k in range(200)] + [(5, 1, 2)]
    df = spark.createDataFrame(rows, "g long, v long, w long").repartition(6)
    got = positions(df, ["v"], "place", ["g"], {"before": "w"}).collect()
    for g in (None, 1, 2, 5):
        own = sorted((r.place, r.v, r.before) for r in got if r.g == g)
        values = sorted(r[1] for r in rows if r[0] == g)
        assert [(p, v) for p, v, _ in own] == list(enumerate(values, 1))
        assert [b for *_, b in own] == [p - 1 for p, *_ in own]
    assert [r.n for r in positions(df, [F.desc("v")], "n").orderBy("n").collect()] == list(range(1, 202))
    assert positions(df.limit(0), ["v"], "n", ["g"]).collect() == []
