import pytest

from terracefold.operators import replay


def test_frames_state_and_arcs(spark):
    commits = spark.createDataFrame([("c1", 10, "x", None), ("c2", 20, "y", True), ("c3", 20, "x", False), ("c4", 40, "x", False)], "commit string, time long, author string, is_fix boolean")
    changes = spark.createDataFrame([("c1", "p", 40, 0), ("c2", "p", 0, 90), ("c4", "p", 20, 0), ("c3", "q", 10, 0)], "commit string, path string, added long, deleted long")
    clock = replay.ticks(commits)
    assert [(r.commit, r.tick) for r in clock.orderBy("tick").collect()] == [("c1", 0), ("c2", 1), ("c3", 2), ("c4", 3)]
    rows = replay.sizes(commits, changes, clock)
    frames = replay.frames(rows)
    # Heights share one scale: 40 lines are the highest that any file ever was; at 0 there is no building.
    assert sorted(map(tuple, frames.collect())) == [("p", 0, 40.0, 1), ("p", 1, 0.0, 0), ("p", 3, 20.5, 1), ("q", 2, 10.75, 1)]
    at = spark.createDataFrame([(0,), (1,), (2,), (9,)], "at long")
    assert sorted((r.at, r.path, r.since) for r in replay.state_at(frames, at).collect()) == [(0, "p", 0), (1, "p", 1), (2, "p", 1), (2, "q", 2), (9, "p", 3), (9, "q", 2)]
    plots = {r.path: (r.height, r.side, r.loc, r.peak, r.revisions, r.churn) for r in replay.buildings(rows).collect()}
    assert plots == {"p": (20.5, 20.0, 20, 40, 3, 150), "q": (10.75, 2.0, 10, 10, 1, 10)}
    pairs = spark.createDataFrame([("p", "q", 3, 0.5), ("p", "r", 7, 0.2), ("q", "r", 1, 0.9)], "a string, b string, support long, confidence double")
    raised = spark.createDataFrame([("p", "P1"), ("p", "P2"), ("q", "Q"), ("r", "Q")], "file string, building string")
    assert sorted(map(tuple, replay.arcs(pairs, raised).collect())) == [("P1", "Q", 7, 0.2), ("P2", "Q", 7, 0.2)]


def test_too_many_ticks_at_once(spark, monkeypatch):
    monkeypatch.setattr(replay, "ASKED", 2)
    frames = spark.createDataFrame([("p", 0, 1.0, 1)], "path string, tick long, height double, heat int")
    with pytest.raises(ValueError, match="ticks"):
        replay.state_at(frames, spark.range(3).withColumnRenamed("id", "at"))
