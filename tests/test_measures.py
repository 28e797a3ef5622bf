import pytest

from terracefold.operators import measures

DAY = measures.DAY


def test_hand_counted(spark):
    now = 1000 * DAY
    commits = spark.createDataFrame([("a", "x", now - 10 * DAY, True, False), ("b", "y", now - 200 * DAY, None, True), ("old", "x", now - 400 * DAY, False, False), ("later", "x", now + DAY, False, False)], "commit string, author string, time long, is_fix boolean, is_revert boolean")
    changes = spark.createDataFrame(
        [("a", "p", 6, 2), ("a", "q", 8, 0), ("b", "p", 8, None), ("b", "p", 0, 0), ("b", "r", 0, 0), ("old", "p", 100, 100), ("later", "p", 9, 9), ("unknown", "p", 1, 1)],
        "commit string, path string, added long, deleted long",
    )
    got = {r.path: r.asDict() for r in measures.file_measures(commits, changes, now).collect()}
    assert set(got) == {"p", "q", "r"}
    p = got["p"]
    assert (p["commits_long"], p["commits_recent"], p["churn_long"], p["churn_recent"], p["bug_fix_commits"], p["revert_commits"]) == (2, 1, 16, 8, 1, 1)
    assert (p["authors_long"], p["authors_recent"], p["ownership_top_share"], p["burst"]) == (2, 1, 0.5, 0.5)
    assert (p["age_days"], p["last_modified_days"]) == (200.0, 10.0)
    # Commit a is split evenly over two files (1 bit), commit b lies in one (0 bits).
    assert (p["change_entropy_long"], p["change_entropy_recent"]) == (0.5, 1.0)
    assert p["cochange_entropy_long"] == pytest.approx(1.0) and p["cochange_entropy_recent"] == 0.0
    assert (got["r"]["ownership_top_share"], got["r"]["churn_long"], got["r"]["change_entropy_recent"]) == (0.0, 0, 0.0)
    known, odd = measures.join_measures(spark.createDataFrame([("p",), ("z",)], "path string"), measures.file_measures(commits, changes, now))
    assert [r.path for r in known.collect()] == ["p"] and {(r.path, r.side) for r in odd.collect()} == {("z", "model"), ("q", "history"), ("r", "history")}
    assert measures.file_measures(commits.limit(0), changes, now).collect() == []
