import pytest
from pyspark.sql import functions as F

from terracefold.streaming.snapshots import RevisionExists, SnapshotStore, append_stream

ROW = "sha string, time long, ref long, module string, symbol string, disambiguator string, kind string, is_stub boolean, loc long, file string, edges array<struct<to:struct<module:string,symbol:string,disambiguator:string>,kind:string,provenance:string>>"


def row(sha, time, symbol, kind="class", loc=1, ref=0, to=()):
    return (sha, time, ref, "m", symbol, None, kind, False, loc, "f", [(("m", t, None), "reference", "declared") for t in to])


ONE = [row("s1", 10, "A", to=["B", "B", "gone"]), row("s1", 10, "B"), row("s1", 10, "B", kind="interface", ref=1)]
TWO = [row("s2", 20, "A"), row("s2", 20, "C", to=["A"])]
THREE = [row("s3", 30, "B", loc=5), row("s3", 30, "A"), row("s3", 30, "C")]


def run(spark, batches, path, check):
    """Each batch as a file, one per trigger."""
    folder = f"{path}/in"
    for b in batches:
        spark.createDataFrame(b, ROW).coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(folder)
    return append_stream(stream, f"{path}/store", check).trigger(availableNow=True).start()


def state(store):
    keys = {r.id: r.symbol for r in store.table("entity_key").collect()}
    return (
        sorted((r.id, r.sha) for r in store.revisions().collect()),
        sorted((r.revision, keys[r.key_id], r.kind, r.loc) for r in store.table("entity_version").collect()),
        sorted((r.revision, keys[r.from_key], keys[r.to_key], r["count"]) for r in store.table("edge_version").collect()),
        sorted(keys.items()),
    )


EXPECTED = (
    [(1, "s1"), (2, "s2"), (3, "s3")],
    sorted([(1, "A", "class", 1), (1, "B", "class", 1), (2, "A", "class", 1), (2, "C", "class", 1), (3, "B", "class", 5), (3, "A", "class", 1), (3, "C", "class", 1)]),
    [(1, "A", "B", 2), (2, "C", "A", 1)],
    [(1, "A"), (2, "B"), (3, "C")],
)


def test_stream_that_fails_between_writes_and_resumes(spark, tmp_path, monkeypatch):
    path, check = f"file://{tmp_path}", f"file://{tmp_path}/check"
    store = SnapshotStore(spark, f"{path}/store")
    real, calls = SnapshotStore._commit, []

    def dies(self, number, sha, time):
        calls.append(sha)
        if len(calls) == 2:
            raise RuntimeError("lost before the revision counts")
        real(self, number, sha, time)

    monkeypatch.setattr(SnapshotStore, "_commit", dies)
    with pytest.raises(Exception, match="lost before"):
        run(spark, [ONE, TWO, THREE], path, check).awaitTermination()
    # The second snapshot's parts are written, but nothing of them counts.
    assert state(store)[0] == [(1, "s1")] and len(state(store)[3]) == 2
    run(spark, [TWO], path, check).awaitTermination()  # the rest, and a snapshot that comes again
    assert state(store) == EXPECTED
    again = SnapshotStore(spark, f"{path}/store")
    assert sorted(map(tuple, again.runs().collect())) == [(1, 1, 3, "class", 1), (2, 1, 1, "class", 1), (2, 3, 3, "class", 5), (3, 2, 3, "class", 1)]


def test_a_sha_is_appended_once(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    e = spark.createDataFrame(ONE, ROW)
    edges = e.select(F.struct("module", "symbol", "disambiguator").alias("from"), F.explode("edges").alias("e")).select("from", "e.*")
    assert store.append(e, edges, "s1") == 1
    with pytest.raises(RevisionExists):
        store.append(e, edges, "s1")
    assert store.append(e.limit(0), edges.limit(0), "empty", 5) == 2
    assert [r.sha for r in store.revisions().orderBy("id").collect()] == ["s1", "empty"]
    assert store.versions().count() == 2
