"""Snapshots of entity graphs appended to a store that keeps every revision.

Tables, each a folder with a part per revision number:
  revision        id, sha, time
  entity_key      id, module, symbol, disambiguator: a number for every natural key ever seen
  entity_version  key_id, kind, is_stub, loc, file: of each key the first entity by ref
  edge_version    from_key, to_key, kind, provenance, count: equal edges counted, those with an end that is no key left out

An append writes the parts of its number, the row of `revision` last: only revisions in that table count. So an append that dies
leaves parts that nobody reads, and the next one, which gets the same number, replaces them. A sha is appended once.
New keys are those that no counted revision holds; their numbers go on from the greatest, in order of key, given by ranges.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import settle
from ..plans.order import positions

KEY = ["module", "symbol", "disambiguator"]
SCHEMAS = {
    "revision": "id long, sha string, time long, revision long",
    "entity_key": "id long, module string, symbol string, disambiguator string, revision long",
    "entity_version": "key_id long, kind string, is_stub boolean, loc long, file string, revision long",
    "edge_version": "from_key long, to_key long, kind string, provenance string, count long, revision long",
}


class RevisionExists(ValueError):
    """The store holds a revision of this sha."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _all(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[table]).option("recursiveFileLookup", "false").parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[table])

    def revisions(self) -> DataFrame:
        return self._all("revision").select("id", "sha", "time")

    def table(self, table: str) -> DataFrame:
        """Rows of counted revisions, with the revision's number."""
        if table == "revision":
            return self.revisions()
        counted = self.revisions().select(F.col("id").alias("revision"))
        return self._all(table).join(F.broadcast(counted), "revision", "left_semi")  # a row per snapshot

    def _write(self, rows: DataFrame, table: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/revision={number}")

    def append(self, entities: DataFrame, edges: DataFrame, sha: str, time: int | None = None) -> int:
        """Add a snapshot: entities (ref, module, symbol, disambiguator, kind, is_stub, loc, file), edges (from, to, kind,
        provenance) whose ends are structs of a key. Returns the revision's number."""
        known = self.revisions().agg(F.max("id").alias("n"), F.count_if(F.col("sha") == sha).alias("same")).first()
        if known.same:
            raise RevisionExists(sha)
        number = (known.n or 0) + 1
        null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        row = F.struct("kind", "is_stub", F.col("loc").cast("long").alias("loc"), "file")
        first = settle(entities.select(*map(null, KEY), "ref", row.alias("row")).groupBy(*KEY).agg(F.min_by("row", "ref").alias("row")))
        keys = settle(self.table("entity_key").select("id", *KEY))  # read before a dead append's part is replaced
        start = keys.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = first.select(*KEY).join(keys.select(*KEY), KEY, "left_anti")
        numbered = positions(new, KEY, "id").select((F.col("id") + start).alias("id"), *KEY)
        self._write(numbered, "entity_key", number)
        both = settle(keys.unionByName(self._part("entity_key", number).select("id", *KEY)))
        self._write(first.join(both, KEY).select(F.col("id").alias("key_id"), "row.*"), "entity_version", number)
        end = lambda c: [F.coalesce(F.col(f"{c}.{k}").cast("string"), F.lit("")).alias(f"{c}_{k}") for k in KEY]
        packed = edges.select(*end("from"), *end("to"), "kind", "provenance").groupBy(*[f"{c}_{k}" for c in ("from", "to") for k in KEY], "kind", "provenance").agg(F.count("*").alias("count"))
        for c in ("from", "to"):
            packed = packed.join(both.select(F.col("id").alias(f"{c}_key"), *[F.col(k).alias(f"{c}_{k}") for k in KEY]), [f"{c}_{k}" for k in KEY])
        self._write(packed.select("from_key", "to_key", "kind", "provenance", "count"), "edge_version", number)
        self._commit(number, sha, time)
        return number

    def _part(self, table: str, number: int) -> DataFrame:
        schema = SCHEMAS[table].rpartition(",")[0]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/revision={number}")

    def _commit(self, number: int, sha: str, time: int | None) -> None:
        self._write(self.spark.createDataFrame([(number, sha, time)], "id long, sha string, time long").coalesce(1), "revision", number)

    def versions(self) -> DataFrame:
        """(revision, sha, key_id, module, symbol, disambiguator, kind, is_stub, loc, file)."""
        names = self.table("entity_key").select(F.col("id").alias("key_id"), *KEY)
        shas = self.revisions().select(F.col("id").alias("revision"), "sha")
        return self.table("entity_version").join(names, "key_id").join(F.broadcast(shas), "revision").select("revision", "sha", "key_id", *KEY, "kind", "is_stub", "loc", "file")

    def runs(self) -> DataFrame:
        """(key_id, first, last, kind, loc): revisions in a row in which a key is there with one kind and size."""
        own = Window.partitionBy("key_id").orderBy("revision")
        v = self.table("entity_version").select("key_id", "revision", "kind", "loc")
        same = (F.lag("revision").over(own) == F.col("revision") - 1) & F.lag("kind").over(own).eqNullSafe(F.col("kind")) & F.lag("loc").over(own).eqNullSafe(F.col("loc"))
        run = v.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(own))
        return run.groupBy("key_id", "run").agg(F.min("revision").alias("first"), F.max("revision").alias("last"), F.first("kind").alias("kind"), F.first("loc").alias("loc")).drop("run")


def append_all(store: SnapshotStore, rows: DataFrame, edges: DataFrame) -> list[int]:
    """Append the snapshots in rows and edges, which carry sha and time, in order of time; those that the store has are passed over."""
    held = {r.sha for r in store.revisions().select("sha").collect()}  # a row per snapshot
    shas = [r for r in rows.groupBy("sha").agg(F.max("time").alias("time")).collect() if r.sha not in held]
    shas.sort(key=lambda r: (r.time is None, r.time or 0, r.sha))
    return [store.append(rows.filter(F.col("sha") == r.sha), edges.filter(F.col("sha") == r.sha), r.sha, r.time) for r in shas]


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Append snapshots as they arrive: rows (sha, time, ref, module, symbol, disambiguator, kind, is_stub, loc, file, edges), edges
    being an entity's outgoing (to, kind, provenance). A snapshot comes whole in one batch; a batch that comes again, also
    after a failure in the middle of one, adds only what is not there."""

    def write(batch: DataFrame, _: int) -> None:
        store = SnapshotStore(batch.sparkSession, path)
        held = settle(batch)
        me = F.struct(*KEY)
        edges = held.select("sha", me.alias("from"), F.explode("edges").alias("e")).select("sha", "from", "e.*")
        append_all(store, held.drop("edges"), edges)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def edge_history(store: SnapshotStore) -> DataFrame:
    """(from_key, to_key, kind, provenance, first, last, revisions, count): each edge over the revisions."""
    e = store.table("edge_version")
    return e.groupBy("from_key", "to_key", "kind", "provenance").agg(F.min("revision").alias("first"), F.max("revision").alias("last"), F.count("*").alias("revisions"), F.sum("count").alias("count"))

