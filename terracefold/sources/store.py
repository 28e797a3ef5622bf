"""A graph imported into bucketed tables that later queries, and later sessions, open.

Tables of a store (all Parquet, in the shared folder, so any executor reads them):
  entity    eid, id, kind, traits, name, parent, is_stub, the containers type and module, and inner: bits that say whether the
            entity, its type and its module are internal (no stubs); one row per entity
  edge      source and target (eid), edge, provenance, n: equal edges counted; bucketed and sorted by target
  fold_type, fold_module
            from, to (ids of containers, null where an end has none), edge and provenance as numbers of the store's
            vocabulary, ends_internal, containers_internal, n; bucketed by from, sorted by (from, to)
  node_type, node_module
            id (null: entities without container), entities, internal (those that an internal view keeps)
  vocabulary
            edge kinds and provenances by number

So folding a level, under any view that keeps or drops stubs, provenances and edge kinds, is a scan of buckets and a sum
inside each: the edges are not shuffled. Fan-in is the same over `edge`. Views that ask for more raise UnknownView; fold.fold
answers those from the frames.

Entities and vocabulary are imported first; each other table is written by the first query that needs it, or with the rest where
all are asked for. An import writes under a name of its own and a row into `imports` last; who opens the store takes the least
complete name. A table likewise has a folder of its own and a row in `parts` last, and the least folder counts. So an import that
dies, or two at once, leave nothing half read. A store is found by its fingerprint: paths, sizes and times of the input files.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fold import LEVELS, Folded
from ..operators.views import View, identity_view
from ..plans.fixpoint import settle, shared_folder, tasks

#: Columns that a table is bucketed by, and sorted by in a bucket.
_BUCKETED = {"edge": (["target"], ["target"]), "fold_type": (["from"], ["from", "to"]), "fold_module": (["from"], ["from", "to"])}
TABLES = [*_BUCKETED, *[f"node_{level}" for level in LEVELS]]
#: Edges of a bucket: more buckets than shuffle partitions are made where these would hold more.
EDGES = 4_000_000
_PART = "table string, n int, folder string"


class UnknownView(ValueError):
    """The view asks for what the store's tables do not hold."""


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of names, sizes and times of all files under paths; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", F.col("modificationTime").cast("string"))
    return hashlib.sha256(repr(sorted(map(tuple, files.collect()))).encode()).hexdigest()[:16]


class Store:
    """Open tables of one import."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root, name
        self.parts = {r.table: r for r in sorted(_rows(spark, f"{root}/{name}/parts", _PART), key=lambda r: r.folder, reverse=True)}
        for table in _BUCKETED:
            if table in self.parts:
                self._register(table)
        words = self.table("vocabulary").collect()  # closed vocabularies
        self.kinds = [r.word for r in sorted((r for r in words if r.what == "edge"), key=lambda r: r.number)]
        self.provenances = [r.word for r in sorted((r for r in words if r.what == "provenance"), key=lambda r: r.number)]

    def _catalog(self, table: str) -> str:
        return f"graph_{self.name}_{self.parts[table].folder}"

    def _register(self, table: str) -> None:
        if self.spark.catalog.tableExists(self._catalog(table)):
            return
        part, (keys, order) = self.parts[table], _BUCKETED[table]
        at = f"{self.root}/{self.name}/{part.folder}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(at).schema)
        by = lambda c: ", ".join(f"`{k}`" for k in c)
        self.spark.sql(f"CREATE TABLE `{self._catalog(table)}` ({columns}) USING parquet CLUSTERED BY ({by(keys)}) SORTED BY ({by(order)}) INTO {part.n} BUCKETS LOCATION '{at}'")

    def table(self, table: str) -> DataFrame:
        if table in _BUCKETED:
            return self.spark.table(f"`{self._catalog(table)}`")
        return self.spark.read.parquet(f"{self.root}/{self.name}/{self.parts[table].folder if table in TABLES else table}")

    def entities(self) -> DataFrame:
        """(id, kind, traits, name, parent, is_stub) as imported."""
        return self.table("entity").select("id", "kind", "traits", "name", "parent", "is_stub")

    def edges(self) -> DataFrame:
        """(edge, from, to, provenance, n) as imported, equal edges counted."""
        e = self.table("entity")
        a, b = e.select(F.col("eid").alias("source"), F.col("id").alias("from")), e.select(F.col("eid").alias("target"), F.col("id").alias("to"))
        return self.table("edge").join(a, "source").join(b, "target").select("edge", "from", "to", "provenance", "n")

    def members(self, module: str) -> DataFrame:
        """Entities of one module, itself included."""
        return self.table("entity").filter(F.col("module") == module).select("id", "kind", "name", "parent", "is_stub", "type")

    def fan_in(self, n: int) -> DataFrame:
        """(id, fan_in): the n entities with most incoming edges, ties by id."""
        counts = self.table("edge").groupBy("target").agg(F.sum("n").alias("fan_in"))
        # Ids order ties, so all that tie with the nth are looked up; the least count comes from the sums alone.
        best = counts.orderBy(F.desc("fan_in")).limit(n).agg(F.min("fan_in")).first()[0]
        if best is None:
            return counts.select(F.lit("").alias("id"), "fan_in").limit(0)
        names = self.table("entity").select(F.col("eid").alias("target"), "id")
        return counts.filter(F.col("fan_in") >= best).join(names, "target").select("id", "fan_in").orderBy(F.desc("fan_in"), "id").limit(n)

    def fold(self, level: str, view: View | None = None, kinds: list[str] | None = None, drop_self_loops: bool = False) -> Folded:
        """What fold.fold gives, from the level's sums."""
        view = view or identity_view()
        internal = "internal-only" in view.filters
        for f in view.filters:
            if f not in ("internal-only", "declared-only") and not f.startswith("provenance:"):
                raise UnknownView(f)
        rows = self.table(f"fold_{level}")
        if view.edge is not None:
            wanted = [set(self.provenances if not f.startswith(("declared", "provenance:")) else ["declared"] if f == "declared-only" else f.removeprefix("provenance:").split(",")) for f in view.filters]
            rows = rows.filter(F.col("provenance").isin([i for i, p in enumerate(self.provenances) if all(p in w for w in wanted)]))
        if kinds is not None:
            rows = rows.filter(F.col("edge").isin([i for i, k in enumerate(self.kinds) if k in kinds]))
        kept = rows.filter("ends_internal") if internal else rows
        placed = F.col("from").isNotNull() & F.col("to").isNotNull() & (F.col("containers_internal") if internal else F.lit(True))
        edges = kept.filter(placed)
        if drop_self_loops:
            edges = edges.filter(F.col("from") != F.col("to"))
        mask = lambda c: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c)))
        folded = edges.groupBy("from", "to").agg(F.sum("n").alias("count"), mask("edge").alias("kinds"), mask("provenance").alias("provenances"))
        folded = folded.select("from", "to", "count", _spelled("kinds", self.kinds), _spelled("provenances", self.provenances), (F.col("from") == F.col("to")).alias("self_loop"))
        nodes = self.table(f"node_{level}")
        size = F.col("internal") if internal else F.col("entities")
        alone = nodes.agg(F.sum(F.when(F.col("id").isNull(), F.col("kept" if internal else "entities")).otherwise(F.col("kept") - F.col("internal") if internal else F.lit(0))).alias("n"))
        sums = kept.agg(
            F.coalesce(F.sum(F.when(~placed, F.col("n"))), F.lit(0)).alias("dropped_edges"),
            F.coalesce(F.sum(F.when(placed & (F.lit(not drop_self_loops) | (F.col("from") != F.col("to"))), F.col("n"))), F.lit(0)).alias("folded_edges"),
        )
        one = alone.select(F.coalesce("n", F.lit(0)).alias("unfoldable_entities"), F.lit(1).alias("_k")).join(sums.withColumn("_k", F.lit(1)), "_k").drop("_k")
        shown = nodes.filter(F.col("id").isNotNull()).select("id", size.alias("entities")).filter("entities > 0")
        return Folded(level, view, shown, folded, one)


def _spelled(column: str, words: list[str]):
    """A mask of word numbers as sorted words joined by ';'."""
    order = sorted(range(len(words)), key=lambda i: words[i])
    each = [F.when(F.col(column).bitwiseAND(1 << i) != 0, F.lit(words[i])) for i in order]
    return F.concat_ws(";", *each).alias(column)


def _placed(entities: DataFrame) -> DataFrame:
    """(id, type, module, inner): containers of both levels found in the same doubling rounds, as in fold.places; bit 0 of inner says
    that the entity is no stub, bits 1 and 2 that its type and module are there and none. Only entities that still look are joined."""
    internal = (~F.coalesce("is_stub", F.lit(False))).cast("int")
    hits = {level: F.array_contains("traits", trait) for level, trait in LEVELS.items()}
    inner = reduce(lambda c, k: c + F.when(F.coalesce(hits[k[1]], F.lit(False)), internal * (2 << k[0])).otherwise(0), enumerate(LEVELS), internal)
    jump = entities.select("id", F.col("parent").alias("next"), inner.alias("inner"), *[F.when(hits[level], F.col("id")).alias(level) for level in LEVELS])
    missing = reduce(lambda a, b: a | b, [F.col(level).isNull() for level in LEVELS])
    looks, total, reach = F.col("next").isNotNull() & missing, entities.count(), 1
    while reach <= total and not jump.filter(looks).isEmpty():
        reach *= 2
        hop = jump.select(F.col("id").alias("h"), F.col("next").alias("n2"), F.col("inner").alias("i2"), *[F.col(level).alias(f"{level}_2") for level in LEVELS])
        # What is found further up brings its own bit.
        brought = reduce(lambda c, k: c + F.when(F.col(k[1]).isNull() & F.col(f"{k[1]}_2").isNotNull(), F.col("i2").bitwiseAND(2 << k[0])).otherwise(0), enumerate(LEVELS), F.col("inner"))
        met = jump.filter(looks).join(hop, F.col("next") == F.col("h"), "left")
        met = met.select("id", F.col("n2").alias("next"), brought.alias("inner"), *[F.coalesce(level, f"{level}_2").alias(level) for level in LEVELS])
        jump = settle(jump.filter(~looks).union(met))
    return jump.select("id", *LEVELS, "inner")


def import_graph(entities: DataFrame, edges: DataFrame, root: str, buckets: int | None = None, tables: list[str] = TABLES) -> str:
    """Write the tables of a graph under root and return the import's name. entities: unique ids."""
    spark = entities.sparkSession
    name = uuid.uuid4().hex[:12]
    at = f"{root}/{name}"
    entities = settle(entities.withColumn("eid", F.monotonically_increasing_id()))
    words = edges.groupBy("edge", "provenance").agg(F.count("*").alias("n")).collect()
    found = {"edge": {r.edge for r in words}, "provenance": {r.provenance for r in words}}
    rows = [(what, i, word) for what in found for i, word in enumerate(sorted(found[what] - {None}))]
    if max((i for _, i, _ in rows), default=0) > 62:
        raise ValueError("a vocabulary of over 63 words is not closed")
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r.n for r in words) // EDGES))
    with tasks(spark, n):
        placed = _placed(entities)
        placed = entities.join(placed, "id").select("eid", "id", "kind", "traits", "name", "parent", "is_stub", *LEVELS, "inner")
        placed.sortWithinPartitions("module", "id").write.parquet(f"{at}/entity")
    spark.createDataFrame([*rows, ("buckets", n, None)], "what string, number int, word string").coalesce(1).write.parquet(f"{at}/vocabulary")
    _write_tables(spark, at, edges, tables)
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("append").parquet(f"{root}/imports")
    return name


def _write_tables(spark: SparkSession, at: str, edges: DataFrame, tables: list[str]) -> None:
    """Write these tables of the import at this place. Edges are shuffled once by each end and once into buckets; where several
    tables come from them, the ends are looked up once for all."""
    entity = spark.read.parquet(f"{at}/entity")
    words = spark.read.parquet(f"{at}/vocabulary").collect()
    n = next(r.number for r in words if r.what == "buckets")
    levels = [level for level in LEVELS if f"fold_{level}" in tables]
    for level in LEVELS:
        if f"node_{level}" in tables:
            bit = lambda b: F.col("inner").bitwiseAND(b) == b
            both = 1 | 2 << list(LEVELS).index(level)
            nodes = entity.groupBy(F.col(level).alias("id")).agg(F.count("*").alias("entities"), F.count_if(bit(1)).alias("kept"), F.count_if(bit(both)).alias("internal"))
            _finish(spark, at, f"node_{level}", 0, lambda path, folder, d=nodes: d.write.parquet(path))
    wanted = [*(["edge"] if "edge" in tables else []), *[f"fold_{level}" for level in levels]]
    if not wanted:
        return
    # A row's words and the bits of its ends are one number: 6 bits of provenance (63: null), 6 of edge kind, then inner of both ends.
    number = lambda what: reduce(lambda c, r: c.when(F.col(what) == r.word, r.number), [r for r in words if r.what == what], F.when(F.lit(False), 0)).otherwise(63)
    code, kind, provenance = F.col("code"), F.shiftright("code", 6).bitwiseAND(63), F.col("code").bitwiseAND(63)
    columns = lambda p: [*([F.col("eid").alias(f"{p}_eid")] if "edge" in tables else []), *[F.col(level).alias(f"{p}_{level}") for level in levels]]
    end = lambda p: entity.select(F.col("id").alias(p), *columns(p), F.shiftleft("inner", 12).bitwiseOR(4095).alias("bits"))
    held = lambda d: d.withColumn("code", code.bitwiseAND(F.col("bits"))).drop("bits")
    with tasks(spark, n):
        both = edges.select("from", "to", (number("edge") * 64 + number("provenance") + (7 << 12)).alias("code"))
        for p in ("from", "to"):
            both = held(both.join(end(p), p)).drop(p)
        both = both if len(wanted) == 1 else settle(both)
        for table in wanted:
            keys, order = _BUCKETED[table]
            if table == "edge":
                word = lambda what, c: F.element_at(F.array(*map(F.lit, [r.word for r in sorted((r for r in words if r.what == what), key=lambda r: r.number)] or [None])).cast("array<string>"), F.when(c < 63, c + 1)).alias(what)
                met = both.select(F.col("from_eid").alias("source"), F.col("to_eid").alias("target"), code.bitwiseAND(4095).alias("code")).repartition(n, *keys)
                rows = met.groupBy("source", "target", "code").agg(F.count("*").alias("n")).select("source", "target", word("edge", kind), word("provenance", provenance), "n")
            else:
                level = table.removeprefix("fold_")
                bit = 2 << 12 + list(LEVELS).index(level)
                met = both.select(F.col(f"from_{level}").alias("from"), F.col(f"to_{level}").alias("to"), code.bitwiseAND(4095 | 1 << 12 | bit).alias("code"))
                # Edges between types are nearly all distinct; those between modules are few, and summed before the shuffle.
                met = met.repartition(n, *keys).withColumn("n", F.lit(1).cast("long")) if level == "type" else met.groupBy("from", "to", "code").agg(F.count("*").alias("n")).repartition(n, *keys)
                rows = met.groupBy("from", "to", "code").agg(F.sum("n").alias("n"))
                no = lambda c: F.when(c < 63, c)
                rows = rows.select("from", "to", no(kind).alias("edge"), no(provenance).alias("provenance"), (code.bitwiseAND(1 << 12) != 0).alias("ends_internal"), (code.bitwiseAND(bit) != 0).alias("containers_internal"), "n")
            made = rows.write.bucketBy(n, *keys).sortBy(*order).format("parquet")
            _finish(spark, at, table, n, lambda path, folder, w=made: w.option("path", path).saveAsTable(f"graph_{at.rsplit('/', 1)[1]}_{folder}"))


def _finish(spark: SparkSession, at: str, table: str, n: int, write) -> None:
    folder = f"{table}_{uuid.uuid4().hex[:12]}"
    write(f"{at}/{folder}", folder)
    spark.createDataFrame([(table, n, folder)], _PART).coalesce(1).write.parquet(f"{at}/parts/{folder}")


def _rows(spark: SparkSession, path: str, schema: str) -> list:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _imported(spark: SparkSession, root: str) -> str | None:
    return min((r.name for r in _rows(spark, f"{root}/imports", "name string")), default=None)


def open_store(spark: SparkSession, key: str, make, tables: list[str] = TABLES) -> Store:
    """The store of this key in the shared folder, with these tables; make() gives (entities, edges) where some have not been written."""
    root = f"{shared_folder(spark)}/graph-store/{key}"
    name = _imported(spark, root)
    if name is None:
        import_graph(*make(), root, tables=tables)
        name = _imported(spark, root)
    opened = Store(spark, root, name)
    missing = [t for t in tables if t not in opened.parts]
    if missing:
        _write_tables(spark, f"{root}/{name}", make()[1], missing)
        opened = Store(spark, root, name)
    return opened
