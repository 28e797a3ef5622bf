"""Entity models as JSON lines: header, files, entities, edges, end; read into frames and written back.

Reading is a text scan and one from_json per record kind, so files split over tasks; surrogate numbers are joined away
inside one file and natural keys come out. Lines that are no records, and sections that are out of step with the
end record's counts, come out as findings instead of failing the whole load.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import render_id, u16

_HEADER = "schemaVersion string, lang string, root string, dict struct<kinds:array<string>,traits:array<string>,edges:array<string>,provenance:array<string>>"
_FILE = "i int, path string"
_ENTITY = "i int, k int, tr array<int>, m int, s string, d string, name string, anchor array<int>, parent int, attachedTo int, isStub boolean, declaredType int, signature string, metrics map<string,double>"
_EDGE = "k int, f int, o int, p int, anchor array<int>, candidates array<int>, isRead boolean, isWrite boolean"
_END = "counts struct<files:bigint,entities:bigint,edges:bigint>"


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, t, value): every non-empty line with its record kind; null where the line is no record."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.trim("value") != "")
    return raw.select("path", F.get_json_object("value", "$.t").alias("t"), "value")


def _records(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    return lines.filter(F.col("t") == kind).select("path", F.from_json("value", schema).alias("r")).select("path", "r.*")


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return re.sub("^file:/+", "file:/", whole.getPath() if whole.getScheme() is None else f"{whole.getScheme()}:{'//' + whole.getAuthority() if whole.getAuthority() else ''}{whole.getPath()}")


def read_models(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, findings) of all files; model_index follows the order of paths."""
    lines = read_lines(spark, paths)
    headers = _records(lines, "header", _HEADER)
    # One row per file; files of a folder or pattern come after those that are named, by path.
    named = F.array_position(F.array(*[F.lit(_qualified(spark, p)) for p in paths]), F.regexp_replace("path", "^file:/+", "file:/"))
    order = F.dense_rank().over(Window.orderBy(F.coalesce(F.when(named > 0, named), F.lit(len(paths) + 1)), "path")) - 1
    headers = headers.select("path", "lang", "dict", order.alias("model_index"))
    raw = _records(lines, "e", _ENTITY).join(headers, "path")
    pick = lambda names, i: F.get(F.col(f"dict.{names}"), i)
    base = raw.select(
        "path", "model_index", "i", "lang", "m", F.col("s").alias("symbol"), F.col("d").alias("disambiguator"), "parent", "attachedTo", "declaredType", "name", "anchor", "metrics",
        pick("kinds", F.col("k")).alias("kind"), F.transform("tr", lambda t: pick("traits", t)).alias("traits"), F.col("isStub").alias("is_stub"),
    )
    module = base.select(F.col("path").alias("mp"), F.col("i").alias("mi"), F.col("symbol").alias("module"))
    keyed = base.join(module, (F.col("path") == F.col("mp")) & (F.coalesce("m", "i") == F.col("mi")))
    own = F.when(F.col("m") == F.col("i"), F.lit("")).otherwise(F.col("symbol"))
    keyed = keyed.withColumn("id", render_id(F.col("lang"), F.col("module"), own, F.col("disambiguator")))
    ids = keyed.select(F.col("path").alias("ip"), F.col("i").alias("ii"), F.col("id").alias("ref_id"))

    def resolve(df: DataFrame, number: str, to: str) -> DataFrame:
        r = ids.select(F.col("ip"), F.col("ii"), F.col("ref_id").alias(to))
        return df.join(r, (F.col("path") == F.col("ip")) & (F.col(number) == F.col("ii")), "left").drop("ip", "ii")

    entities = resolve(resolve(resolve(keyed.withColumnRenamed("parent", "_p"), "_p", "parent"), "attachedTo", "attached_to"), "declaredType", "declared_type")
    paths_of = lines.filter("t = 'f'").select(F.col("path").alias("fp"), F.from_json("value", _FILE).alias("r")).select("fp", F.col("r.i").alias("fi"), F.col("r.path").alias("file"))
    anchored = lambda df: df.join(paths_of, (F.col("path") == F.col("fp")) & (F.get("anchor", F.lit(0)) == F.col("fi")), "left").withColumn(
        "anchor", F.when(F.col("anchor").isNotNull(), F.struct("file", F.get("anchor", F.lit(1)).alias("start"), F.get("anchor", F.lit(2)).alias("end")))
    )
    entities = anchored(entities).select("model_index", F.col("i").cast("long").alias("ref"), "id", "lang", "module", F.col("symbol"), "disambiguator", "kind", "traits", "name", "parent", "attached_to", "declared_type", "is_stub", "anchor", "metrics")
    e = _records(lines, "x", _EDGE).join(headers, "path")
    e = anchored(resolve(resolve(e, "f", "from"), "o", "to"))
    edges = e.select("model_index", pick("edges", F.col("k")).alias("edge"), "from", "to", pick("provenance", F.col("p")).alias("provenance"), "anchor", F.col("isRead").alias("is_read"), F.col("isWrite").alias("is_write"))
    counted = lines.groupBy("path").agg(*[F.count_if(F.col("t") == t).alias(n) for t, n in (("f", "files"), ("e", "entities"), ("x", "edges"))])
    ends = _records(lines, "eof", _END)
    wrong = counted.join(ends, "path", "left").withColumn(
        "detail",
        F.when(F.col("counts").isNull(), "no end record").when(
            (F.col("counts.files") != F.col("files")) | (F.col("counts.entities") != F.col("entities")) | (F.col("counts.edges") != F.col("edges")), "counts differ from the end record"
        ),
    )
    broken = lines.filter("t IS NULL").select("path", F.concat(F.lit("no record: "), F.substring("value", 1, 80)).alias("detail"))
    return entities, edges, wrong.filter("detail IS NOT NULL").select("path", "detail").union(broken)


def write_model(entities: DataFrame, edges: DataFrame, lang: str, path: str) -> None:
    """One model as JSON lines in canonical order, in one file: a model is one extraction run."""
    keys = [u16(F.col("lang")), u16(F.col("module")), u16(F.coalesce("symbol", F.lit(""))), u16(F.coalesce("disambiguator", F.lit("")))]
    numbered = entities.withColumn("i", F.row_number().over(Window.orderBy(*keys)) - 1)
    lists = entities.agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("traits")))).alias("traits"))
    kinds = edges.agg(F.array_sort(F.collect_set("edge")).alias("edges"), F.array_sort(F.collect_set("provenance")).alias("provenance"))
    k1, k2 = lists.first(), kinds.first()  # closed vocabularies
    place = lambda names, c: F.array_position(F.array(*[F.lit(x) for x in names]), c).cast("int") - 1
    number = numbered.select(F.col("id").alias("nid"), F.col("i").alias("n"))
    find = lambda df, c, to: df.join(number.select(F.col("nid").alias(c), F.col("n").alias(to)), c, "left")
    modules = numbered.filter(F.coalesce("symbol", F.lit("")) == "").select("module", F.col("i").alias("m"))
    e = find(numbered.join(modules, "module", "left"), "parent", "pn")
    line = F.to_json(F.struct(F.lit("e").alias("t"), "i", place(k1.kinds, F.col("kind")).alias("k"), F.transform("traits", lambda t: place(k1.traits, t)).alias("tr"), F.coalesce("m", "i").alias("m"), F.when(F.coalesce("symbol", F.lit("")) == "", F.col("module")).otherwise(F.col("symbol")).alias("s"), F.col("disambiguator").alias("d"), "name", F.col("pn").alias("parent"), F.col("is_stub").alias("isStub")))
    rows_e = e.select(F.lit(2).alias("part"), F.col("i").cast("long").alias("n"), F.lit(0).alias("n2"), line.alias("value"))
    x = find(find(edges, "from", "f"), "to", "o").withColumn("k", place(k2.edges, F.col("edge"))).withColumn("p", place(k2.provenance, F.col("provenance")))
    rows_x = x.select(F.lit(3).alias("part"), F.col("f").cast("long").alias("n"), F.col("o").alias("n2"), F.to_json(F.struct(F.lit("x").alias("t"), "k", "f", "o", "p", F.col("is_read").alias("isRead"), F.col("is_write").alias("isWrite"))).alias("value"))
    spark = entities.sparkSession
    counts = {"files": 0, "entities": entities.count(), "edges": edges.count()}
    head = {"t": "header", "schemaVersion": "1.0.0", "lang": lang, "extractor": {"name": "terracefold", "version": "1"}, "root": "", "dict": {"kinds": k1.kinds, "traits": k1.traits, "edges": k2.edges, "provenance": k2.provenance}}
    ends = spark.createDataFrame([(0, 0, 0, json.dumps(head)), (4, 0, 0, json.dumps({"t": "eof", "counts": counts}))], "part int, n long, n2 int, value string")
    rows_e.union(rows_x).union(ends).orderBy("part", "n", "n2", "value").coalesce(1).select("value").write.text(path)
