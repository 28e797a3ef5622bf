"""Side-cars and word lists: history metrics, insight records, business terms, technical words, source slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_METRICS = "path string, key struct<lang:string,module:string,symbol:string,disambiguator:string>, vcs map<string,double>"
_INSIGHT = "id string, level string, concept string, confidence double, fingerprint string, seq long, words array<struct<word:string,concern:string,sense:string>>"


def _typed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get_json_object("value", "$.t").alias("t"), "value")


def read_history_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files (path, key, value), entities (lang, module, symbol, disambiguator, key, value)) in long form."""
    rows = _typed(spark, path).select("t", F.from_json("value", _METRICS).alias("r"))
    files = rows.filter("t = 'f'").select(F.col("r.path").alias("path"), F.explode("r.vcs").alias("key", "value"))
    entities = rows.filter("t = 'e'").select("r.key.*", F.explode("r.vcs").alias("metric", "value"))
    return files, entities


def first_wins(frames: list[DataFrame]) -> DataFrame:
    """Files' metrics of several side-cars: the first that has a path gives all of it."""
    both = None
    for k, f in enumerate(frames):
        f = f.withColumn("_k", F.lit(k))
        both = f if both is None else both.unionByName(f)
    least = both.groupBy("path").agg(F.min("_k").alias("_k"))
    return both.join(least, ["path", "_k"], "left_semi").drop("_k")


def read_insights(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(insights, words) of a side-car or journal; a torn last line is dropped."""
    rows = spark.read.text(path).select(F.from_json("value", _INSIGHT).alias("r")).filter("r.id IS NOT NULL").select("r.*")
    return rows.drop("words"), rows.select("id", F.explode("words").alias("w")).select("id", "w.*")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(business): one term a line; # begins a comment; blank lines and repeats go."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("business")).filter("business <> ''").dropDuplicates()


def read_words(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(words, invalid): lower-case words of letters and digits, and the lines that are none."""
    rows = spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("word")).filter("word <> ''")
    good = F.col("word").rlike(r"^[\p{L}\p{N}]+$")
    return rows.filter(good).distinct(), rows.filter(~good)


def source_slices(spark: SparkSession, folder: str, anchors: DataFrame) -> DataFrame:
    """(id, text) of anchors (id, file, start, end): their lines of the files under folder."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    root = F.lit(folder.rstrip("/") + "/")
    files = files.withColumn("file", F.element_at(F.split("path", root), -1))
    hit = anchors.join(files, "file")
    return hit.select("id", F.array_join(F.slice(F.split("value", "\n"), F.col("start"), F.col("end") - F.col("start") + 1), "\n").alias("text"))
