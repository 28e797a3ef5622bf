"""Shared helpers: tables in the cluster's shared folder, fresh column names, word rules."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java/RE2 class and as characters.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where a local master has none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "terracefold-shared")
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table that cut() wrote; only for tables that no later frame reads."""
    path = getattr(df, "_shared_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go: Spark deletes them when the driver's JVM collects their frames."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; [''] where there is none (see n_words)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.split(trimmed, WS_CLASS + "+")


def n_words(w: Column) -> Column:
    """Number of words in an array of words()."""
    return F.when(F.element_at(w, 1) == "", F.lit(0)).otherwise(F.size(w)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
