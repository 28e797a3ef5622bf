"""Fixpoint loops: each round's table is cut from its lineage in the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "terracefold-shared")


def settle(df: DataFrame) -> DataFrame:
    """df written to and read from the shared folder: survives the loss of executors and ends the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/settled-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return out


#: Where settle() notes its tables while kept_only() runs.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _let_go(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go: Spark deletes them when the driver's JVM collects their frames."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept_only(spark: SparkSession, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """What make() returns, all of it settled tables; the other tables settled on the way, and shuffles, go from the disk."""
    token = _noted.set([])
    try:
        kept = make()
        noted = _noted.get()
    finally:
        _noted.reset(token)
    at = {d._settled_at for d in kept}
    for path in noted:
        if path not in at:
            _delete(spark, path)
    if (outer := _noted.get()) is not None:
        outer.extend(at)
    _let_go(spark)
    return kept


@contextmanager
def tasks(spark: SparkSession, n: int):
    """Shuffles that run inside have n partitions at least, so that tasks of large tables stay small; joins stay Spark's to plan."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(n, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled_in_turn(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps applied to df one after another, each settled: when one is, the table and the shuffles before it go from the disk.

    No step may keep a frame of an earlier one. Spark deletes shuffle files when the driver's JVM collects their frames.
    """
    spark = df.sparkSession
    for step in steps:
        old, df = df, settle(step(df))
        if hasattr(old, "_settled_at") and step is not steps[0]:
            _delete(spark, old._settled_at)
        del old
        _let_go(spark)
    return df


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], object] | None = None) -> DataFrame:
    """Apply step until measure (by default the number of rows) no longer changes."""
    measure = measure or (lambda d: d.count())
    now = settle(start)
    before = measure(now)
    while True:
        now = settle(step(now))
        after = measure(now)
        if after == before:
            return now
        before = after


def checksum(df: DataFrame) -> tuple:
    """Rows and an order-free hash sum: equal for equal tables."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())
