"""The city of a history: a plot for every file that ever was, and its height at every commit.

Scales are frozen over the whole run of time, so a height means the same at any tick. A file's size is the running sum of its line
deltas, never below zero; a frame holds until the file's next one. Ticks are the commits by time, then name, from 0 on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up, scale_value
from ..plans.fixpoint import settle
from ..plans.order import positions
from .history import running_size

#: City units of heights and of the sides of plots.
HEIGHT, FOOTPRINT = (1.0, 40.0), (2.0, 20.0)

#: Ticks that one question may name.
ASKED = 10_000


def ticks(commits: DataFrame) -> DataFrame:
    """(commit, tick, time, author, is_fix)."""
    rows = commits.select("commit", "time", "author", F.coalesce("is_fix", F.lit(False)).alias("is_fix"))
    return positions(rows, ["time", "commit"], "n").select("commit", (F.col("n") - 1).alias("tick"), "time", "author", "is_fix")


def sizes(commits: DataFrame, changes: DataFrame, clock: DataFrame) -> DataFrame:
    """(path, tick, loc, churn): a row per change."""
    run = running_size(changes, commits).select("path", "commit", "size")
    churn = changes.select("path", "commit", (F.col("added") + F.col("deleted")).alias("churn"))
    return run.join(churn, ["path", "commit"]).join(clock.select("commit", "tick"), "commit").select("path", "tick", F.col("size").alias("loc"), "churn")


def buildings(rows: DataFrame) -> DataFrame:
    """(path, height, side, loc, peak, revisions, churn): each file's plot by its peak, its height at the end. rows: sizes()."""
    per = settle(rows.groupBy("path").agg(F.max_by("loc", "tick").alias("loc"), F.max("loc").alias("peak"), F.count("*").alias("revisions"), F.sum("churn").alias("churn")))
    domain = per.agg(F.max("peak").cast("double").alias("hi"), F.min("peak").cast("double").alias("lo"))  # one row
    side = round_half_up(scale_value(F.col("peak").cast("double"), F.col("lo"), F.col("hi"), FOOTPRINT, "sqrt"))
    return per.crossJoin(F.broadcast(domain)).select("path", _height(F.col("loc"), F.col("hi")).alias("height"), side.alias("side"), "loc", "peak", "revisions", "churn")


def _height(loc, top):
    return F.when(loc <= 0, F.lit(0.0)).otherwise(round_half_up(scale_value(loc.cast("double"), F.lit(0.0), top, HEIGHT, "linear")))


def frames(rows: DataFrame) -> DataFrame:
    """(path, tick, height, heat): a frame per change; heat is 1 while the file lives, 0 at its end."""
    top = rows.agg(F.max("loc").cast("double").alias("hi"))  # one row
    return rows.crossJoin(F.broadcast(top)).select("path", "tick", _height(F.col("loc"), F.col("hi")).alias("height"), (F.col("loc") > 0).cast("int").alias("heat"))


def state_at(keyframes: DataFrame, at: DataFrame) -> DataFrame:
    """(at, path, height, since): the frame that holds at each asked tick (at), of files that have begun by then.

    A frame is turned into the interval that it holds for, so a file meets each asked tick once. At most ASKED ticks.
    """
    asked = settle(at.select("at").distinct())
    if asked.count() > ASKED:
        raise ValueError(f"over {ASKED} ticks are asked for at once")
    until = F.lead("tick").over(Window.partitionBy("path").orderBy("tick"))
    held = keyframes.select("path", "height", F.col("tick").alias("since"), until.alias("until"))
    return held.join(F.broadcast(asked), (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))).select("at", "path", "height", "since")


def arcs(pairs: DataFrame, raised: DataFrame) -> DataFrame:
    """(a, b, support, confidence) between buildings, from co-changing files (a, b, support, confidence) and the buildings that
    each file raises (file, building): the strongest pair of files counts, a building has no arc to itself."""
    x, y = (raised.select(F.col("file").alias(c), F.col("building").alias(f"b{c}")) for c in ("a", "b"))
    met = pairs.join(x, "a").join(y, "b").filter("ba <> bb")
    best = F.max(F.struct("support", "confidence"))
    return met.groupBy(F.least("ba", "bb").alias("a"), F.greatest("ba", "bb").alias("b")).agg(best.alias("m")).select("a", "b", "m.support", "m.confidence")
