"""History reports over commits (commit, author, time, is_fix, is_revert) and changes (commit, path, added, deleted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import settle
from .components import reaches

DAY = 86_400
MOMENTUM_DAYS = 90


def summary(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: commits, authors, paths, span_days, churn, fixes, reverts, momentum (recent pace over that of the whole life)."""
    last = commits.agg(F.max("time").alias("last"), F.min("time").alias("first"))
    c = commits.withColumn("_k", F.lit(1)).join(F.broadcast(last.withColumn("_k", F.lit(1))), "_k")  # one row
    span = (F.max("last") - F.min("first")) / DAY
    recent = F.count_if(F.col("time") > F.col("last") - MOMENTUM_DAYS * DAY)
    head = c.agg(
        F.count("*").alias("commits"),
        F.countDistinct("author").alias("authors"),
        F.round(span, 6).alias("span_days"),
        F.count_if("is_fix").alias("fixes"),
        F.count_if("is_revert").alias("reverts"),
        F.when(span <= MOMENTUM_DAYS, F.lit(1.0)).otherwise(F.round((recent / MOMENTUM_DAYS) / (F.count("*") / span), 6)).alias("momentum"),
    )
    body = changes.agg(F.countDistinct("path").alias("paths"), F.sum(F.col("added") + F.col("deleted")).alias("churn"))
    return head.withColumn("_k", F.lit(1)).join(body.withColumn("_k", F.lit(1)), "_k").drop("_k")


def hotspots(paths: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per path: revisions, added, deleted, churn, fixes, bug_density, authors; paths without changes have zeros."""
    per = (
        changes.join(commits.select("commit", "author", "is_fix"), "commit")
        .groupBy("path")
        .agg(
            F.count("*").alias("revisions"),
            F.sum("added").alias("added"),
            F.sum("deleted").alias("deleted"),
            F.count_if("is_fix").alias("fixes"),
            F.countDistinct("author").alias("authors"),
        )
    )
    out = paths.select("path").distinct().join(per, "path", "left").fillna(0)
    return out.withColumn("churn", F.col("added") + F.col("deleted")).withColumn(
        "bug_density", F.when(F.col("revisions") == 0, F.lit(0.0)).otherwise(F.round(F.col("fixes") / F.col("revisions"), 6))
    )


def _by_author(commits: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(commits.select("commit", "author"), "commit").groupBy("path", "author").agg(F.sum("added").alias("added"), F.count("*").alias("revisions"))


def file_owners(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, owner, share): the author who added most, ties to the smaller; none where nothing was added."""
    return (
        _by_author(commits, changes)
        .groupBy("path")
        .agg(F.max_by("author", F.struct("added", -F.col("author"))).alias("owner"), F.max("added").alias("best"), F.sum("added").alias("total"))
        .filter("best > 0 AND total > 0")
        .select("path", "owner", F.round(F.col("best") / F.col("total"), 6).alias("share"))
    )


def author_stats(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per author: commits, added, paths and owns (paths where they added most, also where that is nothing)."""
    by = _by_author(commits, changes)
    owns = by.groupBy("path").agg(F.max_by("author", F.struct("added", -F.col("author"))).alias("author")).groupBy("author").agg(F.count("*").alias("owns"))
    sums = by.groupBy("author").agg(F.sum("added").alias("added"), F.count("*").alias("paths"))
    n = commits.groupBy("author").agg(F.count("*").alias("commits"))
    return n.join(sums, "author", "left").join(owns, "author", "left").fillna(0, ["added", "paths", "owns"])


def bus_factor(authors: DataFrame, n_paths: int) -> DataFrame:
    """One row: the fewest owners that together own over half of the paths.

    Owners are counted by how many paths they own first: the running sum is over distinct counts, not over authors.
    """
    sizes = authors.filter("owns > 0").groupBy("owns").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum(F.col("owns") * F.col("n")).over(Window.orderBy(F.col("owns").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.floor((F.lit(n_paths) / 2 - F.col("before")) / F.col("owns")) + 1
    return sizes.withColumn("before", before).agg(
        F.coalesce(F.sum(F.when(F.col("before") * 2 <= n_paths, F.least(F.col("n"), room))), F.lit(0)).cast("long").alias("bus_factor")
    )


def logical_coupling(changes: DataFrame, min_support: int = 3, min_confidence: float = 0.5, max_changeset: int = 30) -> DataFrame:
    """(a, b, support, confidence): paths that change together; larger changesets add revisions but no support.

    The self-join is inside one commit of at most max_changeset paths, so its rows are bounded by the changes.
    """
    paths = changes.select("commit", "path").distinct()
    revisions = paths.groupBy("path").agg(F.count("*").alias("revisions"))
    sets = paths.groupBy("commit").agg(F.count("*").alias("n")).filter(F.col("n").between(2, max_changeset)).select("commit")
    small = paths.join(sets, "commit", "left_semi")
    right = small.select(F.col("commit").alias("c2"), F.col("path").alias("b"))
    pairs = small.select("commit", F.col("path").alias("a")).join(right, (F.col("commit") == F.col("c2")) & (F.col("a") < F.col("b")))
    support = pairs.groupBy("a", "b").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)
    ra = revisions.select(F.col("path").alias("a"), F.col("revisions").alias("ra"))
    rb = revisions.select(F.col("path").alias("b"), F.col("revisions").alias("rb"))
    confidence = F.col("support") / F.greatest(F.least("ra", "rb"), F.lit(1))
    out = support.join(ra, "a").join(rb, "b").withColumn("confidence", confidence).filter(F.col("confidence") >= min_confidence)
    return out.select("a", "b", "support", F.round("confidence", 6).alias("confidence"))


def path_join(model_paths: DataFrame, history_paths: DataFrame) -> DataFrame:
    """(model_path, history_path): paths where one is a suffix of the other at a '/', if that is unique on both sides."""

    def suffixes(df: DataFrame, name: str) -> DataFrame:
        parts = F.split("path", "/")
        each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        return df.select(F.col("path").alias(name), F.explode(each).alias("suffix"))

    whole_h, whole_m = history_paths.select(F.col("path").alias("history_path")), model_paths.select(F.col("path").alias("model_path"))
    one = suffixes(model_paths, "model_path").join(whole_h, F.col("suffix") == F.col("history_path")).select("model_path", "history_path")
    two = suffixes(history_paths, "history_path").join(whole_m, F.col("suffix") == F.col("model_path")).select("model_path", "history_path")
    pairs = one.union(two).distinct()
    m = pairs.groupBy("model_path").agg(F.count("*").alias("nm")).filter("nm = 1").select("model_path")
    h = pairs.groupBy("history_path").agg(F.count("*").alias("nh")).filter("nh = 1").select("history_path")
    return pairs.join(m, "model_path", "left_semi").join(h, "history_path", "left_semi").select("model_path", "history_path")


def file_dependencies(edges: DataFrame, places: DataFrame, declared_only: bool = True) -> DataFrame:
    """(from, to, count): edges (file, to, provenance) from their file to the file of their target (places: id, file); edges inside
    a file, or to what has no file, are none."""
    kept = edges.filter("provenance = 'declared'") if declared_only else edges
    targets = places.filter("file IS NOT NULL").select(F.col("id").alias("to"), F.col("file").alias("target"))
    met = kept.select(F.col("file").alias("from"), "to").join(targets, "to").filter("`from` <> target")
    return met.groupBy("from", F.col("target").alias("to")).agg(F.count("*").alias("count"))


def hidden_coupling(coupled: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Co-changing pairs (a, b) without a way of dependencies (from, to) in either direction; only those pairs are asked for."""
    pairs = settle(coupled)
    files = dependencies.select(F.explode(F.array("from", "to")).alias("id")).distinct()
    asked = pairs.select("a", "b").union(pairs.select("b", "a"))
    found = settle(reaches(files, dependencies, asked))
    back = found.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(found, ["a", "b"], "left_anti").join(back, ["a", "b"], "left_anti")


def dead_weight(file_edges: DataFrame, coupled: DataFrame) -> DataFrame:
    """Declared dependencies between paths (a < b) that never change together."""
    e = file_edges.filter(F.col("from") != F.col("to")).select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).distinct()
    return e.join(coupled.select("a", "b"), ["a", "b"], "left_anti")


def running_size(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """(path, time, commit, size): lines per path after each change, never below zero."""
    steps = changes.join(commits.select("commit", "time"), "commit").withColumn("step", F.col("added") - F.col("deleted"))
    w = Window.partitionBy("path").orderBy("time", "commit").rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.withColumn("s", F.sum("step").over(w))
    return summed.select("path", "time", "commit", (F.col("s") - F.least(F.min("s").over(w), F.lit(0))).alias("size"))
