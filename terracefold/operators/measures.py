"""History measures of files over a long and a recent window that end at a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import settle

DAY = 86_400
MEASURES = ["age_days", "authors_long", "authors_recent", "bug_fix_commits", "burst", "change_entropy_long", "change_entropy_recent", "churn_long", "churn_recent", "cochange_entropy_long", "cochange_entropy_recent", "commits_long", "commits_recent", "last_modified_days", "ownership_top_share", "revert_commits"]


def entropy(total: Column, of_logs: Column) -> Column:
    """Bits of a distribution of counts n, from their sum and the sum of n * log2(n); 0 without any."""
    return F.when(total > 0, F.greatest(F.log2(total) - of_logs / total, F.lit(0.0))).otherwise(F.lit(0.0))


def _n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def file_measures(commits: DataFrame, changes: DataFrame, as_of: int, long_days: int = 365, recent_days: int = 90, max_changeset: int = 30) -> DataFrame:
    """(path, MEASURES...) of files that changed in the long window, the days before as_of (Unix seconds; later commits do not count).

    change_entropy: the mean, over the file's commits, of the entropy of how a commit's changed lines spread over its files.
    cochange_entropy: the entropy of how the file's co-changes spread over other files; commits of over max_changeset files,
    which say nothing about any pair, add none. ownership_top_share: the top author's share of changed lines. Files of
    commits that are not in commits are left out. Sums per commit, author and pair combine before the shuffle; only pairs
    inside one commit of bounded size are joined.
    """
    c = commits.select("commit", "author", "time", F.coalesce("is_fix", F.lit(False)).alias("is_fix"), F.coalesce("is_revert", F.lit(False)).alias("is_revert"))
    c = c.filter((F.col("time") <= as_of) & (F.col("time") > as_of - long_days * DAY)).withColumn("recent", F.col("time") > as_of - recent_days * DAY)
    lines = F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))
    merged = changes.groupBy("commit", "path").agg(F.sum(lines).alias("churn"))
    rows = settle(merged.join(c, "commit"))
    spread = rows.groupBy("commit").agg(F.sum("churn").alias("t"), F.sum(_n_log_n(F.col("churn"))).alias("l"), F.count("*").alias("files"))
    spread = spread.select("commit", entropy(F.col("t"), F.col("l")).alias("h"), "files")
    rows = settle(rows.join(spread, "commit"))
    recent = lambda e: F.when(F.col("recent"), e)
    ratio = lambda a, b: F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), 6)
    days = lambda t: F.round((F.lit(as_of) - t) / DAY, 6)
    mean = lambda e: F.round(F.coalesce(F.avg(e), F.lit(0.0)), 6)
    base = rows.groupBy("path").agg(
        days(F.min("time")).alias("age_days"),
        days(F.max("time")).alias("last_modified_days"),
        F.count("*").alias("commits_long"),
        F.count_if("recent").alias("commits_recent"),
        F.count_if("is_fix").alias("bug_fix_commits"),
        F.count_if("is_revert").alias("revert_commits"),
        F.sum("churn").alias("churn_long"),
        F.coalesce(F.sum(recent(F.col("churn"))), F.lit(0)).alias("churn_recent"),
        mean(F.col("h")).alias("change_entropy_long"),
        mean(recent(F.col("h"))).alias("change_entropy_recent"),
    )
    by = rows.groupBy("path", "author").agg(F.sum("churn").alias("churn"), F.max("recent").alias("recent"))
    who = by.groupBy("path").agg(F.count("author").alias("authors_long"), F.count_if(F.col("recent") & F.col("author").isNotNull()).alias("authors_recent"), ratio(F.max("churn"), F.sum("churn")).alias("ownership_top_share"))
    few = rows.filter(F.col("files").between(2, max_changeset)).select("commit", "path", "recent")
    other = few.select(F.col("commit").alias("k"), F.col("path").alias("other"))
    met = few.join(other, (F.col("commit") == F.col("k")) & (F.col("path") != F.col("other"))).groupBy("path", "other").agg(F.count("*").alias("n"), F.count_if("recent").alias("r"))
    ripple = met.groupBy("path").agg(
        F.round(entropy(F.sum("n"), F.sum(_n_log_n(F.col("n")))), 6).alias("cochange_entropy_long"),
        F.round(entropy(F.sum("r"), F.sum(_n_log_n(F.col("r")))), 6).alias("cochange_entropy_recent"),
    )
    out = base.join(who, "path").join(ripple, "path", "left").fillna(0.0, ["cochange_entropy_long", "cochange_entropy_recent"])
    return out.withColumn("burst", ratio(F.col("commits_recent"), F.col("commits_long"))).select("path", *MEASURES)


def join_measures(paths: DataFrame, measures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measures of the model's paths, paths of either side without a match): rows join on equal paths."""
    known = paths.select("path").distinct()
    lost = known.join(measures, "path", "left_anti").select("path", F.lit("model").alias("side"))
    extra = measures.join(known, "path", "left_anti").select("path", F.lit("history").alias("side"))
    return measures.join(known, "path", "left_semi"), lost.unionByName(extra)
