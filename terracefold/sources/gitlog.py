"""History from `git log` text and from history.jsonl.

The log is expected with NUL-separated fields per commit and numstat lines after it (see LOG_ARGS). A repository's log is
order-dependent (renames chain backward in time), so each file is parsed as one group; repositories run in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import FIX, REVERT

#: Fixed format: one record per commit that begins with \x01, fields parted by NUL, then numstat lines.
LOG_ARGS = ["log", "--no-merges", "--numstat", "-M", "--format=%x01%H%x00%ae%x00%at%x00%s"]


def parse(raw: str) -> list[dict]:
    """Rows (commit, author, time, subject, path, added, deleted, renamed_from), newest commit first; binary '-' counts 0."""
    rows = []
    for record in raw.split("\x01")[1:]:
        head, _, body = record.partition("\n")
        commit, author, time, subject = (head.split("\x00") + ["", "", "", ""])[:4]
        if not time.lstrip("-").isdigit():
            raise ValueError(f"no commit record: {head[:60]!r}")
        lines = [x for x in body.split("\n") if x.strip()]
        for line in lines or [None]:
            row = {"commit": commit, "author": author, "time": int(time), "subject": subject, "path": None, "added": 0, "deleted": 0, "renamed_from": None}
            if line is not None:
                a, d, path = line.split("\t", 2)
                old, new = renamed(path)
                row |= {"path": new, "added": 0 if a == "-" else int(a), "deleted": 0 if d == "-" else int(d), "renamed_from": old}
            rows.append(row)
    return rows


def renamed(path: str) -> tuple[str | None, str]:
    """(old, new) of numstat's 'a => b' and 'dir/{a => b}/c' spellings."""
    if " => " not in path:
        return None, path
    if "{" in path and "}" in path:
        pre, rest = path.split("{", 1)
        middle, post = rest.split("}", 1)
        old, new = middle.split(" => ", 1)
        return (pre + old + post).replace("//", "/"), (pre + new + post).replace("//", "/")
    old, new = path.split(" => ", 1)
    return old, new


def lineages(rows: list[dict]) -> list[dict]:
    """Rows whose path is the newest name of its file: from new to old, each rename maps its old name onward."""
    now: dict[str, str] = {}
    out = []
    for r in rows:
        path = r["path"]
        if path is not None:
            newest = now.get(path, path)
            if r["renamed_from"]:
                now.pop(path, None)
                now[r["renamed_from"]] = newest
            r = r | {"path": newest}
        out.append(r)
    return out


_SCHEMA = "repo string, commit string, author string, time long, subject string, path string, added long, deleted long, renamed_from string"


def read_logs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(commits, changes) of log files, one per repository; changes are merged by commit and path."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("repo"), "value")

    def run(batches):
        for pdf in batches:
            for repo, raw in zip(pdf["repo"], pdf["value"]):
                out = pd.DataFrame(lineages(parse(raw)), columns=["commit", "author", "time", "subject", "path", "added", "deleted", "renamed_from"])
                out.insert(0, "repo", repo)
                yield out

    rows = files.mapInPandas(run, _SCHEMA)
    return commits_of(rows), merge_changes(rows.filter("path IS NOT NULL"))


def commits_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        "repo", "commit", "author", "time", F.col("subject").rlike(FIX).alias("is_fix"), F.col("subject").rlike(REVERT).alias("is_revert")
    ).distinct()


def merge_changes(rows: DataFrame) -> DataFrame:
    """One row per commit and path: sums, and a former name where there is one."""
    return rows.groupBy("repo", "commit", "path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.min("renamed_from").alias("renamed_from"))


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits, changes) of a history.jsonl: f, c and x records and the header's author dictionary."""
    lines = spark.read.text(path).select(F.get_json_object("value", "$.t").alias("t"), "value")
    part = lambda t, schema: lines.filter(F.col("t") == t).select(F.from_json("value", schema).alias("r")).select("r.*")
    authors = part("header", "dict struct<authors:array<string>>").select(F.posexplode("dict.authors").alias("a", "author"))
    commits = part("c", "i long, h string, a int, ts long, fix boolean, revert boolean").join(authors, "a")
    files = part("f", "i long, path string").select(F.col("i").alias("p"), "path")
    changes = part("x", "c long, p long, a long, d long").join(files, "p").join(commits.select(F.col("i").alias("c"), "h"), "c")
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        commits.select(F.col("h").alias("commit"), "author", F.col("ts").alias("time"), no(F.col("fix")).alias("is_fix"), no(F.col("revert")).alias("is_revert")),
        changes.select(F.col("h").alias("commit"), "path", F.col("a").alias("added"), F.col("d").alias("deleted")),
    )
