"""Repository addresses and day and percent formats as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_remote(url: Column) -> Column:
    """https address of a remote: scp-like and ssh forms rewritten, credentials, a final .git and slashes dropped."""
    c = F.trim(url)
    c = F.regexp_replace(c, r"^(?:ssh://)?[^@/\s]+@([^:/\s]+)[:/]", "https://$1/")
    c = F.regexp_replace(c, r"^(?:git|http)://", "https://")
    c = F.regexp_replace(c, r"^https://[^@/]+@", "https://")
    return F.regexp_replace(c, r"(?:\.git)?/*$", "")


def provider(url: Column) -> Column:
    """The host's first known name, else null."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/]+)", 1))
    known = [("github", "github"), ("gitlab", "gitlab"), ("bitbucket", "bitbucket")]
    out = F.lit(None).cast("string")
    for part, name in reversed(known):
        out = F.when(F.contains(host, F.lit(part)), name).otherwise(out)
    return out


def day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit(" %"))
