"""Host-level quality rules: text rules fail documents, failures add up by host, and hosts' shrunken rates come back to documents.

DataFrame operations only. Two passes over the documents' counts: one that sums failures by host (partial sums
on the map side, so a host with a third of all rows is no hot task), one that joins the verdicts back.

Defined results: null or empty texts have no words, so every count is 0 and the base rule fails them. A null host
is a host of its own. Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, let, n_words, table, words

#: Rule parameters.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SOFT_SYMBOL_PERCENT = 10
SOFT_DUP_LINES = 3
HOST_LIMIT = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(w: Column, n: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur twice or more in the array w of n words.

    Texts without a repeated window (nearly all) stop at a distinct count; for the others the windows are sorted by
    hash, equal neighbours give the repeated positions, and their covers add up without overlap.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def at(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True),
            )
            positions = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return F.aggregate(
                positions,
                F.struct(F.lit(-width).alias("last"), F.lit(0).alias("sum")),
                lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(width), x - a["last"])).alias("sum")),
                lambda a: a["sum"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(by_hash, at))

    def hashed(arr: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(arr) - F.lit(width)),
            lambda i: F.xxhash64(*[F.get(arr, i + k) for k in range(width)]),
        )

    return F.when(n < width, F.lit(0)).otherwise(let(hashed(w), covered)).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the five counts under fresh names, and the map from count to name."""
    w = fresh(docs, "_words")
    out = docs.withColumn(w, words(F.col(text)))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n")
    names = {c: fresh(docs, f"_{c}") for c in COUNTS}
    n = n_words(F.col(w))
    made = {
        "n_words": n,
        "word_chars": F.length(F.array_join(F.col(w), "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": let(
            F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x))
        ).cast("long"),
        "n_repeat_words": repeat_words(F.col(w), n),
    }
    # Through a one-row generator: filters on the counts then stay above it and are not evaluated with the word array inlined.
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(*[made[c].alias(names[c]) for c in COUNTS]))))
    return out, names


def base_failed(names: dict[str, str]) -> Column:
    return (F.col(names["n_words"]) < MIN_WORDS) | (
        F.col(names["n_repeat_words"]) * 100 > F.col(names["n_words"]) * MAX_REPEAT_PERCENT
    )


def soft_failed(names: dict[str, str]) -> Column:
    """Rules that count against a host and, in a rejected host, against the document."""
    n = F.col(names["n_words"])
    return (F.col(names["n_symbols"]) * 100 > n * SOFT_SYMBOL_PERCENT) | (F.col(names["n_dup_lines"]) >= SOFT_DUP_LINES)


def host_verdicts(flags: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n, failures, rate, rejected): failure rates shrunk to the hosts' beta prior.

    The prior comes from the hosts' raw rates by the method of moments; where they do not vary, it counts as
    one document at the mean rate. A host is rejected when its shrunken rate is over HOST_LIMIT.
    """
    key = F.lit(1)
    hosts = flags.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures")
    )
    hosts = hosts.withColumn("_k", key).withColumn("_p", F.col("failures") / F.col("n"))
    prior = hosts.groupBy("_k").agg(F.avg("_p").alias("_m"), F.var_pop("_p").alias("_v"))  # one row
    total = F.when(
        (F.col("_v") > 0) & (F.col("_m") * (1 - F.col("_m")) > F.col("_v")), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1
    ).otherwise(F.lit(1.0))
    rate = (F.col("failures") + F.col("_m") * total) / (F.col("n") + total)
    return hosts.join(F.broadcast(prior), "_k").select("host", "n", "failures", rate.alias("rate"), (rate > HOST_LIMIT).alias("rejected"))


def host_rules(spark: SparkSession, docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, host_rate and kept. The counts are written once and read twice."""
    counted, names = with_counts(docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("text")))
    flags = cut(
        counted.select("doc_id", "host", *[F.col(names[c]).alias(c) for c in COUNTS])
        .withColumn("base_failed", base_failed({c: c for c in COUNTS}))
        .withColumn("soft_failed", soft_failed({c: c for c in COUNTS}))
        .withColumn("any_failed", F.col("base_failed") | F.col("soft_failed")),
        "rule-counts",
    )
    verdicts = host_verdicts(flags, "host", "any_failed").select(F.col("host").alias("_host"), "rate", "rejected")
    return flags.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).select(
        "doc_id",
        *COUNTS,
        "base_failed",
        (~F.col("base_failed") & ~(F.col("rejected") & F.col("soft_failed"))).alias("kept"),
        F.round("rate", 6).alias("host_rate"),
    )


def filter_documents(spark: SparkSession, docs: DataFrame, host: str = "source") -> DataFrame:
    """docs without the rows that the base rules, or the rules of a rejected host, fail; columns as they were."""
    slim = docs.select(F.col(host).alias("host"), F.col("text").alias("text"), F.xxhash64("text").alias("th"), F.length("text").alias("size"))
    counted, names = with_counts(slim)
    flagged = counted.select("host", "th", "size", base_failed(names).alias("base"), soft_failed(names).alias("soft"))
    # Counted once: a verdict depends on host and text only, so their flags are written and rejected ones joined back.
    flagged = cut(flagged, "flagged")
    verdicts = host_verdicts(flagged.select("host", (F.col("base") | F.col("soft")).alias("any_failed")), "host", "any_failed")
    bad = flagged.filter("base OR soft").join(verdicts.select(F.col("host").alias("_host"), "rejected"), F.col("host").eqNullSafe(F.col("_host")))
    bad = cut(bad.filter("base OR rejected").select("host", "th", "size").distinct(), "rejected")
    h, t, n = (fresh(docs, x) for x in ("_host", "_th", "_size"))
    bad = bad.select(F.col("host").alias(h), F.col("th").alias(t), F.col("size").alias(n))
    same = F.col(host).eqNullSafe(F.col(h)) & (F.xxhash64("text") == F.col(t)) & F.length("text").eqNullSafe(F.col(n))
    return docs.join(bad, same, "left_anti")


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(spark, table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), k AS (
  SELECT doc_id, host, row_number() OVER () AS rid, w, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT rid, i, hash(w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS h
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM k WHERE len(w) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS c FROM win) WHERE c > 1
), cover AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM twice) GROUP BY rid
), f AS (
  SELECT doc_id, host, n_words, word_chars, n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM k LEFT JOIN cover c USING (rid)
), g AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         (n_symbols * 100 > n_words * 10 OR n_dup_lines >= 3) AS soft_failed FROM f
), h AS (
  SELECT host, count(*) AS n, sum((base_failed OR soft_failed)::INT) AS bad FROM g GROUP BY host
), m AS (
  SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h
), r AS (
  SELECT host, (bad + m * t) / (n + t) AS rate
  FROM h, (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 1.0 END AS t FROM m)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (rate > 0.5 AND soft_failed)) AS kept, round(rate, 6) AS host_rate
FROM g JOIN r ON g.host IS NOT DISTINCT FROM r.host
"""
