"""Deletion of repeated runs of lines, by winnowing over line hashes.

1. Lines with a word are hashed; a window is the shortest run of lines from some line on that has MIN_WORDS words.
   The line of least hash is the window's fingerprint position, the hash of all its lines the key that positions are
   joined by. A run of MIN_WORDS words that occurs twice contains the same window twice, so it is always found.
2. A window that occurs earlier in its own document points to the nearest such place, else to the first place in
   any document (by doc_id, then position). Each pointer is a diagonal (document, source, shift).
3. Along each diagonal equal lines are matched both ways into maximal runs; lines of runs with MIN_WORDS words go.

DataFrame operations only. A line that thousands of documents share points to one first place, so it gives one row
for each of them and no pairs among them. The first occurrence of a passage always stays.

Defined results: lines compare without white space at their ends; blank lines neither match nor go. A null text
stays null. A null doc_id comes last in order. Rows that repeat doc_id and text are one document and get the same
result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, cut, fresh, let, n_words, table, words

MIN_WORDS = 50
_LAST = 2**63 - 1


def _keys() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64("text")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(did, th, idx, pos, h, nw, before): lines with a word; idx counts them, before has the words that come earlier."""
    did, th = _keys()
    rows = docs.select(did.alias("did"), th.alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select(
        "did", "th", "pos", F.xxhash64(F.btrim("line", F.lit(WS_CHARS))).alias("h"), n_words(words(F.col("line"))).alias("nw")
    ).filter("nw > 0")
    in_order = Window.partitionBy("did", "th").orderBy("pos")
    rows = rows.withColumn("same", F.lag("pos").over(in_order) == F.col("pos")).filter("same IS NULL OR NOT same")  # repeated rows
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "did", "th", F.count("*").over(so_far).alias("idx"), "pos", "h", "nw", (F.sum("nw").over(so_far) - F.col("nw")).alias("before")
    )


def diagonals(lines: DataFrame, min_words: int) -> DataFrame:
    """(did, th, sdid, sth, shift): where windows occur earlier."""
    ahead = Window.partitionBy("did", "th").orderBy("before").rangeBetween(0, min_words - 1)
    windows = lines.select(
        "did",
        "th",
        F.min(F.struct("h", "idx")).over(ahead).getField("idx").alias("at"),
        F.sum("nw").over(ahead).alias("mass"),
        F.xxhash64(F.collect_list("h").over(ahead)).alias("key"),
    ).filter(F.col("mass") >= min_words)
    nearest = Window.partitionBy("did", "th", "key").orderBy("at")
    windows = windows.withColumn("last", F.lag("at").over(nearest)).select("did", "th", "at", "key", "last")
    place = F.struct("did", "th", "at")
    first = (
        windows.groupBy("key")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("key").alias("k"), "first")
    )
    found = windows.join(first, F.col("key") == F.col("k"))
    inside = F.col("last").isNotNull()
    return (
        found.filter(inside | (F.col("first.did") != F.col("did")) | (F.col("first.th") != F.col("th")))
        .select(
            "did",
            "th",
            F.when(inside, F.col("did")).otherwise(F.col("first.did")).alias("sdid"),
            F.when(inside, F.col("th")).otherwise(F.col("first.th")).alias("sth"),
            (F.col("at") - F.when(inside, F.col("last")).otherwise(F.col("first.at"))).alias("shift"),
        )
        .distinct()
    )


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, gone): for each document with repeated runs the positions of their lines."""
    lines = cut(lines_of(docs), "lines")
    diagonal = cut(diagonals(lines, min_words), "diagonals")
    here = diagonal.join(lines, ["did", "th"]).select("did", "th", "sdid", "sth", "shift", "idx", "pos", "h", "nw")
    there = lines.select(F.col("did").alias("d2"), F.col("th").alias("t2"), F.col("idx").alias("i2"), F.col("h").alias("h2"))
    matched = here.join(
        there,
        (F.col("sdid") == F.col("d2"))
        & (F.col("sth") == F.col("t2"))
        & (F.col("idx") - F.col("shift") == F.col("i2"))
        & (F.col("h") == F.col("h2")),
    ).select("did", "th", "sdid", "sth", "shift", "idx", "pos", "nw")
    along = Window.partitionBy("did", "th", "sdid", "sth", "shift")
    runs = matched.withColumn("run", F.col("idx") - F.row_number().over(along.orderBy("idx")))
    mass = F.sum("nw").over(Window.partitionBy("did", "th", "sdid", "sth", "shift", "run"))
    return (
        runs.withColumn("mass", mass)
        .filter(F.col("mass") >= min_words)
        .groupBy("did", "th")
        .agg(F.collect_set("pos").alias("gone"))
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """docs with repeated runs deleted from text, and the name of an added column that counts deleted lines."""
    gone = repeated_lines(docs, min_words)
    did, th = (fresh(docs, x) for x in ("_did", "_th"))
    keys = _keys()
    left = docs.withColumn(did, keys[0]).withColumn(th, keys[1])
    g, n = fresh(docs, "_gone"), fresh(docs, "_removed")
    gone = gone.select(F.col("did").alias(did + "2"), F.col("th").alias(th + "2"), F.col("gone").alias(g))
    joined = left.join(gone, (F.col(did) == F.col(did + "2")) & (F.col(th) == F.col(th + "2")), "left")

    def rest(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(g))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col(g).isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    out = joined.withColumn("text", text).withColumn(n, F.when(F.col(g).isNull(), F.lit(0)).otherwise(F.size(g)).cast("long"))
    return out.select(*docs.columns, n), n


def dedup_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with repeated runs deleted; a document that loses its last word goes. n_chars follows the text where docs has it."""
    out, n = dedup_lines(docs)
    has_word = F.btrim(F.coalesce("text", F.lit("")), F.lit(WS_CHARS)) != ""
    out = out.filter((F.col(n) == 0) | has_word)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n) == 0, F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col(n).alias("n_removed"))


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
raw AS (
  SELECT doc_id, pos, trim(parts[pos + 1], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line,
         len(regexp_extract_all(parts[pos + 1], '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT doc_id, parts, unnest(generate_series(0, len(parts) - 1)) AS pos FROM d)
), l AS (
  SELECT doc_id, pos, line, nw, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx,
         sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) - nw AS before
  FROM raw WHERE nw > 0
), win AS (
  SELECT doc_id, idx AS wpos, sum(nw) OVER w AS mass, list(line) OVER w AS key
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), f AS (
  SELECT doc_id, wpos, key, lag(wpos) OVER (PARTITION BY doc_id, key ORDER BY wpos) AS prev,
         min(doc_id) OVER (PARTITION BY key) AS fdoc
  FROM win WHERE mass >= 50
), f2 AS (
  SELECT *, min(CASE WHEN doc_id = fdoc THEN wpos END) OVER (PARTITION BY key) AS fat FROM f
), diag AS (
  SELECT DISTINCT doc_id, CASE WHEN prev IS NOT NULL THEN doc_id ELSE fdoc END AS src,
         wpos - CASE WHEN prev IS NOT NULL THEN prev ELSE fat END AS shift
  FROM f2 WHERE prev IS NOT NULL OR fdoc <> doc_id
), m AS (
  SELECT g.doc_id, g.src, g.shift, a.idx, a.pos, a.nw,
         a.idx - row_number() OVER (PARTITION BY g.doc_id, g.src, g.shift ORDER BY a.idx) AS run
  FROM diag g JOIN l a ON a.doc_id = g.doc_id
  JOIN l b ON b.doc_id = g.src AND b.idx = a.idx - g.shift AND b.line = a.line
), gone AS (
  SELECT doc_id, list(DISTINCT pos) AS gone
  FROM (SELECT *, sum(nw) OVER (PARTITION BY doc_id, src, shift, run) AS mass FROM m) WHERE mass >= 50 GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(
         list_transform(list_filter(generate_series(0, len(parts) - 1), lambda i: NOT list_contains(gone, i)), lambda i: parts[i + 1]), chr(10)) END AS text,
       coalesce(len(gone), 0)::BIGINT AS n_removed
FROM d LEFT JOIN gone USING (doc_id)
"""
