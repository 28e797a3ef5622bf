"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: letters and digits, lower case, with numbers, units after numbers and names inside
sentences replaced by typed placeholders. Windows of WINDOW template tokens of every document are hash-joined with
those of the benchmark; hits of one document and item on one alignment add up to covered tokens. A benchmark value
must always map to the same document value: a window with a value that maps to several counts only where all its own
values are equal. So a question asked again with other numbers or names is caught, and a chance likeness of forms is not.

DataFrame operations only. The benchmark's windows are one side of an equi-join; Spark broadcasts them only where
their measured size allows it and otherwise shuffles, splitting hot windows. Documents that share no shorter piece of a
window with the benchmark are set aside first.

Windows of plain tokens add pairs: covered counts template windows where these are enough, and both kinds elsewhere.

Defined results: a pair needs MIN_COVERED covered tokens, or all tokens of a shorter item. Items with fewer tokens
than a window are searched with windows of their own length. Null and empty texts and items match nothing. Rows
that repeat doc_id and text give one row. A null doc_id is reported as null. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, cut, fresh, let, table

WINDOW = 8
MIN_COVERED = 13
#: Fixed list: units of measure that count as a slot after a number.
UNITS = ["mm", "cm", "m", "km", "g", "kg", "mg", "lb", "lbs", "oz", "ml", "l", "s", "sec", "min", "h", "hr", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "months", "years", "miles", "mile", "meters", "metres", "feet", "foot", "inches", "dollars", "dollar", "cents", "euros", "euro", "pounds", "percent", "degrees", "kmh", "mph"]
_NAME, _POINT = "\ue000", "\ue001"
_IN = r"[^\x20\x09-\x0D]"
#: Tokens of the pieces that are looked up first, and the distance between a document's: one lies in every window.
PIECE = 6
STRIDE = WINDOW - PIECE + 1


def marked(text: Column) -> Column:
    """Words of letters and digits between white space; names carry a mark in front, decimal points one inside."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(_NAME), F.lit("")), F.lit(_POINT), F.lit(""))
    t = F.regexp_replace(t, r"([\p{Ll}\p{N},;:] )(\p{Lu}\p{Ll})", "$1" + _NAME + "$2")
    t = F.when(t.rlike("[0-9]"), F.regexp_replace(t, r"([0-9])[.,]([0-9])", "$1" + _POINT + "$2")).otherwise(t)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\x20\x09-\x0D" + _NAME + _POINT + "]+", "")
    return F.btrim(t, F.lit(WS_CHARS))


def raw_tokens(m: Column) -> Column:
    """Tokens of a marked() text, with their marks."""
    return F.when(m == "", F.array().cast("array<string>")).otherwise(F.split(m, WS_CLASS + "+"))


def template(m: Column) -> Column:
    """Template tokens of a marked() text."""
    t = F.when(
        m.rlike("[0-9]"),
        F.regexp_replace(F.regexp_replace(m, rf"(?<!{_IN})[0-9]{_IN}*", "<num>"), rf"(<num>{WS_CLASS}+)(?i:{'|'.join(UNITS)})(?!{_IN})", "$1<unit>"),
    ).otherwise(m)
    return raw_tokens(F.lower(F.regexp_replace(t, f"{_NAME}{_IN}+", "<name>")))


def plain(m: Column) -> Column:
    """Lower-case tokens of a marked() text."""
    return raw_tokens(F.lower(F.replace(m, F.lit(_NAME), F.lit(""))))


def windows(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, h, at, slots): hashes of template windows with, where there are any, the values of their slots.

    Windows with slots are hashed as plain lower-case tokens too, so equal text matches whatever stands around it and in
    any case; windows of more than half slots are hashed as plain tokens only.
    """
    raw, tokens = F.col("_raw"), F.col("_tokens")
    slot = lambda x: x.isin("<num>", "<unit>", "<name>")
    out = rows.withColumn("_slots", F.exists(tokens, slot))

    def by_value(slots: Column, h: Column, plain: Column, i: Column) -> Column:
        none = F.lit(None).cast("array<struct<p:int,v:string>>")
        of = lambda k, v, exact: F.struct(k.alias("h"), i.alias("at"), v.alias("slots"), F.lit(exact).alias("exact"))
        n = F.coalesce(F.size(slots), F.lit(0))
        return F.when(n == 0, F.array(of(h, none, False))).when(n * 2 > width, F.array(of(plain, none, True))).otherwise(F.array(of(h, slots, False), of(plain, none, True)))

    def at(i: Column) -> Column:
        h = F.xxhash64(*[F.get(tokens, i + k) for k in range(width)])
        here = F.sequence(i, i + (width - 1))
        values = F.transform(
            F.filter(here, lambda p: slot(F.get(tokens, p))), lambda p: F.struct(p.alias("p"), F.concat(F.get(tokens, p), F.get(raw, p)).alias("v"))
        )
        plain = F.xxhash64(*[F.lower(F.replace(F.get(raw, i + k), F.lit(_NAME), F.lit(""))) for k in range(width)])
        slots = F.when(F.col("_slots"), values)
        return let(slots, lambda v: by_value(v, h, plain, i))

    n = F.size(tokens)
    each = F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), at))
    out = out.select(*keys, F.explode(F.flatten(each)).alias("_w"))
    return out.select(*keys, F.col("_w.h").alias("h"), F.col("_w.at").alias("at"), F.col("_w.slots").alias("slots"), F.col("_w.exact").alias("exact"))


def _tokenized(df: DataFrame, keys: list[Column], text: str) -> DataFrame:
    out = df.select(*keys, marked(F.col(text)).alias("_m"))
    return out.select(*[c for c in out.columns if c != "_m"], raw_tokens(F.col("_m")).alias("_raw"), template(F.col("_m")).alias("_tokens"))


def _pieces(tokens: Column, width: int, step: int) -> Column:
    n = F.size(tokens)
    at = F.sequence(F.lit(0), n - width, F.lit(step))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)]))
    return F.when(n >= width, hashes).otherwise(F.array().cast("array<bigint>"))


def touched(docs: DataFrame, benchmark: DataFrame, short: list[int]) -> DataFrame:
    """(doc_id, th) of the documents that have a piece of a window in common with the benchmark: all that can match.

    Of each document every STRIDE-th piece of PIECE tokens, as a template and as plain tokens, is looked up among all
    pieces of the items; any window of WINDOW tokens contains one. Items shorter than a window are looked up whole.
    """

    def pieces(df: DataFrame, keys: list[Column], step: int) -> DataFrame:
        m = df.select(*keys, marked(F.col("text")).alias("_m"))
        both = m.select("*", template(F.col("_m")).alias("_t"), plain(F.col("_m")).alias("_p")).drop("_m")
        kinds = [_pieces(F.col(c), *at) for c in ("_t", "_p") for at in [(PIECE, step), *((w, 1) for w in short)]]
        return both.select(*[c for c in both.columns if c not in ("_t", "_p")], F.explode(F.concat(*kinds)).alias("h"))

    asked = cut(pieces(benchmark, [], 1).distinct(), "pieces")
    of_docs = pieces(docs, [F.col("doc_id"), F.xxhash64("text").alias("th")], STRIDE)
    return of_docs.join(asked, "h", "left_semi").select("doc_id", "th").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, covered, item_tokens): pairs of a document and an item that it contains."""
    items = cut(_tokenized(benchmark, [F.col("item_id")], "text").withColumn("item_tokens", F.size("_tokens")), "items")
    short = sorted(r[0] for r in items.filter(F.col("item_tokens").between(1, WINDOW - 1)).select("item_tokens").distinct().collect())
    found = touched(docs, benchmark, short).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    slim = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    some = slim.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi")
    docs_t = cut(_tokenized(some, [F.col("doc_id"), F.col("th")], "text"), "touched")
    hits = None
    for width in [WINDOW, *short]:
        some = items if width == WINDOW else items.filter(F.col("item_tokens") == width)
        asked = windows(some, ["item_id", "item_tokens"], width).select("item_id", "item_tokens", F.col("h").alias("h2"), F.col("at").alias("at2"), F.col("slots").alias("slots2"), F.col("exact").alias("exact2"))
        found = windows(docs_t, ["doc_id", "th"], width).join(asked, F.col("h") == F.col("h2"))
        found = found.select("doc_id", "th", "item_id", "item_tokens", (F.col("at") - F.col("at2")).alias("shift"), F.col("at2").alias("j"), F.lit(width).alias("width"), "slots", "slots2", (F.col("exact") | F.col("exact2")).alias("exact"))
        hits = found if hits is None else hits.union(found)
    pairs = F.transform(
        F.coalesce("slots2", F.array().cast("array<struct<p:int,v:string>>")),
        lambda x, i: F.struct(x["p"].alias("p"), x["v"].alias("a"), F.get(F.col("slots"), i)["v"].alias("b")),
    )
    by = hits.groupBy("doc_id", "th", "item_id", "item_tokens", "shift").agg(F.collect_set(F.struct("j", "width", "exact", pairs.alias("map"))).alias("ws"))
    maps = F.array_distinct(F.flatten(F.transform("ws", lambda w: F.transform(w["map"], lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))))
    by = by.withColumn("values", F.transform(maps, lambda x: x["a"]))
    by = by.withColumn("torn", F.filter("values", lambda a, i: F.array_position("values", a) <= i))
    equal = lambda w: F.forall(w["map"], lambda x: x["a"] == x["b"])
    whole = lambda w: F.forall(w["map"], lambda x: ~F.array_contains("torn", x["a"]))
    kept = F.filter("ws", lambda w: equal(w) | whole(w))

    def covered(ws: Column) -> Column:
        return F.aggregate(
            F.sort_array(F.array_distinct(F.transform(ws, lambda w: F.struct(w["j"].alias("j"), w["width"].alias("width"))))),
            F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
            lambda a, x: F.struct(
                (x["j"] + x["width"]).alias("to"), (a["n"] + F.least(x["width"], x["j"] + x["width"] - a["to"])).alias("n")
            ),
            lambda a: a["n"],
        )

    by = by.withColumn("kept", kept).withColumn("covered", covered(F.col("kept"))).withColumn("by_template", covered(F.filter("kept", lambda w: ~w["exact"])))
    least = F.least(F.lit(MIN_COVERED), F.col("item_tokens"))
    # covered is what templates cover wherever that is enough; windows of plain tokens add pairs.
    return (
        by.filter(F.col("covered") >= least)
        .groupBy("doc_id", "th", "item_id")
        .agg(
            F.coalesce(F.max(F.when(F.col("by_template") >= least, F.col("by_template"))), F.max("covered")).cast("long").alias("covered"),
            F.max("item_tokens").cast("long").alias("item_tokens"),
        )
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that contain a benchmark item; columns as they were."""
    found = leaks(docs, benchmark).select("doc_id", "th").distinct()
    d, t = fresh(docs, "_id"), fresh(docs, "_th")
    found = found.select(F.col("doc_id").alias(d), F.col("th").alias(t + "2"))
    left = docs.withColumn(t, F.xxhash64("text"))
    return left.join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(t) == F.col(t + "2")), "left_anti").select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


_CLEAN = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
         '([\p{Ll}\p{N},;:] )(\p{Lu}\p{Ll})', '\1' || chr(57344) || '\2', 'g'),
         '([0-9])[.,]([0-9])', '\1' || chr(57345) || '\2', 'g'),
         '[^\p{L}\p{N}\x20\x09-\x0D\x{E000}\x{E001}]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
_TOKEN = "CASE WHEN regexp_matches(w, '^[0-9]') THEN '<num>' WHEN w[1] = chr(57344) THEN '<name>' WHEN regexp_matches(ws[i - 1], '^[0-9]') AND list_contains([{units}], lower(w)) THEN '<unit>' ELSE lower(w) END".format(
    units=", ".join(f"'{u}'" for u in UNITS)
)
SQL = f"""
WITH marked AS (
  SELECT 0 AS kind, doc_id AS id, hash(text) AS th, {_CLEAN} AS ws FROM documents
  UNION ALL SELECT 1, item_id, 0, {_CLEAN} FROM benchmark
), src AS (
  SELECT *, len(ws) AS n, list_transform(ws, lambda w, i: {_TOKEN}) AS ts, list_transform(ws, lambda w: lower(replace(w, chr(57344), ''))) AS ps
  FROM marked
), widths AS (
  SELECT 8 AS width UNION SELECT n FROM src WHERE kind = 1 AND n BETWEEN 1 AND 7
), win AS (
  SELECT kind, id, th, n, width, p, ts[p + 1 : p + width] AS tw, ps[p + 1 : p + width] AS pw,
         list_filter(list_transform(generate_series(p + 1, p + width), lambda k: CASE WHEN ts[k] IN ('<num>', '<unit>', '<name>') THEN ts[k] || ws[k] END), lambda v: v IS NOT NULL) AS vs
  FROM (SELECT src.*, width, unnest(generate_series(0, n - width)) AS p FROM src JOIN widths ON n >= width AND (kind = 0 OR width = 8 OR n = width))
), key AS (
  SELECT kind, id, th, n, width, p, tw AS k, vs, false AS exact FROM win WHERE len(vs) * 2 <= width
  UNION ALL SELECT kind, id, th, n, width, p, pw, [], true FROM win WHERE len(vs) > 0
), hit AS (
  SELECT DISTINCT d.id AS doc_id, d.th, b.id AS item_id, b.n AS item_tokens, d.p - b.p AS shift, b.p AS j, b.width, d.exact OR b.exact AS exact, list_zip(b.vs, d.vs) AS vs
  FROM (SELECT * FROM key WHERE kind = 0) d JOIN (SELECT * FROM key WHERE kind = 1) b ON d.k = b.k
), torn AS (
  SELECT doc_id, th, item_id, shift, v[1] AS a FROM (SELECT *, unnest(vs) AS v FROM hit) GROUP BY ALL HAVING count(DISTINCT v[2]) > 1
), kept AS (
  SELECT hit.* FROM hit LEFT JOIN (SELECT doc_id, th, item_id, shift, list(a) AS many FROM torn GROUP BY ALL) t USING (doc_id, th, item_id, shift)
  WHERE len(list_filter(vs, lambda v: v[1] <> v[2])) = 0 OR many IS NULL OR len(list_filter(vs, lambda v: list_contains(many, v[1]))) = 0
), cov AS (
  SELECT doc_id, th, item_id, item_tokens, shift, count(DISTINCT q) AS covered, count(DISTINCT q) FILTER (NOT exact) AS by_template
  FROM (SELECT *, unnest(generate_series(j, j + width - 1)) AS q FROM kept) GROUP BY ALL
)
SELECT doc_id, item_id, coalesce(max(by_template) FILTER (by_template >= least({MIN_COVERED}, item_tokens)), max(covered))::BIGINT AS covered, max(item_tokens)::BIGINT AS item_tokens
FROM cov WHERE covered >= least({MIN_COVERED}, item_tokens) GROUP BY doc_id, th, item_id
"""
