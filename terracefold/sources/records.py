"""Checks of model files line by line, for files of any size: each rule is a join or a sum over all lines.

Lines are (path, line, value). A file is a header, then file, entity and edge records, then an end record. Every line is held
against: being JSON with a known tag; one header, on the first line, whose vocabularies repeat nothing; sections in order;
dense numbers of files and entities; modules declared no later than their members; numbers inside the header's vocabularies,
the files and the entities; end counts. Findings are rows (path, line, rule, detail); line 0 is the file as a whole.

A file's records may be a third of all lines: places among records come from ranges (plans.order), all else from sums per file
that combine before the shuffle. streaming.records applies the same rules to files that arrive in pieces.

Defined results: blank lines count as lines and are no records. Null values are blank. Each finding comes once per line and rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import settle
from ..plans.order import positions

#: Tags of records in the order of their sections, and the vocabularies of a header.
TAGS = ["header", "f", "e", "x", "eof"]
VOCABULARIES = ["kinds", "traits", "edges", "provenance"]
#: Keys of an entity record that hold one entity number, or a list of them.
ONE_REF, MANY_REFS = ["m", "parent", "attachedTo", "declaredType"], ["parameters", "localVariables"]

RECORD = (
    "t string, i long, path string, k long, tr array<long>, m long, anchor array<long>, definedIn array<long>, parent long, attachedTo long, declaredType long, parameters array<long>, localVariables array<long>, "
    "f long, o long, p long, candidates array<long>, sourceFile long, dict struct<kinds:array<string>,traits:array<string>,edges:array<string>,provenance:array<string>>, counts struct<files:bigint,entities:bigint,edges:bigint>"
)
FINDING = "path string, line long, rule string, detail string"


def numbered(texts: DataFrame) -> DataFrame:
    """(path, line, value) of whole texts (path, value)."""
    each = texts.select("path", F.posexplode(F.split(F.coalesce("value", F.lit("")), "\n")).alias("n", "value"))
    return each.select("path", (F.col("n") + 1).cast("long").alias("line"), "value")


def parsed(lines: DataFrame) -> DataFrame:
    """(path, line, bad, section, r): the parsed record; bad is the rule that a line breaks as a record."""
    text = lines.select("path", F.col("line").cast("long").alias("line"), F.btrim(F.coalesce("value", F.lit("")), F.lit(" \t\r\n")).alias("v")).filter("v <> ''")
    json = F.try_parse_json("v")
    tag = F.try_variant_get(json, "$.t", "string")
    made = text.select("path", "line", json.isNull().alias("broken"), tag.alias("t"), F.from_json("v", RECORD).alias("r"))
    section = F.array_position(F.array(*map(F.lit, TAGS)), F.col("t")) - 1
    bad = F.when(F.col("broken"), "not-json").when(F.col("t").isNull(), "no-tag").when(section < 0, "unknown-record")
    return made.select("path", "line", bad.alias("bad"), F.when(bad.isNull(), section).alias("section"), "t", "r")


def check(lines: DataFrame) -> DataFrame:
    """The findings (path, line, rule, detail) of all files."""
    every = settle(parsed(lines))
    files = lines.select("path").distinct()
    good = every.filter("bad IS NULL")
    found = [every.filter("bad IS NOT NULL").select("path", "line", F.col("bad").alias("rule"), F.coalesce("t", F.lit("")).alias("detail"))]

    def add(df: DataFrame, rule: str, when, detail) -> None:
        found.append(df.filter(when).select("path", "line", F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")))

    # One row per file: first line of each section, counts, the header that counts (the first), the end record (the first).
    firsts = [F.min(F.when(F.col("section") == k, F.col("line"))).alias(f"first{k}") for k in range(5)]
    counts = [F.count_if(F.col("section") == k).alias(n) for k, n in ((1, "files"), (2, "entities"), (3, "edges"))]
    pick = lambda k, c: F.min_by(F.when(F.col("section") == k, F.col(c)), F.when(F.col("section") == k, F.col("line")))
    per = good.groupBy("path").agg(*firsts, *counts, pick(0, "r.dict").alias("dict"), pick(4, "r.counts").alias("ends"))
    per = settle(files.join(per, "path", "left").fillna(0, ["files", "entities", "edges"]))

    add(per.withColumn("line", F.lit(0).cast("long")), "no-header", F.col("first0").isNull(), F.lit(""))
    add(per.withColumn("line", F.lit(0).cast("long")), "no-end", F.col("first4").isNull(), F.lit(""))
    wrong = [F.when(F.col(f"ends.{c}").eqNullSafe(F.col(c)), None).otherwise(F.concat(F.lit(f"{c}:"), F.coalesce(F.col(f"ends.{c}").cast("string"), F.lit("null")), F.lit("<>"), F.col(c).cast("string"))) for c in ("files", "entities", "edges")]
    differ = F.concat_ws(";", *wrong)
    add(per.withColumn("line", F.lit(0).cast("long")), "end-counts", F.col("first4").isNotNull() & (differ != ""), differ)

    one = good.join(per.select("path", *[f"first{k}" for k in range(5)], "files", "entities", F.col("dict").alias("words")), "path")
    add(one, "second-header", (F.col("section") == 0) & (F.col("line") > F.col("first0")), F.lit(""))
    add(one, "header-not-first", (F.col("section") == 0) & (F.col("line") == F.col("first0")) & (F.col("line") > 1), F.col("line"))
    repeats = F.concat_ws(";", *[F.when(F.size(F.array_distinct(F.col(f"r.dict.{v}"))) < F.size(f"r.dict.{v}"), F.lit(v)) for v in VOCABULARIES])
    add(one, "repeated-word", (F.col("section") == 0) & (repeats != ""), repeats)
    add(one, "before-header", (F.col("section") > 0) & (F.col("first0").isNull() | (F.col("line") < F.col("first0"))), F.col("t"))
    later = F.least(*[F.when(F.col("section") < k, F.col(f"first{k}")) for k in range(1, 5)])
    add(one, "section-closed", (F.col("section") > 0) & (F.col("line") > later), F.col("t"))
    add(one, "second-end", (F.col("section") == 4) & (F.col("line") > F.col("first4")), F.lit(""))

    dense = positions(good.filter("section IN (1, 2)").select("path", "line", "section", F.col("r.i").alias("i")), ["line"], "place", ["path", "section"])
    add(dense, "not-dense", ~F.col("i").eqNullSafe(F.col("place") - 1), F.concat_ws("<>", F.coalesce(F.col("i").cast("string"), F.lit("null")), (F.col("place") - 1).cast("string")))

    # A word or number outside its bounds, by what it is called; each line's in one text.
    outside = lambda value, bound: value.isNull() | (value < 0) | (value >= bound)
    size = lambda v: F.when(F.col("line") > F.col("first0"), F.coalesce(F.size(f"words.{v}"), F.lit(0))).otherwise(F.lit(0))
    listed = lambda values, bound, name: F.array_join(F.transform(F.filter(F.coalesce(values, F.array().cast("array<long>")), lambda x: outside(x, bound)), lambda x: F.concat(F.lit(f"{name}:"), F.coalesce(x.cast("string"), F.lit("null")))), ";")
    single = lambda value, bound, name: F.when(outside(value, bound), F.concat(F.lit(f"{name}:"), F.coalesce(value.cast("string"), F.lit("null"))))
    given = lambda c, bound, name: F.when(F.col(c).isNotNull(), single(F.col(c), bound, name))
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), ";")
    entity, edge = F.col("section") == 2, F.col("section") == 3
    words = F.when(entity, joined(single(F.col("r.k"), size("kinds"), "kind"), listed(F.col("r.tr"), size("traits"), "trait")))
    words = words.when(edge, joined(single(F.col("r.k"), size("edges"), "edge"), single(F.col("r.p"), size("provenance"), "provenance")))
    add(one, "vocabulary", (F.col("section").isin(2, 3)) & (words != ""), words)
    add(one, "module-later", entity & (F.col("r.m") > F.col("r.i")), F.col("r.m"))
    anchor = F.get("r.anchor", F.lit(0))
    paths = F.when(entity, joined(F.when(F.col("r.anchor").isNotNull(), single(anchor, F.col("files"), "anchor")), listed(F.col("r.definedIn"), F.col("files"), "definedIn")))
    paths = paths.when(edge, joined(single(anchor, F.col("files"), "anchor"), given("r.sourceFile", F.col("files"), "sourceFile")))
    add(one, "no-file", F.col("section").isin(2, 3) & (paths != ""), paths)
    refs = F.when(entity, joined(*[given(f"r.{c}", F.col("entities"), c) for c in ONE_REF], *[listed(F.col(f"r.{c}"), F.col("entities"), c) for c in MANY_REFS]))
    refs = refs.when(edge, joined(single(F.col("r.f"), F.col("entities"), "from"), single(F.col("r.o"), F.col("entities"), "to"), listed(F.col("r.candidates"), F.col("entities"), "candidate")))
    add(one, "no-entity", F.col("section").isin(2, 3) & (refs != ""), refs)
    return reduce(lambda a, b: a.unionByName(b), [f.select("path", F.col("line").cast("long").alias("line"), "rule", "detail") for f in found])
