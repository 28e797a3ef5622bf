"""Joins of measured spaces to entities by their line spans, and the fold of what no entity is.

Spaces (file, space, parent, depth, start, end, kind) come from a measuring pass, parent being the enclosing space; entities
(file, id, depth, start, end, category, implicit) from a model; lines (file, line, text) are the files' text, lines from 1 on.
Categories are unit, type, invocable and other. Entities join in three steps, each over what the earlier ones left:

  exact      same span. Pairs of one category and its natural kind of space come first, in order of depth, where their numbers
             agree; then the rest by depth where all are compatible; one entity over sibling spaces contains them all; else the
             entities are ambiguous.
  leading    same end, and nothing but annotations, comments and blank lines between the starts: the nearest such space, if no
             entity has it; of several entities the one with the longest span.
  contained  the outermost free compatible spaces inside an entity's span that no space with an owner, also inside, encloses;
             smaller entities choose first. Implicit entities contain nothing.

All is joins per file and span; the order of claims among containing entities is settled level by level of the spaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import settle
from .navigate import nearest

#: Kinds of spaces that a category naturally is, and those that it can be joined to.
NATURAL = {"unit": ["unit"], "invocable": ["function"], "type": ["class", "struct", "trait", "impl", "interface", "namespace"]}
COMPATIBLE = {"unit": ["unit"], "invocable": ["function", "class"]}
NOT_COMPATIBLE = {"type": ["function", "unit", "unknown"], "other": ["unit", "unknown"]}


def _compatible(category: Column, kind: Column) -> Column:
    out = F.lit(False)
    for c, kinds in COMPATIBLE.items():
        out = out | ((category == c) & kind.isin(kinds))
    for c, kinds in NOT_COMPATIBLE.items():
        out = out | ((category == c) & ~kind.isin(kinds))
    return out


def exact(spaces: DataFrame, entities: DataFrame) -> DataFrame:
    """(space, id, how): how is exact or contained; ambiguous entities come without a space."""
    span = ["file", "start", "end"]
    s, e = spaces.select(*span, "space", F.col("depth").alias("sd"), "kind"), entities.select(*span, "id", F.col("depth").alias("ed"), "category")
    s, e = settle(s.join(e.select(*span).distinct(), span, "left_semi")), settle(e.join(s.select(*span).distinct(), span, "left_semi"))
    of = reduce(lambda c, kv: c.when(F.col("kind").isin(kv[1]), kv[0]), NATURAL.items(), F.when(F.lit(False), ""))
    place = lambda keys, *by: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    size = lambda keys: F.count("*").over(Window.partitionBy(*keys))
    ns, ne = s.withColumn("category", of).filter("category IS NOT NULL"), e.filter(F.col("category").isin(list(NATURAL)))
    by = [*span, "category"]
    ns = ns.select(*by, "space", place(by, "sd", "space").alias("k"), size(by).alias("n"))
    ne = ne.select(*by, "id", place(by, "ed", "id").alias("k"), size(by).alias("n"))
    first = settle(ns.join(ne, [*by, "k", "n"]).select("space", "id", F.lit("exact").alias("how")))
    rs, re = s.join(first.select("space"), "space", "left_anti"), e.join(first.select("id"), "id", "left_anti")
    rs = rs.select(*span, "space", "sd", "kind", place(span, "sd", "space").alias("k"), size(span).alias("ns"))
    re = settle(re.select(*span, "id", "ed", "category", place(span, "ed", "id").alias("k"), size(span).alias("ne")))
    rs = settle(rs.join(re.select(*span, "ne").distinct(), span))
    zipped = rs.join(re.drop("ne"), [*span, "k"], "left")
    alone = re.filter("ne = 1").select(*span, F.col("category").alias("alone"))
    judged = zipped.join(alone, span, "left").groupBy(*span).agg(
        (F.first("ne") >= F.first("ns")).alias("enough"),
        F.bool_and(F.coalesce(_compatible(F.col("category"), F.col("kind")), F.lit(False))).alias("zip"),
        (F.first("ne") == 1).alias("one"),
        (F.min("sd") == F.max("sd")).alias("level"),
        F.bool_and(F.coalesce(_compatible(F.col("alone"), F.col("kind")), F.lit(False))).alias("all"),
    )
    verdict = F.when(F.col("enough") & F.col("zip"), "exact").when(F.col("one") & F.col("level") & F.col("all"), "contained").otherwise("ambiguous")
    judged = settle(judged.select(*span, verdict.alias("how")))
    pairs = rs.join(judged.filter("how = 'exact'"), span).join(re.drop("ne"), [*span, "k"]).select("space", "id", "how")
    over = rs.join(judged.filter("how = 'contained'"), span).join(re.select(*span, "id"), span).select("space", "id", "how")
    lost = re.join(judged.filter("how = 'ambiguous'"), span).select(F.lit(None).cast("string").alias("space"), "id", "how")
    return first.unionByName(pairs).unionByName(over).unionByName(lost)


def line_marks(lines: DataFrame) -> DataFrame:
    """(file, line, opens, balance): whether a line may stand before a declaration, and its opening less closing brackets outside
    literals (none in comments)."""
    text = F.ltrim(F.coalesce("text", F.lit("")))
    comment = reduce(lambda a, b: a | b, [text.startswith(p) for p in ("//", "/*", "*", "#")])
    bare = F.regexp_replace(text, r""""(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)""", "")
    balance = F.length(F.regexp_replace(bare, r"[^(\[{]", "")) - F.length(F.regexp_replace(bare, r"[^)\]}]", ""))
    opens = (text == "") | comment | text.startswith("@") | text.startswith("[")
    return lines.select("file", "line", opens.alias("opens"), F.when(comment, 0).otherwise(balance).alias("balance"))


def leading(spaces: DataFrame, entities: DataFrame, lines: DataFrame, owned: DataFrame) -> DataFrame:
    """(space, id): entities without a join yet; owned (space) are taken and still count as nearest."""
    e = entities.select(F.col("file").alias("f"), F.col("end").alias("e"), F.col("start").alias("es"), "id", F.col("depth").alias("ed"), "category")
    near = spaces.join(e, (F.col("file") == F.col("f")) & (F.col("end") == F.col("e"))).filter((F.col("start") != F.col("es")) & _compatible(F.col("category"), F.col("kind")))
    near = settle(near.select("file", "space", "id", "ed", F.col("start").alias("s"), "es", (F.col("end") - F.col("es")).alias("long"), F.least("start", "es").alias("lo"), F.greatest("start", "es").alias("hi")))
    marks = line_marks(lines)
    gaps = near.select("file", "lo", "hi").distinct()
    each = gaps.select("file", "lo", "hi", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("line")).join(marks, ["file", "line"])
    # The marks of a gap in order: at depth 0 a line must be one that may stand before a declaration; brackets must close.
    gone = F.struct(F.lit(True).alias("ok"), F.lit(0).cast("long").alias("depth"))
    step = lambda a, x: F.struct((a["ok"] & ((a["depth"] != 0) | x["opens"])).alias("ok"), (a["depth"] + x["balance"]).alias("depth"))
    read = each.groupBy("file", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("line", "opens", "balance"))).alias("m"))
    read = read.filter(F.size("m") == F.col("hi") - F.col("lo")).withColumn("end", F.aggregate("m", gone, step)).filter("end.ok AND end.depth = 0")
    fits = near.join(read.select("file", "lo", "hi"), ["file", "lo", "hi"])
    best = fits.groupBy("id").agg(F.min_by(F.struct("space", "long", "ed"), F.struct(F.abs(F.col("s") - F.col("es")), "space")).alias("b"))
    free = best.select("id", "b.*").join(owned.select("space"), "space", "left_anti")
    return free.groupBy("space").agg(F.min_by("id", F.struct(-F.col("long"), "ed", "id")).alias("id"))


def contained(spaces: DataFrame, entities: DataFrame, owned: DataFrame, bucket: int = 64) -> DataFrame:
    """(space, id): spaces that entities without a join yet contain; owned (space) are taken."""
    e = entities.filter(~F.coalesce("implicit", F.lit(False)))
    e = e.select(F.col("file").alias("f"), "id", F.col("start").alias("es"), F.col("end").alias("ee"), "category", F.struct((F.col("end") - F.col("start")).alias("long"), (-F.col("depth")).alias("up"), "id").alias("turn"))
    wide = e.withColumn("b", F.explode(F.sequence(F.floor(F.col("es") / bucket), F.floor(F.col("ee") / bucket))))
    s = settle(spaces.select("file", "space", "parent", "depth", "start", "end", "kind").join(owned.select("space", F.lit(True).alias("taken")), "space", "left"))
    within = s.join(wide, (F.col("file") == F.col("f")) & (F.floor(F.col("start") / bucket) == F.col("b"))).filter("es <= start AND `end` <= ee")
    within = settle(within.select("space", "parent", "depth", "kind", "taken", "id", "turn", "category"))
    # closed (space, id): the space or one around it, inside the entity's span, has an owner when the entity's turn comes.
    closed, claims = None, []
    top = within.agg(F.max("depth")).first()[0]
    for level in range(int(spaces.agg(F.min("depth")).first()[0] or 0), (top if top is not None else -1) + 1):
        here = within.filter(F.col("depth") == level)
        if closed is not None:
            above = closed.select(F.col("space").alias("parent"), "id", F.lit(True).alias("shut"))
            here = here.join(above, ["parent", "id"], "left")
        else:
            here = here.withColumn("shut", F.lit(None).cast("boolean"))
        free = here.filter(F.col("taken").isNull() & F.col("shut").isNull() & _compatible(F.col("category"), F.col("kind")))
        mine = settle(free.groupBy("space").agg(F.min_by("id", "turn").alias("by"), F.min("turn").alias("when")))
        claims.append(mine.select("space", F.col("by").alias("id")))
        shut = here.join(mine, "space", "left").filter(F.col("taken").isNotNull() | F.col("shut").isNotNull() | (F.col("when") <= F.col("turn"))).select("space", "id")
        closed = settle(shut)
    return reduce(DataFrame.unionByName, claims) if claims else owned.limit(0).select("space", F.lit("").alias("id"))


def spans(spaces: DataFrame, entities: DataFrame, lines: DataFrame) -> DataFrame:
    """(space, id, how): the three joins in turn; ambiguous entities have no space, unjoined ones are absent."""
    one = settle(exact(spaces, entities))
    rest = entities.join(one.select("id"), "id", "left_anti")
    two = settle(leading(spaces, rest, lines, one.filter("space IS NOT NULL")).withColumn("how", F.lit("leading")))
    rest = rest.join(two.select("id"), "id", "left_anti")
    taken = one.filter("space IS NOT NULL").select("space").union(two.select("space"))
    three = contained(spaces, rest, taken).withColumn("how", F.lit("contained"))
    return one.unionByName(two.select("space", "id", "how")).unionByName(three)


def charge(measures: DataFrame, spaces: DataFrame, joined: DataFrame) -> DataFrame:
    """(id, key, value): additive measures (space, key, value) summed at the entity of the space, or of the nearest space around it
    that an entity owns; what lies under none is left out."""
    owner = joined.filter("space IS NOT NULL").select("space", "id")
    marked = settle(spaces.select("space", "parent").join(owner.select(F.col("space").alias("o"), F.lit(True).alias("own")), F.col("space") == F.col("o"), "left").select(F.col("space").alias("id"), "parent", F.coalesce("own", F.lit(False)).alias("own")))
    up = nearest(marked, {"at": F.col("own")}).select(F.col("id").alias("space"), "at")
    return measures.join(up, "space").join(owner.select(F.col("space").alias("at"), "id"), "at").groupBy("id", "key").agg(F.sum("value").alias("value"))


def abc_magnitude(a, b, c):
    return F.round(F.sqrt(a * a + b * b + c * c), 4)
