"""Domain dossiers: what each type is made of and does, as one nested row, and the modules that hold the types.

A dossier has the type's supertypes, annotations, fields and operations; an operation has the facts of itself and of all
below it that is no type (a lambda's call is written in the operation's body; a nested type has a dossier of its own). Facts
stand in the order of their sites (file, start, end, target). Built in stages: the operation of each entity by doubling, facts by
joins with what they point at, then one shuffle by type, in which operations and types are grouped. A dossier is one row, so a
type's facts must fit into one; nothing else is gathered.

entities (id, kind, traits, name, parent, is_stub and, where there, file, start, end, declared_type), edges (edge, from, to,
provenance, is_read, is_write and, where there, file, start, end). Stubs have no dossier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import has_trait
from ..plans.fixpoint import settle, settled_in_turn
from ..schema import PROVENANCES
from .fold import coded, fold
from .navigate import nearest

#: Kinds of edges that are facts of an operation.
FACTS = ["invocation", "access", "throws", "annotationUse"]
#: Facts that a task groups, about.
TASK = 200_000


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns that it lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def walk(entities: DataFrame) -> DataFrame:
    """(id, name, kind, parent, start, end, stub, is_type, operation, of, type, type_name, type_stub, module, module_name): the
    operation of a type in whose body an entity lies and that type (unless a stub), and the nearest type and module around the
    entity, itself included.

    Only entities that hold others are walked; what holds nothing looks at its parent once.
    """
    t = lambda name: has_trait(F.col("traits"), name)
    e = _with(entities, {"start": "bigint", "end": "bigint"}).select("id", "name", "kind", "parent", "start", "end", F.coalesce("is_stub", F.lit(False)).alias("stub"), t("TType").alias("is_type"), t("TModule").alias("is_module"), t("TInvocable").alias("calls"))
    holders = settle(e.drop("kind", "start", "end").join(e.select(F.col("parent").alias("id")).distinct(), "id", "left_semi"))
    held = holders.select(F.col("id").alias("p"), F.col("is_type").alias("in_type"), F.col("stub").alias("in_stub"))
    marked = settle(holders.join(held, F.col("parent") == F.col("p"), "left").withColumn("member", F.coalesce("in_type", F.lit(False))).drop("p", "in_type"))
    near = nearest(marked, {"member": F.col("member"), "type": F.col("is_type"), "module": F.col("is_module")})
    # The nearest entity that a type holds; it is the operation if it can be invoked and the entity is no type itself.
    ops = marked.filter("member AND calls").select(F.col("id").alias("operation"), F.when(~F.col("in_stub"), F.col("parent")).alias("of"))
    types = holders.filter("is_type").select(F.col("id").alias("type"), F.col("name").alias("type_name"), F.col("stub").alias("type_stub"))
    modules = holders.filter("is_module").select(F.col("id").alias("module"), F.col("name").alias("module_name"))
    up = near.join(ops, F.col("member") == F.col("operation"), "left").join(types, "type", "left").join(modules, "module", "left").join(held, F.col("id") == F.col("p"))
    up = settle(up.select("p", "in_type", "in_stub", *[F.col(c).alias(f"up_{c}") for c in ("operation", "of", "type", "type_name", "type_stub", "module", "module_name")]))
    inside = lambda own, c: F.when(~F.col("is_type"), F.when(F.col("in_type"), F.when(F.col("calls"), own)).otherwise(F.col(f"up_{c}"))).alias(c)
    near_or = lambda mark, own, c: F.when(F.col(mark), F.col(own)).otherwise(F.col(f"up_{c}")).alias(c)
    return e.join(up, F.col("parent") == F.col("p"), "left").select(
        "id", "name", "kind", "parent", "start", "end", "stub", "is_type",
        inside(F.col("id"), "operation"), inside(F.when(~F.col("in_stub"), F.col("parent")), "of"),
        near_or("is_type", "id", "type"), near_or("is_type", "name", "type_name"), near_or("is_type", "stub", "type_stub"),
        near_or("is_module", "id", "module"), near_or("is_module", "name", "module_name"),
    )


def _sorted(kind: str, *fields: Column) -> Column:
    """The facts of a kind in the order of their sites, without the key."""
    key = [F.coalesce("file", F.lit("")).alias("_f"), F.coalesce("start", F.lit(0)).alias("_s"), F.coalesce("end", F.lit(0)).alias("_e"), F.col("to").alias("_t")]
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("fact") == FACTS.index(kind), F.struct(*key, F.struct(*fields).alias("x"))))), lambda r: r["x"])


def facts(edges: DataFrame, around: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """(of, operation, fact, to, provenance, is_read, is_write, file, start, end, to_name, to_type, type_name, module_name, external)
    of the operations of types that are no stubs, and the words of provenance.

    Each edge is shuffled once by either end, words as numbers, and takes along the names that its kind tells; to_type is null
    where it is to itself, which to_self says. The files of one end's shuffle go before the next one's are made.
    """
    edges = _with(edges, {"file": "string", "start": "bigint", "end": "bigint", "is_read": "boolean", "is_write": "boolean"}).filter(F.col("edge").isin(FACTS))
    provenance, words = coded(edges, "provenance", PROVENANCES)
    fact = (F.array_position(F.array(*map(F.lit, FACTS)), F.col("edge")) - 1).cast("byte").alias("fact")
    own = around.filter("operation IS NOT NULL AND of IS NOT NULL").select(F.col("id").alias("from"), "operation", "of")
    narrow = edges.select("from", "to", fact, provenance, "is_read", "is_write", "file", "start", "end")
    noted = (F.col("fact") != FACTS.index("annotationUse")) | (F.col("from") == F.col("operation"))
    same = F.coalesce(F.col("type") == F.col("id"), F.lit(False))
    target = around.select(F.col("id").alias("to"), F.col("name").alias("to_name"), F.col("stub").alias("to_stub"), same.alias("to_self"), F.when(~same, F.col("type")).alias("to_type"), F.when(~same, F.col("type_name")).alias("type_name"), "type_stub", "module_name")
    is_ = lambda *kinds: F.col("fact").isin([FACTS.index(k) for k in kinds])
    external = F.coalesce("to_stub", F.lit(True)) | F.when(is_("invocation", "access"), F.coalesce("type_stub", F.lit(False))).otherwise(F.lit(False))
    told = lambda found: found.join(target, "to", "left").select(
        "of", "operation", "fact", "to", "provenance", "is_read", "is_write", "file", "start", "end", "to_self",
        F.when(~is_("invocation") | F.col("to_self"), F.col("to_name")).alias("to_name"),
        *[F.when(is_("invocation", "access"), F.col(c)).alias(c) for c in ("to_type", "type_name")],
        F.when(is_("annotationUse"), F.col("module_name")).alias("module_name"),
        external.alias("external"),
    )
    return settled_in_turn(narrow, lambda d: d.join(own, "from").filter(noted).drop("from"), told), words


def fields(entities: DataFrame, around: DataFrame) -> DataFrame:
    """(type, id, kind, name, declaredType, declaredTypeName, declaredTypeKind, declaredTypeExternal) of the structural members of types."""
    e = _with(entities, {"declared_type": "string"}).filter(has_trait(F.col("traits"), "TStructural") & ~has_trait(F.col("traits"), "TInvocable"))
    declared = around.select(F.col("id").alias("declaredType"), F.col("name").alias("declaredTypeName"), F.col("kind").alias("declaredTypeKind"), F.col("stub").alias("declaredTypeExternal"))
    rows = e.select(F.col("parent").alias("type"), "id", "kind", "name", F.col("declared_type").alias("declaredType")).join(declared, "declaredType", "left")
    return rows.select("type", "id", "kind", "name", "declaredType", "declaredTypeName", "declaredTypeKind", "declaredTypeExternal")


def dossiers(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, name, module, supertypes, fields, operations): a nested row per type of the corpus; members by id."""
    around = settle(walk(entities))
    told, words = facts(edges, around)
    types = around.filter("is_type AND NOT stub").select(F.col("id").alias("of"), F.struct("kind", "name", "module").alias("type"))
    heads = around.filter("id = operation AND of IS NOT NULL").select("of", "operation", F.struct("kind", "name", "start", "end").alias("head"))
    ends = around.select(F.col("id").alias("to"), "name", F.col("stub").alias("external"))
    supers = edges.filter(F.col("edge").isin("inheritance", "interfaceImplementation")).join(ends, "to", "left")
    supers = supers.select(F.col("from").alias("of"), F.struct("to", F.col("edge").alias("relation"), "name", F.coalesce("external", F.lit(True)).alias("external"), "provenance").alias("super"))
    members = fields(entities, around)
    members = members.select(F.col("type").alias("of"), F.struct(*[c for c in members.columns if c != "type"]).alias("field"))
    rows = told
    for part in (types, heads, supers, members):
        rows = rows.unionByName(part, allowMissingColumns=True)
    # Dealt once by the type: neither grouping, by operation and by type, shuffles again. Nested, facts take many times the room that
    # they take in the shuffle, so tasks are sized by facts: by bytes, joined partitions would spill.
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-told.count() // TASK))
    rows = rows.filter("of IS NOT NULL").repartition(tasks, "of")
    anchor = [F.col("file"), F.col("start"), F.col("end")]
    if words is not None:
        rows = rows.withColumn("provenance", F.get(F.array(*map(F.lit, words)), F.col("provenance")))
    holder = F.when(F.col("to_self"), F.col("to")).otherwise(F.col("to_type"))
    holder_name = F.when(F.col("to_self"), F.col("to_name")).otherwise(F.col("type_name"))
    each = rows.groupBy("of", "operation").agg(
        *[F.collect_list(c).alias(c) for c in ("type", "head", "super", "field")],
        _sorted("invocation", "to", holder.alias("targetType"), holder_name.alias("targetTypeName"), "external", "provenance", *anchor).alias("invocations"),
        _sorted("access", "to", F.col("to_name").alias("field"), holder.alias("ownerType"), holder_name.alias("ownerTypeName"), F.col("is_read").alias("isRead"), F.col("is_write").alias("isWrite"), "external", "provenance", *anchor).alias("accesses"),
        _sorted("throws", "to", F.col("to_name").alias("name"), "external", "provenance", *anchor).alias("throws"),
        _sorted("annotationUse", F.col("to").alias("annotation"), F.col("to_name").alias("name"), F.col("module_name").alias("module"), *anchor).alias("annotations"),
    )
    loc = lambda h: F.when(h["start"].isNotNull(), h["end"] - h["start"] + 1)
    made = F.transform("head", lambda h: F.struct(F.col("operation").alias("id"), *[h[c].alias(c) for c in ("kind", "name", "start", "end")], loc(h).alias("loc"), "annotations", "invocations", "accesses", "throws"))
    all_ = lambda c: F.flatten(F.collect_list(c))
    whole = each.select("of", "type", "super", "field", made.alias("made")).groupBy("of")
    whole = whole.agg(all_("type").alias("types"), F.array_sort(all_("super")).alias("supertypes"), F.array_sort(all_("field")).alias("fields"), F.array_sort(all_("made")).alias("operations"))
    whole = whole.select(F.col("of").alias("id"), F.explode("types").alias("t"), "supertypes", "fields", "operations")
    return whole.select("id", "t.kind", "t.name", "t.module", "supertypes", "fields", "operations")


def as_json(rows: DataFrame) -> DataFrame:
    """(id, facts): each dossier as one JSON text, keys in order, absent values left out."""
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("facts"))


def modules(entities: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(id, name, types, imports): a module's own types, and the modules that it depends on by edges of these kinds (imports unless
    said otherwise) with how many."""
    around = settle(walk(entities))
    mine = entities.filter(has_trait(F.col("traits"), "TModule") & ~F.coalesce("is_stub", F.lit(False))).select("id", "name")
    held = entities.filter(has_trait(F.col("traits"), "TType") & ~F.coalesce("is_stub", F.lit(False))).select("id").join(around.select("id", F.col("module").alias("of")), "id")
    held = held.groupBy("of").agg(F.array_sort(F.collect_list("id")).alias("types"))
    out = fold(entities, edges, "module", kinds=kinds or ["import"], drop_self_loops=True).edges
    names = around.select(F.col("id").alias("to"), "name", F.col("stub").alias("external"))
    out = out.join(names, "to", "left").groupBy(F.col("from").alias("by")).agg(F.array_sort(F.collect_list(F.struct("to", "name", "count", F.coalesce("external", F.lit(True)).alias("external")))).alias("imports"))
    rows = mine.join(held, F.col("id") == F.col("of"), "left").join(out, F.col("id") == F.col("by"), "left")
    return rows.select("id", "name", F.coalesce("types", F.array()).alias("types"), F.coalesce("imports", F.array()).alias("imports"))
