"""The star schema as an entity graph, a history, snapshots and insights.

Entities: regions, nations and brands are modules; suppliers, customers and parts are types; orders are operations of
their customer. Edges: each line item is an invocation order -> part, an access order -> supplier and a reference
supplier -> part. The projections are plain selects, so filters and columns reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _traits(*names: str):
    return F.array(*[F.lit(n) for n in names])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, traits, name, parent, is_stub)."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    row = lambda d, i, kind, traits, name, parent, stub: d.select(i.alias("id"), F.lit(kind).alias("kind"), traits.alias("traits"), name.cast("string").alias("name"), parent.alias("parent"), stub.alias("is_stub"))  # noqa: E731, E501
    module, type_, op = _traits("TNamed", "TModule"), _traits("TNamed", "TChildOf", "TType"), _traits("TChildOf", "TInvocable")
    parts = [
        row(t("region"), key("region", "r_regionkey"), "region", module, F.col("r_name"), none, F.lit(False)),
        row(t("nation"), key("nation", "n_nationkey"), "nation", module, F.col("n_name"), key("region", "n_regionkey"), F.lit(False)),
        row(t("part").select("p_brand").distinct(), key("brand", "p_brand"), "brand", module, F.col("p_brand"), none, F.lit(False)),
        row(t("supplier"), key("supplier", "s_suppkey"), "supplier", type_, F.col("s_name"), key("nation", "s_nationkey"), F.col("s_acctbal") < 0),
        row(t("customer"), key("customer", "c_custkey"), "customer", type_, F.col("c_name"), key("nation", "c_nationkey"), F.col("c_acctbal") < 0),
        row(t("part"), key("part", "p_partkey"), "part", type_, F.col("p_name"), key("brand", "p_brand"), F.col("p_size") > 45),
        row(t("orders"), key("order", "o_orderkey"), "order", op, none, key("customer", "o_custkey"), no),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge, from, to, provenance, is_read, is_write, file, start, end)."""
    li = table(spark, sf_dir, "lineitem")
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    provenance = F.when(F.col("l_returnflag") == "N", "declared").when(F.col("l_returnflag") == "A", "derived").otherwise("dynamic-candidate")
    ends = [("invocation", key("order", "l_orderkey"), key("part", "l_partkey")), ("access", key("order", "l_orderkey"), key("supplier", "l_suppkey")), ("reference", key("supplier", "l_suppkey"), key("part", "l_partkey"))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("edge"), a.alias("from"), b.alias("to")) for k, a, b in ends]))
    access = F.col("e.edge") == "access"
    return li.select(
        each.alias("e"), provenance.alias("provenance"), "l_linestatus", F.col("l_linenumber").alias("start"), F.col("l_quantity")
    ).select(
        "e.*",
        "provenance",
        F.when(access, F.col("l_linestatus") == "O").alias("is_read"),
        F.when(access, F.col("l_linestatus") == "F").alias("is_write"),
        F.col("start"),
        (F.col("start") + F.col("l_quantity")).cast("long").alias("end"),
    )


def nation_edges(spark: SparkSession, sf_dir: str, support: int) -> DataFrame:
    """(from, to, count): customer's nation -> supplier's nation of line items, from `support` line items on."""
    t = lambda n: table(spark, sf_dir, n)
    flow = (
        t("lineitem")
        .select("l_orderkey", "l_suppkey")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return (
        flow.groupBy(F.col("c_nationkey").alias("from"), F.col("s_nationkey").alias("to")).agg(F.count("*").alias("count")).filter(F.col("count") >= support)
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, author, time, is_fix, is_revert): each order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("commit"),
        F.col("o_custkey").alias("author"),
        F.unix_timestamp("o_orderdate").alias("time"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_fix"),
        (F.col("o_orderstatus") == "P").alias("is_revert"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, path, added, deleted): line items merged by order and supplier."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("path"))
        .agg(F.sum("l_quantity").cast("long").alias("added"), F.sum("l_linenumber").cast("long").alias("deleted"))
    )


def part_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, path, added, deleted): line items merged by order and part."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))
        .agg(F.sum("l_quantity").cast("long").alias("added"), F.sum("l_linenumber").cast("long").alias("deleted"))
    )


def file_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges (file, to, provenance) and entity files (id, file), parts being files: an order lies in the file of its first line,
    and the last line of a customer's order before it refers to it."""
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(line).alias("a"), F.max(line).alias("z"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate").join(lines, "id")
    before = F.lag("z.l_partkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "id"))
    flag = F.col("a.l_returnflag")
    provenance = F.when(flag == "N", "declared").when(flag == "A", "derived").otherwise("dynamic-candidate")
    edges = orders.select(before.alias("file"), F.col("id").alias("to"), provenance.alias("provenance")).filter("file IS NOT NULL")
    return edges, orders.select("id", F.col("a.l_partkey").alias("file"))


def part_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from, to, count): each part and the one that comes next where it last stood before another in an order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = li.withColumn("to", after).filter("to IS NOT NULL")
    last = pairs.groupBy(F.col("l_partkey").alias("from")).agg(F.max(F.struct("l_orderkey", "l_linenumber", "to")).alias("m"))
    return last.select("from", F.col("m.to").alias("to"), F.lit(1).cast("long").alias("count"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(revision, key, kind, loc): a day's state of each user."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("revision"), F.col("user_id").alias("key"))
        .agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("loc"))
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, scope, role, name): names that speak, by scope."""
    return entities(spark, sf_dir).filter("name IS NOT NULL AND NOT coalesce(is_stub, false)").select(
        F.col("id").alias("entity"), F.coalesce("parent", F.col("id")).alias("scope"), F.when(F.array_contains("traits", "TModule"), "module").otherwise("type").alias("role"), "name"
    )
