"""The prefix trie of conversations, by smallest-member ownership.

A conversation passes the node of each prefix of its turns; the node belongs to the smallest conversation that passes it.
Who owns a prefix owns all longer ones, so each conversation owns a suffix of its path. A window marks the owned rows
(its group limit runs before the shuffle, so a prefix that a third of all conversations share sends a row per task),
and one grouping by prefix sums, over the conversations that pass it, the characters from there on minus those of the
part they own, and the leaves they own: what sharing saves in the whole subtree, without walking it.

A prefix is named by its depth and two 64-bit sums (exclusive or) of hashes of (place, role, text): running sums that
blocks of a conversation can make apart, so that a conversation of any length is dealt over many tasks. No text is
carried beyond the first table. Digests of the conversations that end at a node are streamed over blocks of sorted ids.

Defined results: turns are ordered by turn (null first), then role, then text; a null role or text is empty. Rows without
conv_id belong to no conversation and are left out. Repeated rows are repeated turns. A conversation whose rebuilt form
has no turn ends at the root. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Turns of a conversation, and ids that end at a node, that one window or group holds at a time.
BLOCK, IDS = 4096, 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "x1", "x2"]


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv, place, t1, t2, chars): each turn's place from 1 on in its conversation, hashes of role and text, code points of text.

    Rows are sorted over ranges, so a long conversation takes many tasks; places come from the rows before in the same
    range and the counts of earlier ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = ["conv", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    hashed = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]
    at = F.monotonically_increasing_id()
    sorted_rows = cut(dealt.select("conv", at.alias("at"), *hashed, F.length("text").cast("long").alias("chars")), "turns")
    part = F.shiftright("at", 33).alias("part")
    runs = sorted_rows.groupBy("conv", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    runs = runs.select("conv", "part", (before - F.col("first") + 1).alias("shift"))
    return sorted_rows.withColumn("part", part).join(runs, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("place"), "t1", "t2", "chars")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, place, t1, t2, chars) with each conversation's first h turns taken from conversation base.

    convs: (conv, turns, base, h). All turns of base if it has fewer, none if it is absent; the conversation's own turns
    after its first h follow.
    """
    head = turns.join(convs.agg(F.max("h").alias("most")), F.col("place") <= F.col("most")).select(F.col("conv").alias("base"), "place", "t1", "t2", "chars")
    taken = convs.join(head, "base").filter("place <= h").select("conv", "place", "t1", "t2", "chars")
    of_base = convs.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    shift = convs.join(of_base, "base", "left").select("conv", "h", (F.least("h", F.coalesce("base_turns", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.join(shift, "conv").filter("place > h").select("conv", (F.col("place") + F.col("shift")).alias("place"), "t1", "t2", "chars")
    return taken.unionByName(own)


def passes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, turns, depth, x1, x2, p1, p2, rest): the nodes that each conversation passes, the root included, with the name of
    the parent (p1, p2) and the characters of this turn and all that follow in the conversation."""
    h = [F.xxhash64("place", f"t{k}").alias(f"h{k}") for k in (1, 2)]
    rows = turns.select("conv", "place", (F.col("place") / BLOCK).cast("long").alias("block"), "chars", *h)
    sums = rows.groupBy("conv", "block").agg(F.sum("chars").alias("chars"), F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.max("place").alias("last"))
    whole = Window.partitionBy("conv")
    upto = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = sums.select(
        "conv",
        "block",
        F.max("last").over(whole).alias("turns"),
        (F.sum("chars").over(whole) - F.coalesce(F.sum("chars").over(upto), zero)).alias("left"),
        *[F.coalesce(F.bit_xor(f"b{k}").over(upto), zero).alias(f"o{k}") for k in (1, 2)],
    )
    run = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    made = rows.select("conv", "block", "place", "h1", "h2", "chars", F.sum("chars").over(run).alias("run"), *[F.bit_xor(f"h{k}").over(run).alias(f"r{k}") for k in (1, 2)])
    x = [F.col(f"r{k}").bitwiseXOR(F.col(f"o{k}")) for k in (1, 2)]
    nodes = made.join(offsets, ["conv", "block"]).select(
        "conv",
        "turns",
        F.col("place").alias("depth"),
        *[e.alias(f"x{k + 1}") for k, e in enumerate(x)],
        *[e.bitwiseXOR(F.col(f"h{k + 1}")).alias(f"p{k + 1}") for k, e in enumerate(x)],
        (F.col("left") - F.col("run") + F.col("chars")).alias("rest"),
    )
    per = sums.groupBy("conv").agg(F.max("last").alias("turns"), F.sum("chars").alias("rest"))
    root = convs.select("conv").join(per, "conv", "left").select("conv", F.coalesce("turns", zero).alias("turns"), *[zero.alias(c) for c in ("depth", "x1", "x2", "p1", "p2")], F.coalesce("rest", zero).alias("rest"))
    return root.unionByName(nodes)


def _streamed(batches):
    """(depth, x1, x2, ends_sha256) of rows sorted by node and block; one node's digest is open at a time."""
    now, digest, out = None, None, []
    names = [*NODE, "ends_sha256"]
    types = [pa.int64()] * 3 + [pa.string()]

    def made():
        frame = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
        out.clear()
        return frame

    for batch in batches:
        for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key == now:
                digest.update(b",")
            else:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        if len(out) > 10_000:
            yield made()
    if now is not None:
        out.append((*now, digest.hexdigest()))
    if out:
        yield made()


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of rows (depth, x1, x2, conv): blocks of ids become strings first, so a node where a third of
    all conversations end hands on a row for every IDS of them."""
    block = F.floor(F.col("conv") / IDS).alias("block")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    texts = ends.groupBy(*NODE, block).agg(listed.alias("ids"))
    dealt = texts.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return dealt.select(*NODE, "ids").mapInArrow(_streamed, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(occurrences: DataFrame) -> DataFrame:
    """A row per node of passes(): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rank = F.row_number().over(Window.partitionBy(*NODE).orderBy("conv"))
    owned = occurrences.withColumn("rank", rank).filter("rank = 1").drop("rank")
    inner = owned.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).distinct()
    leaves = owned.filter("depth = turns").join(inner, NODE, "left_anti").select("conv", F.lit(1).alias("leaf"))
    suffix = owned.groupBy("conv").agg(F.min("depth").alias("own_from"), F.max("rest").alias("own_rest"), F.min_by("p1", "depth").alias("q1"), F.min_by("p2", "depth").alias("q2"))
    suffix = cut(suffix.join(leaves, "conv", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0))), "owned")
    each = occurrences.join(suffix.select("conv", "own_from", "own_rest", "leaf"), "conv", "left")
    saved = F.col("rest") - F.when(F.col("own_rest").isNull(), F.lit(0)).otherwise(F.least("rest", "own_rest"))
    grown = (F.col("own_from") <= F.col("depth") + 1) & (F.col("depth") < F.col("turns"))
    nodes = each.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if(grown).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
    )
    nodes = cut(nodes.join(end_digests(occurrences.filter("depth = turns").select(*NODE, "conv")), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))), "nodes")
    # A node's parent has the same owner but where the owner's suffix begins; only there is it looked up.
    begins = suffix.filter("own_from > 0").select(F.col("conv").alias("conv_id"), F.col("own_from").alias("depth"), (F.col("own_from") - 1).alias("d"), "q1", "q2")
    above = nodes.select(F.col("depth").alias("d"), F.col("x1").alias("q1"), F.col("x2").alias("q2"), F.col("conv_id").alias("above"))
    begins = begins.join(above, ["d", "q1", "q2"]).select("conv_id", "depth", "above")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    return nodes.join(begins, ["conv_id", "depth"], "left").select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_sizes(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv").agg(F.max("place").alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = placed_turns(table(spark, sf_dir, "conversations"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("long")
    convs = conversation_sizes(turns).select("conv", "turns", (F.col("conv") - F.col("conv") % 100).alias("base"), h.alias("h"))
    return trie(cut(passes(rebuilt(turns, convs), convs), "passes"))


#: Independent form: lists of turns as prefixes, subtrees by comparing lists; crc32 byte by byte.
SQL = """
WITH crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i))),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS m FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM own),
code AS (SELECT c, tab, list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)) AS b FROM ids, crc),
convs AS (SELECT c, c - c % 100 AS base, xor(list_reduce(b, lambda v, s: xor(v >> 8, tab[(xor(v, s) & 255) + 1])), 4294967295) % 6 AS h FROM code),
built AS (
  SELECT v.c, 0 AS part, o.p, o.m FROM convs v JOIN own o ON o.c = v.base AND o.p <= v.h
  UNION ALL SELECT v.c, 1, o.p, o.m FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h
),
path AS (SELECT c, row_number() OVER w AS d, list(m) OVER w AS k, length(m.t) AS n FROM built WINDOW w AS (PARTITION BY c ORDER BY part, p)),
occ AS (SELECT c, d, k, n FROM path UNION ALL SELECT c, 0, []::STRUCT(r VARCHAR, t VARCHAR)[], 0 FROM convs),
len AS (SELECT c, max(d) AS turns FROM occ GROUP BY c),
node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = turns), '') AS ends FROM occ JOIN len USING (c) GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
below AS (SELECT a.d, a.k, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.n)::BIGINT AS saved_tokens FROM full_node a JOIN full_node b ON b.d >= a.d AND b.k[:a.d] = a.k GROUP BY a.d, a.k)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN below b USING (d, k) LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.k[:f.d - 1]
"""
