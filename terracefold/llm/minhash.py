"""Near-duplicate groups by an LSH forest: sorted signature orders, neighbours by longest common prefix.

1. Every whole text gives its set of word shingles, a 128-bit key of that set and TREES * DEPTH minhashes.
2. Equal sets become one node (copies are never expanded into pairs).
3. Each tree sorts all nodes by its own DEPTH minhashes and, where these are equal, by the low bytes of all others (a
   range-partitioned sort, so a crowded region is dealt over tasks). The rows next to a node in that order are those of
   the longest common prefix: a short one in a sparse region, a deeper one in a crowded region. Of the next NEIGHBOURS
   on each side that share a prefix, the likest is taken; over all trees a node keeps its BEST likest.
4. A candidate's similarity is estimated from all minhashes; promising ones are confirmed on full sets, first each
   node's best, then those that would join two components. A pair whose ends have met is dropped for good.
5. A node next to a large component is also held against that component's hubs (the nodes with most links), so a copy
   that resembles only the original of a crowded group is found. Rounds go on until none adds a link.
6. None of these bounds loses a link: a prefix-filter join on full sets completes the search exactly. Two sets that reach
   SIMILARITY share a shingle among the first quarter of either in any common order (common shingles come last in the
   order used). Blocks of such a shingle pair up components, not nodes, so a crowded group of one component costs one
   row; of the members of two components those pairs are confirmed whose sizes and positions allow it and whose
   estimate is not below POSSIBLE.

Defined results: texts without a word (null, empty, blank) have no shingles and are linked with nothing. A null doc_id
takes no part in grouping: component_id null, kept true. Repeated rows are copies of each other. Rows that share a
doc_id follow their own texts. An empty table gives an empty result. Extra columns are ignored or carried through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, fresh, release, table
from .graph import components
from .shingles import DEPTH, TREES, minhashes, shingle_sets

#: Similarity in percent; estimates from which a pair is confirmed, or counts as adjacent; neighbours on each side.
SIMILARITY = 75
CONFIRM, ADJACENT = 0.57, 0.4
#: A pair that reaches SIMILARITY agrees in fewer of 96 minhashes than this share in about one of 10**8 cases.
POSSIBLE = 0.48
NEIGHBOURS = 12
#: Candidates that a node keeps of all trees, the likest first; step 6 finds what the others would have.
BEST = 4
#: Hubs of a component: the best-linked node of each hash share of its nodes.
HUBS, FIRST_HUBS = 16, 4
#: Rounds that try few pairs of each node before all are tried.
NARROW_ROUNDS = 2
#: Shingles of one in HOT_SHARE distinct texts are counted; the HOT_SHINGLES commonest with HOT_COUNT of those come last in
#: the order of the prefix filter. This decides the filter's cost only: it is exact in any order.
HOT_SHARE, HOT_COUNT, HOT_SHINGLES = 16, 3, 1 << 17
_WIDTH = 4 * DEPTH


def _slices(batches, rows: int):
    """Smaller batches, so that a worker holds the sets of few texts at a time; freed memory goes back after each batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def _counted(batches):
    for batch in _slices(batches, 1000):
        sets = [s for s in shingle_sets(batch.column(0)) if len(s)]
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])


def hot_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """The commonest shingles, the rarest of them first."""
    some = docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(HOT_SHARE)) == 0).distinct()
    counts = some.mapInArrow(_counted, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_COUNT)
    rows = counts.orderBy(F.desc("n"), "h").limit(HOT_SHINGLES).toArrow()
    return rows.column("h").to_numpy().view(np.uint64)[::-1].copy()


def _prefix(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which a set that reaches SIMILARITY must have one: by hash, then hot ones by rank."""
    n = len(s) + (-SIMILARITY * len(s) // 100) + 1 if len(s) else 0
    if not len(hot):
        return s[:n]
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    common = hot[at] == s
    cold = s[~common]
    if len(cold) >= n:
        return cold[:n]
    at = at[common]
    return np.concatenate([cold, hot[at[np.argsort(rank[at])]]])[:n]


def _sign(batches, hot, rank):
    for batch in _slices(batches, 1000):
        sets = list(shingle_sets(batch.column(2)))
        m = minhashes(sets)
        big = m.astype(">u4").tobytes()
        low = m.astype(np.uint8).tobytes()
        row = 4 * TREES * DEPTH
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([big[k * row : (k + 1) * row] for k in range(len(sets))], pa.binary()),
                pa.array([low[k * row // 4 : (k + 1) * row // 4] for k in range(len(sets))], pa.binary()),
                pa.array([_prefix(s, hot, rank).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ],
            ["doc_id", "text_hash", "n_shingles", "set_key", "sig", "sketch", "first"],
        )


def signatures(docs: DataFrame, text: str) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text))
    ranked = hot_shingles(docs, text)
    rank = np.argsort(ranked)
    hot = ranked[rank]
    return slim.mapInArrow(
        lambda batches: _sign(batches, hot, rank),
        "doc_id long, text_hash long, n_shingles long, set_key binary, sig binary, sketch binary, first array<long>",
    )


_PASS = "kind int, a long, b long, est float, tree int, prefix binary, sketch binary"


def _neighbours(batches):
    """Candidates among sorted rows (tree, prefix, node, sketch); the ends of a partition come out for stitching."""
    held, seen_first, tail = None, False, None

    def fixed(col, dtype, width):
        return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, width)

    def border(rows):
        return pa.RecordBatch.from_pydict(
            {"kind": [1] * len(rows), "a": [r[1] for r in rows], "b": [None] * len(rows), "est": [None] * len(rows), "tree": [r[0] for r in rows], "prefix": [r[2] for r in rows], "sketch": [r[3] for r in rows]},
            pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("est", pa.float32()), ("tree", pa.int32()), ("prefix", pa.binary()), ("sketch", pa.binary())]),
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).slice(0, NEIGHBOURS).to_pylist() for k in range(4)))) if not seen_first else []
        if rows:
            yield border(rows)
            seen_first = True
        tree = batch.column(0).to_numpy()
        node = batch.column(1).to_numpy()
        head = fixed(batch.column(2), ">u4", DEPTH)
        sketch = fixed(batch.column(3), np.uint8, TREES * DEPTH)
        if held is not None:
            tree, node, head, sketch = (np.concatenate(x) for x in zip(held, (tree, node, head, sketch)))
        fresh_from = 0 if held is None else len(held[0])
        # est[o - 1, i]: likeness of rows i and i + o where they share a prefix; a row takes its best one on either side.
        n, out = len(tree), []
        est = np.full((NEIGHBOURS, n), -1, np.float32)
        # lcp[i]: components that rows i and i + 1 have in common from the first one on; over a distance, the least of them.
        lcp = np.logical_and.accumulate(head[:-1] == head[1:], axis=1).sum(axis=1)
        lcp[tree[:-1] != tree[1:]] = 0
        least = lcp
        for o in range(1, min(NEIGHBOURS, n - 1) + 1):
            least = lcp if o == 1 else np.minimum(least[:-1], lcp[o - 1 :])
            i = np.arange(max(0, fresh_from - o), n - o)
            i = i[(least[i] > 0) & (node[i] != node[i + o])]
            if len(i):
                est[o - 1, i] = (sketch[i] == sketch[i + o]).mean(axis=1, dtype=np.float32)
        ahead = est.max(axis=0)
        behind = np.full(n, -1, np.float32)
        for o in range(1, min(NEIGHBOURS, n - 1) + 1):
            np.maximum(behind[o:], est[o - 1, : n - o], out=behind[o:])
        for o in range(1, min(NEIGHBOURS, n - 1) + 1):
            e = est[o - 1, : n - o]
            i = np.flatnonzero((e >= ADJACENT) & ((e == ahead[: n - o]) | (e == behind[o:])))
            if len(i):
                out.append((np.minimum(node[i], node[i + o]), np.maximum(node[i], node[i + o]), e[i]))
        if out:
            a, b, e = (np.concatenate(x) for x in zip(*out))
            n = len(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), pa.array(a), pa.array(b), pa.array(e), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                ["kind", "a", "b", "est", "tree", "prefix", "sketch"],
            )
        held = tuple(x[-NEIGHBOURS:] for x in (tree, node, head, sketch))
        last = list(zip(*(batch.column(k).slice(max(0, batch.num_rows - NEIGHBOURS)).to_pylist() for k in range(4))))
        tail = ((tail or []) + last)[-NEIGHBOURS:]
    if tail:
        yield border(tail)


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, est): pairs of nodes that lie next to each other in some tree and are among the BEST of one of them."""
    # After a tree's own components come the low bytes of all, from the next tree's on.
    turned = F.expr(f"concat(substring(sketch, 1 + {DEPTH} * tree), substring(sketch, 1, {DEPTH} * tree))")
    orders = nodes.select(
        F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), F.col("node"), F.col("sig"), F.col("sketch")
    ).select("tree", "node", F.expr(f"substring(sig, 1 + {_WIDTH} * tree, {_WIDTH})").alias("prefix"), turned.alias("sketch"))
    order = ["tree", "prefix", "sketch", "node"]
    found = cut(
        orders.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, _PASS), "forest"
    )
    # 2 * NEIGHBOURS rows a partition, whatever the input: neighbours across partition borders.
    seams = found.filter("kind = 1").select("tree", F.col("a").alias("node"), "prefix", "sketch").distinct()
    seams = seams.coalesce(1).sortWithinPartitions(*order).mapInArrow(_neighbours, _PASS)
    pairs = found.union(seams).filter("kind = 0").groupBy("a", "b").agg(F.max("est").alias("est"))
    by = Window.partitionBy("x").orderBy(F.desc("est"), "y")
    best = _both_ways(pairs, "est").withColumn("k", F.row_number().over(by)).filter(F.col("k") <= BEST)
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "est").distinct()


def _confirm(batches):
    for batch in _slices(batches, 500):
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        where, texts = {}, []
        for ids, col in ((a, batch.column(2)), (b, batch.column(3))):
            for k, i in enumerate(ids):
                if i not in where:
                    where[i] = len(texts)
                    texts.append(col[k])
        sets = list(shingle_sets(pa.array([t.as_py() for t in texts], pa.large_string())))
        keep = []
        for x, y in zip(a, b):
            p, q = sets[where[x]], sets[where[y]]
            small = min(len(p), len(q))
            if 100 * small < SIMILARITY * max(len(p), len(q)):
                keep.append(False)
                continue
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= SIMILARITY * (len(p) + len(q) - both))
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
        yield out.filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach SIMILARITY on full shingle sets."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    full = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(_confirm, "a long, b long")


def _both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    way = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), *more)
    return pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()


def node_components(spark: SparkSession, docs: DataFrame, signed: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(node, component) of the nodes that have a confirmed link."""
    near = cut(candidates(nodes), "candidates")
    release(spark)
    texts = _texts(docs, nodes, near, text)
    release(spark)
    strong = near.filter(F.col("est") >= CONFIRM)
    best = _both_ways(strong, "est").groupBy("x").agg(F.max(F.struct("est", "y")).alias("m")).select("x", F.col("m.y").alias("y"))
    tried = cut(_ordered(best), "first-pairs")
    links = cut(confirm(tried, texts), "links")
    turn, wide, joined = 0, False, links
    while True:
        if joined is not None:
            comp = cut(components(joined), "components")
            before, near = near, cut(_crossing(near, comp), "candidates")
            drop_cut(before)
        todo = cut(_next_pairs(near, nodes, links, comp, wide).join(tried, ["a", "b"], "left_anti"), "more-pairs")
        more = cut(confirm(todo, texts), "more-links")
        if not more.isEmpty():
            turn += 1
            wide = wide or turn >= NARROW_ROUNDS
            # What is joined already comes in as stars, so the next components take few rounds.
            joined, links = _stars(comp).union(more), cut(links.union(more), "links")
        elif wide:
            break
        else:
            wide, joined = True, None  # the same components would give the same few pairs again
        tried = cut(tried.union(todo), "tried")
    drop_cut(texts)
    release(spark)
    rest = cut(_likely(_prefix_pairs(signed, nodes, comp), nodes, POSSIBLE), "rest-pairs")
    release(spark)
    more = cut(confirm(rest, _texts(docs, nodes, rest, text)), "rest-links")
    return comp if more.isEmpty() else cut(components(_stars(comp).union(more)), "components")


def _stars(comp: DataFrame) -> DataFrame:
    return comp.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """(node, text) of the nodes in pairs."""
    wanted = _members(nodes, pairs).select("node", F.col("text_hash").alias("_h"))
    slim = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64(F.col(text)).alias("_t"), F.col(text).alias("text"))
    return cut(
        # Dealt by both columns already, so no further shuffle.
        slim.join(wanted, (F.col("_d") == F.col("node")) & (F.col("_t") == F.col("_h"))).dropDuplicates(["_d", "_t"]).select("node", "text"),
        "near-texts",
    )


def _members(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes that are in pairs."""
    return nodes.join(_both_ways(pairs).select(F.col("x").alias("node")).distinct(), "node", "left_semi")


def _sets_of(signed: DataFrame, some: DataFrame) -> DataFrame:
    """Rows of some (node, text_hash, ...) with their sizes n and first shingles."""
    sets = signed.filter("n_shingles > 0").select(F.col("doc_id").alias("node"), "text_hash", F.col("n_shingles").cast("int").alias("n"), "first")
    return some.join(sets, ["node", "text_hash"]).dropDuplicates(["node", "text_hash"])


def _prefix_pairs(signed: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b): all pairs of nodes of two components that share one of their first shingles, by sizes and positions."""
    own = nodes.select("node", "text_hash").join(comp, "node", "left").select("node", "text_hash", F.when(F.col("component") != F.col("node"), F.col("component")).alias("c"))
    each = _sets_of(signed, own).select("node", "c", "n", F.posexplode("first").alias("i", "h"))
    # Size and position in one number, and no component where it is the node itself: most of these rows go no further.
    each = each.select("h", "node", "c", F.expr("shiftleft(cast(n as bigint), 32) + i").alias("ni"))
    n, i, c = F.expr("cast(shiftright(ni, 32) as int)"), F.expr("cast(ni & 4294967295 as int)"), F.coalesce("c", "node")
    # The smaller set of a pair has the shingle this early; a later one only serves against smaller sets.
    early = i * (100 + SIMILARITY) <= n * (100 - SIMILARITY)
    by = Window.partitionBy("h")
    of = lambda f, x: f(F.when(early, x)).over(by)
    seen = each.select("h", "node", c.alias("c"), n.alias("n"), i.alias("i"), early.alias("early"), F.min(c).over(by).alias("c0"), F.max(c).over(by).alias("c1"), of(F.min, c).alias("e0"), of(F.max, c).alias("e1"), of(F.min, n).alias("n0"))
    mixed = seen.filter("c0 <> c1 AND e0 IS NOT NULL AND (early OR (n >= n0 AND (e0 <> c OR e1 <> c)))").select("h", "node", "c", "n", "i")
    mixed = cut(mixed, "blocks")
    drop_cut(signed)  # the last use of the first shingles
    release(signed.sparkSession)
    # Pairs of components first: the members of one component are never held against each other.
    classes = cut(mixed.groupBy("h", "c").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("i").alias("i0")), "block-classes")
    fits = lambda xn, xm, xi, yn, ym, yi: F.expr(  # noqa: E731  from the least sizes, the largest ones and the first positions
        # A pair's first common shingle passes: what they have in common from there on suffices.
        f"100 * {xm} >= {SIMILARITY} * {yn} AND 100 * {ym} >= {SIMILARITY} * {xn}"
        f" AND {100 + SIMILARITY} * least({xm} - {xi}, {ym} - {yi}) >= {SIMILARITY} * ({xn} + {yn})"
    )
    meet = classes.alias("x").join(classes.alias("y"), F.expr("x.h = y.h AND x.c < y.c") & fits("x.n0", "x.n1", "x.i0", "y.n0", "y.n1", "y.i0"))
    meet = meet.select(F.col("x.h").alias("h"), F.col("x.c").alias("c"), F.col("y.c").alias("d"), *[F.col(f"y.{k}").alias(k) for k in ("n0", "n1", "i0")])
    one = mixed.select("h", "c", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("i").alias("xi"))
    left = meet.alias("m").join(one.alias("o"), F.expr("m.h = o.h AND m.c = o.c") & fits("xn", "xn", "xi", "n0", "n1", "i0")).select("m.h", "d", "x", "xn", "xi")
    right = mixed.select("h", F.col("c").alias("d"), F.col("node").alias("y"), F.col("n").alias("yn"), F.col("i").alias("yi"))
    pairs = left.alias("l").join(right.alias("r"), F.expr("l.h = r.h AND l.d = r.d") & fits("xn", "xn", "xi", "yn", "yn", "yi"))
    return cut(_ordered(pairs), "prefix-pairs")


def _crossing(near: DataFrame, comp: DataFrame) -> DataFrame:
    """The candidates (a, b, est) whose ends lie in two components."""
    of = lambda x, c: comp.select(F.col("node").alias(x), F.col("component").alias(c))
    both = near.select("a", "b", "est").join(of("a", "_ca"), "a", "left").join(of("b", "_cb"), "b", "left")
    both = both.select("a", "b", "est", F.coalesce("_ca", "a").alias("ca"), F.coalesce("_cb", "b").alias("cb"))
    return both.filter("ca <> cb")


def _next_pairs(crossing: DataFrame, nodes: DataFrame, links: DataFrame, comp: DataFrame, wide: bool) -> DataFrame:
    """(a, b): pairs that could join two components.

    For each node its best neighbour outside its component, and some hubs of that one's component; when wide, all its
    neighbours outside and all hubs of their components. Most components have met by the time of the first wide round.
    """
    degree = _both_ways(links).groupBy(F.col("x").alias("node")).agg(F.count("*").alias("degree"))
    share = F.pmod(F.xxhash64("node"), F.lit(HUBS))
    hubs = comp.join(degree, "node").groupBy("component", share.alias("share")).agg(F.max(F.struct("degree", -F.col("node"))).alias("m"))
    hubs = hubs.filter(F.lit(wide) | (F.col("share") < FIRST_HUBS))
    hubs = cut(hubs.select(F.col("component").alias("y_comp"), (-F.col("m").getField("col2")).alias("hub")), "hubs")
    side = lambda x, y, c: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(c).alias("y_comp"), "est")
    sides = crossing.select(F.explode(F.array(side("a", "b", "cb"), side("b", "a", "ca"))).alias("s")).select("s.*")
    if not wide:
        sides = sides.groupBy("x").agg(F.max(F.struct("est", "y", "y_comp")).alias("m")).select("x", "m.y", "m.y_comp", "m.est")
    direct = sides.filter(F.col("est") >= CONFIRM).select("x", "y")
    to_hub = sides.select("x", "y_comp").distinct().join(hubs, "y_comp").select("x", F.col("hub").alias("y"))
    return _ordered(direct).union(_likely(_ordered(to_hub), nodes, CONFIRM)).distinct()


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree in a share of at least `least`."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, TREES * DEPTH) for k in (2, 3))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
            yield out.filter(pa.array((x == y).mean(axis=1) >= least))

    of = lambda x, c: nodes.select(F.col("node").alias(x), F.col("sketch").alias(c))
    return pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_shingles, component_id, kept."""
    signed = cut(signatures(docs, text), "signatures")
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = some.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "text_hash", "sig", "sketch"), F.struct("doc_id", "text_hash")).alias("m"))
    nodes = cut(
        sets.select("set_key", F.col("m.doc_id").alias("node"), F.col("m.text_hash"), F.col("m.sig"), F.col("m.sketch")), "nodes"
    )
    own = cut(signed.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")), "documents")
    comp = node_components(spark, docs, signed, nodes, text)
    of_set = nodes.select("set_key", "node").join(comp, "node", "left").select(
        F.col("set_key").alias("_k"), F.coalesce("component", "node").alias("_c")
    )
    return own.join(of_set, F.col("set_key") == F.col("_k"), "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.coalesce("_c", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce(F.col("_c"), F.col("doc_id")) == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id; columns as they were.

    Rows that repeat both doc_id and text all stay or all go.
    """
    d, h = fresh(docs, "_id"), fresh(docs, "_hash")
    gone = near_duplicates(spark, docs).filter("NOT kept").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    hashed = docs.withColumn(h + "0", F.xxhash64("text"))
    left = hashed.join(gone, (F.col("doc_id").cast("long") == F.col(d)) & (F.col(h + "0") == F.col(h)), "left_anti")
    return left.select(*docs.columns)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
