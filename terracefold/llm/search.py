"""Ranked lexical search over an index whose documents are clustered by recursive graph bisection.

Order. Bisection (halves of documents swap members while that shortens the gaps of their terms' postings) is fitted on at
most 2 * SAMPLE documents, each by its FEATURES terms of least hash, and leaves a tree: a node weighs terms by how much
commoner they are in its left half, and parts documents at the sample's median of their mean weight. Every document
walks down the tree by all its terms; leaves that the sample expects to be large are dealt into pieces by hash, and each piece
is cut, in order of doc_id, into shards of at most SHARD documents. So similar documents share a shard, no task holds
more than one, and a group of copies that holds a third of all rows makes many shards of one kind.

Index. One row per shard and term: places of documents in the shard, occurrences, document lengths; one row per shard
(with the empty term) maps places back to doc_id. All terms of all documents are indexed.

Search. A shard's bound for an item is the sum of its largest contribution for each of the item's terms. Items visit their
shards by falling bound, in rounds four times as wide each time, and stop when no unvisited bound reaches the TOPth score
found; an equal bound is visited, as the smaller doc_id wins ties. So the result is that of scoring every document.
A shard is scored in one numpy pass per item; it hands on its TOP best, so nothing of the size of the matches is shuffled.

Scores: see score_of(). Defined results: a null or empty text has no terms; such documents are not counted and such items
find nothing. Each row of documents is a document of its own, also if its doc_id is null (first in ties) or repeated.
Equal rows (item_id, text) are one item; items of one item_id with different texts are ranked apart. Empty tables
give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

TOP = 10
#: Documents in a shard at most; documents of the sample (twice as many at most), term hashes of each at most, hash buckets, levels.
SHARD, SAMPLE, FEATURES, BUCKETS, LEVELS = 1024, 4096, 4096, 1 << 14, 8
#: Items that one group of a round holds at a time; bytes of text that are split at a time.
ITEMS, PIECE = 4096, 1 << 22
#: Texts of which a task holds the terms at a time.
ROWS = 128
#: ASCII letters in lower case and digits stay, other ASCII parts terms, all else belongs to terms.
_MAP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def counts(text: str | None) -> Counter:
    """Occurrences of each term of a whole text."""
    data, found, at = (text or "").encode().translate(_MAP), Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def buckets(terms) -> np.ndarray:
    return np.fromiter((crc32(t) % BUCKETS for t in terms), np.int64, len(terms))


# ---------------------------------------------------------------- order


def _sketches(batches):
    """The FEATURES least term hashes of each document, as buckets."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            least = sorted(crc32(t) for t in counts(text))[:FEATURES]
            rows.append([h % BUCKETS for h in least])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["b"])


def _bisect(rows: list[np.ndarray]) -> tuple[np.ndarray, float] | None:
    """(weights by bucket, where to part) after swapping documents between halves; None if they can't be told apart."""
    n = len(rows)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    terms = np.concatenate(rows)
    left = np.arange(n) < n // 2
    sizes = (n // 2, n - n // 2)
    for _ in range(12):
        a = np.bincount(terms[left[of]], minlength=BUCKETS).astype(float)
        b = np.bincount(terms[~left[of]], minlength=BUCKETS).astype(float)
        cost = lambda x, y: x * np.log2(sizes[0] / (x + 1)) + y * np.log2(sizes[1] / (y + 1))
        now = cost(a, b)
        to_right = now - cost(np.maximum(a - 1, 0), b + 1)
        to_left = now - cost(a + 1, np.maximum(b - 1, 0))
        gain = np.bincount(of, np.where(left[of], to_right[terms], to_left[terms]), n)
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        x, y = x[np.argsort(-gain[x], kind="stable")], y[np.argsort(-gain[y], kind="stable")]
        k = min(len(x), len(y))
        swaps = int((gain[x[:k]] + gain[y[:k]] > 1e-9).sum())
        if not swaps:
            break
        left[x[:swaps]], left[y[:swaps]] = False, True
    weights = (np.log2((a + 1) / sizes[0]) - np.log2((b + 1) / sizes[1])).astype(np.float32)
    means = np.bincount(of, weights[terms], n) / np.maximum(np.bincount(of, minlength=n), 1)
    middle = float(np.median(means))
    return (weights, middle) if (means > middle).any() else None


class Order:
    """The tree, and into how many pieces each leaf is dealt."""

    def __init__(self, rows: list[np.ndarray], docs: int):
        self.weights, self.parts, self.kids = [], [], []
        self.pieces: list[int] = []
        levels = min(LEVELS, max(0, math.ceil(math.log2(max(docs, 1) / SHARD))))
        self.root = self._grow(rows, levels, docs / max(len(rows), 1))
        self.weights = np.array(self.weights, np.float32).reshape(-1, BUCKETS)

    def _grow(self, rows, levels: int, scale: float) -> int:
        """Index of a node, or -1 - leaf."""
        made = _bisect(rows) if levels and len(rows) >= 16 else None
        if made is None:
            self.pieces.append(max(1, math.ceil(len(rows) * scale / SHARD)))
            return -len(self.pieces)
        k = len(self.kids)
        self.weights.append(made[0])
        self.parts.append(made[1])
        self.kids.append((0, 0))
        goes = [float(made[0][r].mean()) > made[1] for r in rows]
        self.kids[k] = tuple(self._grow([r for r, g in zip(rows, goes) if g == side], levels - 1, scale) for side in (True, False))
        return k

    def place(self, docs: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """(leaf, piece of it) of each document, given its terms' buckets and a hash of it."""
        n = len(docs)
        size = np.array([len(d) for d in docs])
        of, terms = np.repeat(np.arange(n), size), np.concatenate([np.zeros(0, np.int64), *docs])
        at = np.full(n, self.root)
        kids, parts = np.array(self.kids or [(0, 0)]), np.array(self.parts or [0.0])
        while (at >= 0).any():
            on = at[of] >= 0
            mean = np.bincount(of[on], self.weights[at[of[on]], terms[on]], n) / size
            inner = np.maximum(at, 0)  # leaves are met at several depths, and there may be more of them than nodes
            at = np.where(at < 0, at, np.where(mean > parts[inner], kids[inner, 0], kids[inner, 1]))
        return -1 - at, hashes % np.array(self.pieces)[-1 - at]


def fit_order(docs: DataFrame) -> Order:
    n = docs.count()
    if not n:
        return Order([], 0)
    share = min(1.0, SAMPLE / n)
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    rows = chosen.mapInArrow(_sketches, "b array<int>").filter("size(b) > 0").limit(2 * SAMPLE).collect()
    return Order([np.array(r.b) for r in rows], n)


# ---------------------------------------------------------------- index

_VECTOR = "leaf long, piece long, doc_id long, n long, terms array<binary>, tfs array<int>"
_INDEX = "shard long, term binary, ords array<int>, tfs array<int>, ns array<int>, ids array<long>"


def _vectors(order):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                ids, texts, hashes = (c.to_pylist() for c in batch.slice(start, ROWS).columns)
                found = [(i, h, c) for i, t, h in zip(ids, texts, hashes) if (c := counts(t))]
                if not found:
                    continue
                leaves, pieces = order.value.place([buckets(c) for _, _, c in found], np.array([h for _, h, _ in found]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(leaves, pa.int64()),
                        pa.array(pieces, pa.int64()),
                        pa.array([i for i, _, _ in found], pa.int64()),
                        pa.array([c.total() for _, _, c in found], pa.int64()),
                        pa.array([list(c) for _, _, c in found], pa.list_(pa.binary())),
                        pa.array([list(c.values()) for _, _, c in found], pa.list_(pa.int32())),
                    ],
                    ["leaf", "piece", "doc_id", "n", "terms", "tfs"],
                )

    return run


def _inverted(shard: int, docs: pa.Table) -> pa.Table:
    """Postings of the documents of one shard, by term and then place, after a row that maps places to doc_id."""
    terms = docs["terms"].combine_chunks()
    sizes = np.diff(terms.offsets.to_numpy())
    flat = terms.flatten().dictionary_encode()
    codes = flat.indices.to_numpy()
    ords = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    by = np.argsort(codes, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(flat.dictionary)))]).astype(np.int32)
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
    n = docs["n"].to_numpy()
    rows = len(flat.dictionary)
    out = pa.table(
        {
            "shard": pa.array(np.full(rows, shard), pa.int64()),
            "term": flat.dictionary,
            "ords": lists(ords[by], pa.int32()),
            "tfs": lists(docs["tfs"].combine_chunks().flatten().to_numpy()[by], pa.int32()),
            "ns": lists(n[ords[by]].astype(np.int32), pa.int32()),
            "ids": pa.nulls(rows, pa.list_(pa.int64())),
        }
    )
    head = pa.table([pa.array([shard], pa.int64()), pa.array([b""], pa.binary()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.array([n.tolist()], pa.list_(pa.int32())), pa.array([docs["doc_id"].to_pylist()], pa.list_(pa.int64()))], schema=out.schema)
    return pa.concat_tables([head, out])


def _shards(batches):
    """Indexes of runs of up to SHARD documents of a piece; rows come sorted by piece and doc_id."""
    held, size, run, number = [], 0, None, 0

    def made():
        nonlocal held, size, number
        out = _inverted((run[0] << 44) + (run[1] << 22) + number, pa.Table.from_batches(held).combine_chunks())
        held, size, number = [], 0, number + 1
        return out.to_batches(max_chunksize=50_000)

    for batch in batches:
        leaf, piece = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        turns = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(piece) != 0)) + 1
        for a, b in zip([0, *turns], [*turns, batch.num_rows]):
            if size and run != (leaf[a], piece[a]):
                yield from made()
            if run != (leaf[a], piece[a]):
                run, number = (int(leaf[a]), int(piece[a])), 0
            while a < b:
                take = int(min(b - a, SHARD - size))
                held.append(batch.slice(a, take))
                size, a = size + take, a + take
                if size == SHARD:
                    yield from made()
    if size:
        yield from made()


def build_index(docs: DataFrame) -> DataFrame:
    """The clustered index of docs (doc_id, text) as a table in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = docs.sparkSession.sparkContext.broadcast(fit_order(rows))
    hashed = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    vectors = hashed.mapInArrow(_vectors(order), _VECTOR)
    dealt = vectors.repartition("leaf", "piece").sortWithinPartitions("leaf", "piece", F.asc_nulls_first("doc_id"))
    return cut(dealt.mapInArrow(_shards, _INDEX), "index")


# ---------------------------------------------------------------- search


def score_of(tf: Column, n: Column, docs: int, total: int) -> Column:
    """What a weight of 1 gains by tf occurrences in a document of n terms, of docs documents with total terms, in whole numbers."""
    m = F.lit(10) + F.call_function("div", n * F.lit(90 * docs), F.lit(total))
    return F.call_function("div", tf * F.lit(1_000_000_000), tf * F.lit(1000) + m * F.lit(8))


def _item_terms(batches):
    for batch in batches:
        item, texts = (c.to_pylist() for c in batch.columns)
        rows = [(i, t) for i, text in zip(item, texts) for t in counts(text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["item", "term"])


def _scored(postings: pa.Table, visits: pa.Table) -> pa.Table:
    """The TOP best (item, shard, ord, score) of each visiting item in one shard; those below its floor are left out."""
    out: list[tuple] = []
    if postings.num_rows and visits.num_rows:
        shard = postings["s"][0].as_py()
        lists, gains = postings["ords"].combine_chunks(), postings["gains"].combine_chunks()
        ends, ords, gain = lists.offsets.to_numpy(), lists.flatten().to_numpy(), gains.flatten().to_numpy()
        lo = ends[0]
        slices = {t: (ords[a - lo : b - lo], gain[a - lo : b - lo] * w) for t, w, a, b in zip(postings["term_id"].to_pylist(), postings["w"].to_pylist(), ends, ends[1:])}
        size = int(ords.max()) + 1
        for item, floor, terms in zip(*(visits[c].to_pylist() for c in ("item", "floor", "terms"))):
            total = np.zeros(size, np.int64)
            for t in terms:
                if t in slices:
                    o, g = slices[t]
                    total[o] += g  # a term has a place once
            least = max(1, floor)
            if size > TOP:
                least = max(least, int(np.partition(total, size - TOP)[size - TOP]))
            best = np.flatnonzero(total >= least)
            best = best[np.argsort(-total[best], kind="stable")][:TOP]
            out += [(item, shard, int(o), int(total[o])) for o in best]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["item", "shard", "ord", "score"])


_HITS = "item long, shard long, ord int, score long"


def search(index: DataFrame, items: DataFrame, top_rounds: int = 4) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP best documents of an index for each row of items (item_id, text).

    top_rounds: shards that each item visits in the first round; later rounds reach four times as far.
    """
    spark = items.sparkSession
    heads = index.filter(F.col("term") == F.lit(b"")).select("shard", "ids", "ns")
    docs, total = heads.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    asked = cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    pairs = cut(asked.select("item", "text").mapInArrow(_item_terms, "item long, term binary"), "item-terms")
    wanted = pairs.select("term").distinct()
    found = index.join(wanted, "term", "left_semi")
    df = found.groupBy("term").agg(F.sum(F.size("ords")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    terms = cut(df.select(F.monotonically_increasing_id().alias("term_id"), "term", weight.alias("w")), "terms")
    gains = F.zip_with("tfs", "ns", lambda tf, n: score_of(tf.cast("long"), n.cast("long"), docs, max(total, 1)))
    postings = cut(index.join(terms, "term").select("shard", "term_id", "w", "ords", gains.alias("gains")), "postings")
    known = pairs.join(terms.select("term", "term_id"), "term").select("item", "term_id")
    tops = postings.select("shard", "term_id", (F.col("w") * F.array_max("gains")).alias("most"))
    bounds = known.join(tops, "term_id").groupBy("item", "shard").agg(F.sum("most").alias("bound")).filter("bound > 0")
    bounds = cut(bounds.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))), "bounds")
    lists = cut(known.groupBy("item").agg(F.collect_list("term_id").alias("terms")), "lists")
    blocks = max(1, math.ceil(lists.count() / ITEMS))
    best = spark.createDataFrame([], "item long, shard long, ord int, score long, doc_id long")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "shard", "ord")
    least, reach, last = 0, top_rounds, bounds.agg(F.max("place")).first()[0] or 0
    while least < last:
        floors = best.groupBy("item").agg(F.when(F.count("*") >= TOP, F.min("score")).otherwise(0).alias("floor"))
        open_ = bounds.filter((F.col("place") > least) & (F.col("place") <= reach)).join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
        visits = open_.filter(F.col("bound") >= F.col("floor")).join(lists, "item").select("shard", F.pmod("item", F.lit(blocks)).alias("block"), "item", "floor", "terms")
        visits = cut(visits, "visits")
        seen = visits.select(F.col("shard").alias("s"), F.col("block").alias("b")).distinct()
        seen = postings.join(seen, F.col("shard") == F.col("s")).select("s", "b", "term_id", "w", "ords", "gains")
        hits = seen.groupBy("s", "b").cogroup(visits.groupBy("shard", "block")).applyInArrow(_scored, _HITS)
        places = heads.select("shard", F.posexplode("ids").alias("ord", "doc_id"))
        named = hits.join(places, ["shard", "ord"]).select("item", "shard", "ord", "score", "doc_id")
        best = cut(best.unionByName(named).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= TOP).drop("rank"), "best")
        least, reach = reach, 4 * reach
    return best.withColumn("rank", F.row_number().over(ranked)).join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
#: Scores every document; for tables whose doc_id and item_id are unique.
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
nl AS (SELECT count(*)::BIGINT AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, t, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n FROM (SELECT doc_id, unnest(ts) AS t, len(ts) AS n FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, nl GROUP BY t, nn),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t), nl GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
