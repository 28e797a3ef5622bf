import math
import random
import re
from collections import Counter

from oracle import expected, rows

from terracefold.llm import search

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, items):
    """(item_id, rank, doc_id, score) by scoring each document."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for i, b, n in bags:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in {*TERM.findall((text or "").translate(LOWER))} if t in b)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, k, f[-1], -f[0]) for k, f in enumerate(sorted(found)[:10], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items):
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    return sorted((tuple(r) for r in search.search(index, spark.createDataFrame(items, "item_id long, text string"), top_rounds=1).collect()), key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"W{k}" for k in range(300)] + ["éa", "naïve", "x1", "Ünder"]
    passage = " ".join(r.sample(words, 25))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words[: r.choice([10, 60, 304])]) for _ in range(r.randint(0, 60)))
        rows.append((i, r.choice([text, text, text + "--" + passage, passage])))
    return rows, [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for k in range(12)] + [(50, passage)]


def test_query_against_sql(spark):
    assert rows(search.op13_lexical_search(spark, SF).toPandas()) == rows(expected(search.SQL, SF))


def test_against_every_document(spark, monkeypatch):
    """Many small shards, with copies enough to fill several, and several rounds."""
    monkeypatch.setattr(search, "SHARD", 40)
    docs, items = corpus(3, 900)
    order = search.fit_order(spark.createDataFrame(docs, "doc_id long, text string"))
    assert len(order.kids) >= 8 and max(order.pieces) > 1
    assert got(spark, docs, items) == brute(docs, items)


def test_copies_share_their_rank_by_id(spark):
    docs = [(i, "same words here") for i in range(100, 0, -1)]
    found = got(spark, docs, [(1, "same words")])
    assert [(r[1], r[2]) for r in sorted(found, key=lambda r: r[1])] == [(k, k) for k in range(1, 11)]


def test_odd_rows(spark, odd, none):
    items = [(1, "quick FOX"), (2, ""), (3, None), (None, "é😀"), (1, "quick FOX"), (1, "one"), (4, "... --")]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS rank", "3 AS score")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    index = search.build_index(odd)
    found = sorted((tuple(r) for r in search.search(index, frame).collect()), key=repr)
    assert found == brute(docs, items)
    assert search.search(search.build_index(none), frame).collect() == []
    assert search.search(index, frame.limit(0)).collect() == []


def test_long_text_in_pieces(monkeypatch):
    text = "Abc de-fé " * 500
    whole = search.counts(text)
    monkeypatch.setattr(search, "PIECE", 16)
    assert search.counts(text) == whole == {b"abc": 500, b"de": 500, "fé".encode(): 500}


def test_leaves_at_several_depths():
    """A document that rests on the last leaf, numbered past the nodes, while another still walks."""
    order = search.Order([], 0)
    order.weights = search.np.zeros((2, search.BUCKETS), search.np.float32)
    order.weights[0, 1], order.weights[1, 2] = -1, 1
    order.kids, order.parts, order.pieces, order.root = [(1, -3), (-1, -2)], [-0.5, 0.5], [1, 1, 2], 0
    leaves, pieces = order.place([search.np.array([1]), search.np.array([2]), search.np.array([3])], search.np.array([5, 6, 7]))
    assert leaves.tolist() == [2, 0, 1] and pieces.tolist() == [1, 0, 0]
