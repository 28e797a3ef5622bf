import random

import numpy as np
import pyarrow as pa

from terracefold.llm import graph, minhash
from terracefold.llm.common import cut
from terracefold.llm.shingles import shingle_sets


def brute(rows):
    """component and set size of (doc_id, text) rows with distinct ids."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    ws = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
    sets = {}
    for i, t in rows:
        w = [x for x in (t or "").translate(lower).translate(ws).split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    passage = r.sample(words, 60)
    rows, n = [], 0
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(1, 150))]
        for _ in range(r.choice([1, 1, 2, 6, 20])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                t[r.randrange(len(t))] = r.choice(words)
            if r.random() < 0.3:
                t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
            rows.append((n, " ".join(t)))
            n += 1
    return rows


def test_against_all_pairs(spark):
    rows = corpus(3)
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark, odd, none):
    got = minhash.near_duplicates(spark, odd).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(9, 1, True)] * 2 and by[2] == [(9, 1, False)] and by[None] == [(9, None, True)]
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[6] == [(1, 6, True)] and by[7] == [(1, 6, False)]
    assert minhash.near_duplicates(spark, none).count() == 0
    kept = minhash.keep_one(spark, odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "4", "5", "6", "8", "9", "None"]


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_do_not_cross_texts():
    a, b = shingle_sets(pa.array(["a b c d e", "f g h i j"]))
    assert len(a) == len(b) == 1
    assert [len(s) for s in shingle_sets(pa.array(["a b c d", None, "e f"]))] == [1, 0, 1]


def test_links_without_any_candidate(spark, monkeypatch):
    monkeypatch.setattr(minhash, "candidates", lambda nodes: spark.createDataFrame([], "a long, b long, est float"))
    rows = corpus(4)
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def crowded(seed, n):
    """Texts around one text: most pairs are just below the threshold, each third text has a partner above it."""
    r = random.Random(seed)
    base = ["b%d" % k for k in range(120)]
    rows = []
    while len(rows) < n:
        t = list(base)
        for _ in range(r.randint(2, 5)):
            t[r.randrange(len(t))] = "x%d" % r.randrange(10**6)
        rows.append(" ".join(t))
        if len(rows) % 3 == 0:
            t[r.randrange(len(t))] = "y%d" % r.randrange(10**6)
            rows.append(" ".join(t))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_no_link_is_lost_in_a_crowded_region(spark):
    rows = crowded(5, 1500)
    sets = list(shingle_sets(pa.array([t for _, t in rows])))
    names = {h: k for k, h in enumerate(sorted({int(h) for s in sets for h in s}))}
    has = np.zeros((len(rows), len(names)), np.float32)
    for k, s in enumerate(sets):
        has[k, [names[int(h)] for h in s]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    linked = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in np.argwhere(np.triu(linked, 1)):
        p, q = find(int(a)), find(int(b))
        parent[max(p, q)] = min(p, q)
    want = {k: find(k) for k in range(len(rows))}
    assert len(set(want.values())) > 20
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_words_of_a_regular_pattern_are_told_apart():
    flip = {"a": "b", "b": "a"}
    word = "a"
    while len(word) < 2048:
        word += "".join(flip[c] for c in word)
    a, b = shingle_sets(pa.array([word, "".join(flip[c] for c in word)]))
    assert a[0] != b[0]
    x, y = shingle_sets(pa.array(["One two\tthree four five six", "one  TWO three\nfour five six"]))
    assert len(x) == 2 and set(x) == set(y)


def test_plans_of_the_rounds_stay_small(spark, monkeypatch):
    """The driver keeps each plan, with its changes as it runs: no round holds the steps before it several times."""
    sizes = []

    def spy(df, name, *more):
        sizes.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange "), name))
        return cut(df, name, *more)

    monkeypatch.setattr(graph, "cut", spy)
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    stars = spark.createDataFrame(links[:100], "a long, b long").union(spark.createDataFrame(links[100:], "a long, b long"))
    got = {r.node: r.component for r in graph.components(stars).collect()}
    want = {x: x for p in links if p[0] != p[1] for x in p}
    for _ in range(300):
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert max(sizes)[0] <= 5


def test_rounds_without_new_links_are_not_repeated(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(minhash, "components", lambda links: calls.append(1) or graph.components(links))
    rows = [(i, " ".join(f"g{i // 2}w{k}" for k in range(40)) + " end" * (i % 2)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, docs).collect()}
    assert got == {i: i - i % 2 for i in range(20)}
    assert len(calls) == 1
