import math
import random
from collections import Counter
from zlib import crc32

import pytest

from terracefold.llm import suffix_tree as st

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w] + [None]  # None: the end


def brute(rows, least, depth=st.DEPTH, discount=st.DISCOUNT):
    """Rows (doc_id, text) scored with dictionaries, as the docstring defines the model."""
    held = lambda i: i is not None and crc32(str(i).encode()) % 7 == 2
    texts = [(i, held(i), words(t)) for i, t in rows]
    train = [w for _, h, w in texts if not h]
    one = Counter(x for w in train for x in w)
    total, distinct = sum(one.values()), len(one)
    grams = {k: Counter(tuple(w[i : i + k]) for w in train for i in range(len(w) - k + 1)) for k in range(1, depth + 2)}
    grams = {k: {g: n for g, n in c.items() if n >= least and all(len((x or "").encode()) <= st.LONGEST for x in g)} for k, c in grams.items()}
    follow = {}
    for k in range(2, depth + 2):
        for g, n in grams[k].items():
            follow.setdefault(g[:-1], {})[g[-1]] = n
    left = {s: 1 - sum((n - discount) / grams[len(s)][s] for n in f.values()) for s, f in follow.items()}

    def p(s, w, states=None):
        while s and s not in (follow if states is None else states):
            s = s[1:]
        if not s:
            return (one[w] + 1) / (total + distinct + 1)
        return max(0, follow[s].get(w, discount) - discount) / grams[len(s)][s] + left[s] * p(s[1:], w, states)

    states = set()
    for s, f in follow.items():
        c = grams[len(s)][s]
        parents = {w: p(s[1:], w) for w in f}
        gone = sum(n / c * math.log(n / c / parents[w]) for w, n in f.items())
        rest = 1 - sum(f.values()) / c
        if rest > 0:
            gone += rest * math.log(rest / (1 - sum(parents.values())))
        if c * gone >= 0.5 * math.log(max(total, 2)) * (len(f) + 1):
            states |= {s[k:] for k in range(len(s))}
    out = []
    for i, h, w in texts:
        score = 0.0
        for t, x in enumerate(w):
            s = tuple(w[max(0, t - depth) : t])
            score += math.log10(p(s, x, states))
        out.append((i, h, len(w), sum(one[x] > 0 for x in w), total, sum(math.log10((one[x] + 1) / (total + distinct + 1)) for x in w), score))
    return out, states


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = r.sample(vocabulary, 12)
    rows = []
    for i in range(n):
        text = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            k = r.randint(0, len(text))
            text[k:k] = passage
        for _ in range(r.randint(0, 3)):
            text += r.choice([["a", "x", "y", "b"], ["c", "x", "y", "d"]])
        rows.append((i, r.choice([" ", "\n", "\t "]).join(x.upper() if r.random() < 0.1 else x for x in text)))
    return rows


def same(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, expected = sorted((tuple(r) for r in got), key=key), sorted(expected, key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected):
        assert g[5:] == pytest.approx(e[5:], rel=1e-9, abs=1e-9)


def test_against_dictionaries(spark):
    rows = corpus(5)
    expected, states = brute(rows, st.MINIMUM)
    assert {len(s) for s in states} == {1, 2, 3}
    same(st.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), expected)


def test_pieces_of_long_texts(spark, monkeypatch):
    """Texts split into pieces, and counts handed on often, give what whole texts give."""
    rows = [(i, (t + " ") * 6) for i, t in corpus(6, 60)]
    expected, _ = brute(rows, st.MINIMUM)
    for name, value in (("PIECE", 64), ("TOKENS", 500), ("WORDS", 20), ("ROWS", 7)):
        monkeypatch.setattr(st, name, value)
    tree = {}
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    # Workers import the module anew, so the bounds are set by calling its functions here.
    import pyarrow as pa

    train = [t for i, t in rows if crc32(str(i).encode()) % 7 != 2]
    batch = pa.RecordBatch.from_arrays([pa.array(train, pa.string())], ["text"])
    found = Counter()
    for b in st._word_counts([batch]):
        for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist()):
            found[w] += n
    whole = Counter((x or "").encode() for t in train for x in words(t))
    assert found == whole
    frequent = sorted(w for w, n in whole.items() if n >= st.MINIMUM)
    grams = st.Grams({w: k for k, w in enumerate(frequent)}, st.np.array([whole[w] for w in frequent]))

    class Sent:
        value = grams

    for k in range(2, st.DEPTH + 2):
        sums = Counter()
        for b in st._sequence_counts(Sent, k)([batch]):
            for key, n in zip(b["key"].to_pylist(), b["n"].to_pylist()):
                sums[key] += n
        keys = sorted(x for x, n in sums.items() if n >= st.MINIMUM)
        grams.keys.append(st.np.array(keys, st.np.int64))
        grams.counts.append(st.np.array([sums[x] for x in keys], st.np.int64))
    tree = st.Tree(grams, sum(whole.values()), len(whole))

    class Tree:
        value = tree

    marked = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([i for i, _ in rows], pa.int64()), pa.array([False] * len(rows)), pa.array([t for _, t in rows])], ["row", "doc_id", "held_out", "text"])
    score, tokens = Counter(), Counter()
    for b in st._scores(Tree)([marked]):
        for r in b.to_pylist():
            tokens[r["row"]] += r["n_tokens"]
            score[r["row"]] += r["score"] + r["n"] * math.log10((whole[r["word"]] + 1) / (tree.total + tree.distinct + 1))
    assert docs.count() == len(tokens)
    for k, e in enumerate(expected):
        assert tokens[k] == e[2]
        assert score[k] == pytest.approx(e[6], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tree, counts = st.fit(docs)
    vocabulary = [bytes(r.word) for r in counts.collect()]
    assert len(vocabulary) == len(tree.grams.words)  # all frequent here
    unknown = 1 / (tree.total + tree.distinct + 1)
    for history in ([], vocabulary[3:4], vocabulary[3:6], words(rows[1][1])[:5]):
        history = [w if isinstance(w, bytes) else w.encode() for w in history]
        ids, starts = tree.grams.ids([[*history, w] for w in [*vocabulary, b"never seen"]])
        p = 10 ** tree.log10(ids, starts)[starts[1:] - 1]
        p[-1] *= unknown
        assert p.sum() == pytest.approx(1)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    expected, _ = brute(rows, st.MINIMUM)
    got = st.scores(odd).select(*COLUMNS)
    same(got.collect(), expected)
    assert st.scores(none).columns == COLUMNS and st.scores(none).count() == 0


def test_without_training_rows(spark):
    i = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    got = st.scores(spark.createDataFrame([(i, "a b c")], "doc_id long, text string")).first()
    assert tuple(got) == (i, True, 4, 0, 0, 0.0, 0.0)


def test_held_out_texts_gain(spark):
    """On the small tables the tree says more of held-out texts than word counts do."""
    rows = st.op11_lm_scores(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_long_words_are_followers_and_contexts(spark, monkeypatch):
    """Words of any length have states; two with equal beginnings are two words."""
    long = ["x" * 70, "x" * 70 + "y", "é" * 50]
    rows = [(i, f"{t} a {long[0]} b {long[1]} {long[2]} a c {long[0]}") for i, t in corpus(8)]
    with monkeypatch.context() as m:
        m.setattr(st, "LONGEST", 1 << 20)
        expected, states = brute(rows, st.MINIMUM)
    assert {(w,) for w in long} <= states and ("a", long[0]) in states
    same(st.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), expected)


def test_distinct_words_of_a_block_are_looked_up_once():
    """Time for words is per distinct one (check tool: 1031 CPU seconds a GB where each token was looked up)."""
    import pyarrow as pa

    looked = []

    class Counted(dict):
        def get(self, word, *other):
            looked.append(word)
            return super().get(word, *other)

    texts = ["a b " * 500, None, "b c A " * 500]
    grams = st.Grams(Counted({b"": 0, b"a": 1, b"b": 2}), st.np.array([3, 1000, 1000]))

    class Sent:
        value = grams

    got = {k: n for b in st._sequence_counts(Sent, 2)([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]) for k, n in zip(b["key"].to_pylist(), b["n"].to_pylist())}
    pairs = Counter((x, y) for w in map(words, texts) for x, y in zip(w, w[1:]) if "c" not in (x, y))
    ids = {None: 0, "a": 1, "b": 2}
    assert got == {ids[x] * 3 + ids[y]: n for (x, y), n in pairs.items()}
    assert sorted(looked) == [b"", b"a", b"b", b"c"]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 22])
def test_blocks_hold_all_words(monkeypatch, piece):
    """Blocks split as the word rule does, at any size, with the words before a part as its context."""
    import pyarrow as pa

    monkeypatch.setattr(st, "PIECE", piece)
    texts = [None, "", " \n\t", "A", " Éa\u0085b\x1cc\x00 \x0b\x0cB ", " " * 100, "x" * 100, "y" * 90 + " z", "a b  c\r\nD " * 30, "é" * 40 + " q" * 40]
    got = [[] for _ in texts]
    for block in st.blocks(pa.array(texts, pa.string()), 3):
        listed = block.listed()
        for k, (a, b) in enumerate(zip(block.starts, block.starts[1:])):
            found, before = [listed[c].decode() for c in block.codes[a:b]], got[block.at + k]
            assert found[: block.skip] == before[len(before) - block.skip :] and block.skip == min(3, len(before))
            before += found[block.skip :]
    assert got == [[w or "" for w in words(t)] for t in texts]


def test_scores_of_parts_without_words(monkeypatch):
    """All batches that a task hands on have one schema, also for a part of blanks alone."""
    import pyarrow as pa

    monkeypatch.setattr(st, "PIECE", 8)
    tree = st.Tree(st.Grams({b"": 0, b"a": 1}, st.np.array([4, 9])), 14, 3)
    tree.left, tree.gain = [], [None]

    class Sent:
        value = tree

    texts = [" " * 30, "a " * 20, "b", ""]
    out = list(st._scores(Sent)([pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(range(4), pa.int64()), pa.array([False] * 4), pa.array(texts)], ["row", "doc_id", "held_out", "text"])]))
    assert len({str(b.schema) for b in out}) == 1
    tokens = Counter()
    for b in out:
        for r in b.to_pylist():
            tokens[r["row"]] += r["n_tokens"]
    assert tokens == {0: 1, 1: 21, 2: 2, 3: 1}
