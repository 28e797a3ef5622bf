import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from terracefold.llm import quality_rank as qr

WS = re.compile("[\x20\x09-\x0d]+")


def features(text):
    """The features of one text, counted one by one."""
    t = text or ""
    words = [w for w in WS.split(t) if w]
    n, lines = max(len(words), 1), len(t.split("\n"))
    told = [line for line in t.split("\n") if WS.sub("", line)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    count = lambda keep: sum(keep(c) for c in t)
    return {
        "log_words": math.log1p(len(words)),
        "word_length": min(sum(map(len, words)) / n, 50),
        "symbols": min(count(lambda c: c in "#*$%&|<>") / n, 5),
        "dup_lines": (len(told) - len(set(told))) / lines,
        "repeats": len(covered) / n,
        "upper": min(count(str.isupper) / n, 10),
        "exclaims": min(count(lambda c: c in "!?") / n, 5),
        "pipes": min(count(lambda c: c in "|_=~") / n, 5),
        "digits": min(count(lambda c: c in "0123456789") / n, 10),
        "punctuation": min(count(lambda c: c in ".,;:") / n, 5),
        "line_words": math.log1p(n / lines),
    }


def corpus(seed, n=160):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 2
        words = [r.choice(["lorem", "ipsum", "Dolor", "sit,", "amet.", "12", "a_b"] if good else ["BUY!!", "||", "now", "click", "$$$", "7"]) for _ in range(r.randint(0, 70))]
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        docs.append((i, "\n".join(lines + r.choices(lines or [""], k=r.randint(0, 3)))))
        labels.append((i, good if r.random() < 0.9 else 1 - good))
    return docs + [(900, None), (901, "")], labels


def test_features_one_by_one(spark):
    docs, _ = corpus(3)
    got = {r.doc_id: r.asDict() for r in qr.features(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        assert {k: got[i][k] for k in qr.FEATURES} == pytest.approx(features(text), abs=1e-9), (i, text)


def test_weights_are_where_the_pair_loss_is_least(monkeypatch):
    """Pair by pair: the gradient of the regularised loss vanishes, and no step nearby is better."""
    monkeypatch.setattr(qr, "PAIRS", 300)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=60) > 0).astype(int)
    mean, scale, w, threshold = qr.fit(x, y)
    z = np.clip((x - mean) / scale, -8, 8)
    again = np.random.default_rng(7)
    pairs = list(zip(again.choice(np.flatnonzero(y == 1), 300), again.choice(np.flatnonzero(y == 0), 300)))

    def loss(v):
        return sum(math.log1p(math.exp(-float((z[a] - z[b]) @ v))) for a, b in pairs) / len(pairs) + qr.RIDGE / 2 * float(v @ v)

    for k in range(4):
        for step in (1e-3, -1e-3):
            assert loss(w) <= loss(w + step * np.eye(4)[k])
    ranked = sorted(float(s) for s in z @ w)
    share = (y == 0).sum() / 60
    assert ranked[int(share * 59)] <= threshold <= ranked[int(share * 59) + 1]


def test_scores_against_the_formula(spark):
    docs, labels = corpus(4)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in qr.scores(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = {i: crc32(str(i).encode()) % 5 == 0 for i, _ in docs}
    made = {i: [features(t)[f] for f in qr.FEATURES] for i, t in docs}
    known = dict(labels)
    train = {i for i in known if not held[i]}
    rows = {r.doc_id: r.asDict() for r in qr.features(frame).collect()}
    order = [r.doc_id for r in frame.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").collect() if r.doc_id in train]
    mean, scale, w, threshold = qr.fit(np.array([[rows[i][f] for f in qr.FEATURES] for i in order]), np.array([known[i] for i in order]))
    for i, _ in docs:
        rank = float(np.clip((np.array(made[i]) - mean) / scale, -8, 8) @ w)
        score = 1 / (1 + math.exp(-(rank - threshold + math.log(qr.CUT / (1 - qr.CUT)))))
        assert got[i].held_out == held[i]
        assert got[i].score == pytest.approx(score, abs=1e-6)
        assert got[i].predicted == int(got[i].score >= 0.3)
