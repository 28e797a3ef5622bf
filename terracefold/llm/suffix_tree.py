"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of one to DEPTH words. A context of k words is a candidate if it occurs in at least a share RARE of the
training tokens (MINIMUM times at least), so there are at most 1 / RARE of each length whatever the corpus; its
followers are the words that follow it as often. A candidate stays if its followers diverge from what the next
shorter context says of them: its count times the Kullback-Leibler divergence (all other words as one) must reach
half a logarithm of the training tokens for each follower and one. Suffixes of states are states.

A state's next-word distribution is smoothed by absolute discounting: (count - DISCOUNT) / count of the context for a
follower, and what is left times the distribution of the next shorter context; at the root (c + 1) / (N + V + 1), which
leaves one share for unknown words. So probabilities sum to one in each state. A word is scored by the longest suffix of
the words before it that is a state.

Counts run over all training tokens: words first, then sequences, longer by a word each round, of which both parts were
frequent. Tasks split texts in Arrow, block by block, look each distinct word of a block up once, count in bounded
tables and hand on sums. The frequent sequences, bounded as above, go to the driver and as sorted arrays to the
tasks, where texts are scored block by block. Words that are not frequent gain nothing from a state, so their part is only a product of the states' left shares; their counts are joined in one shuffle by word.

Defined results: a null text is empty and has one token, the end. A null doc_id trains. Rows that repeat a doc_id are
scored, and train, each for itself. Without training rows N is 0 and every token scores log10(1) = 0. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Words of a context at most; share of the training tokens, and number, from which a sequence is frequent; discount.
DEPTH, RARE, MINIMUM, DISCOUNT = 3, 1e-6, 4, 0.75
FOLDS, HELD = 7, 2
#: Bytes of texts split at a time; tokens, and distinct words, that a task counts before it hands on sums; longest word held as it is.
PIECE, TOKENS, WORDS, LONGEST = 1 << 22, 1 << 21, 400_000, 64
#: Texts that are scored at a time.
ROWS = 1000
END = ""
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


@dataclass
class Block:
    """Words of consecutive texts, or of a part of one: the place of the first text, each text's words as places in the distinct
    ones, the starts of the texts and the end of the last, and how many words of the part before a part begins with."""

    at: int
    words: pa.Array
    codes: np.ndarray
    starts: np.ndarray
    skip: int = 0

    def listed(self) -> list[bytes]:
        return self.words.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each


def _split(texts: pa.Array, at: int, skip: int = 0, last: bool = True) -> Block:
    """The words of texts, END as the last of each, but of a part that is not the last of its text."""
    # After the blank at its end a text splits off an empty word, which is END; an empty text is that word alone.
    lists = pc.ascii_split_whitespace(pc.ascii_ltrim_whitespace(pc.binary_join_element_wise(pc.ascii_rtrim_whitespace(pc.ascii_lower(texts)), END, " ")))
    words, starts = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
    codes = words.indices.to_numpy()
    if not last:
        codes, starts = codes[:-1], np.array([0, len(codes) - 1])
    return Block(at, words.dictionary.cast(pa.binary()), codes, starts, skip)


def blocks(texts: pa.Array, back: int = 0):
    """Blocks of texts (null: empty) of up to PIECE bytes; a longer text is cut at white space, and each further part begins
    with up to back words before it."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        end = int(np.searchsorted(ends, done + PIECE, "right"))
        if end > at:
            yield _split(texts.slice(at, end - at), at)
        else:
            end = at + 1
            yield from _parts(texts[at].as_py().encode(), at, back)
        at = end


def _parts(data: bytes, at: int, back: int):
    tail: list[bytes] = []
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > PIECE:
            space = WHITE.search(data, start + PIECE)
            end = space.start() if space else end
        part = data[start:end]
        yield _split(pa.array([b" ".join([*tail, part]).decode()]), at, len(tail), end == len(data))
        tail = (tail + part.rsplit(None, back)[-back:])[-back:] if back else []
        start = end


# ---------------------------------------------------------------- counts


def _word_counts(batches):
    found: Counter = Counter()

    def made():
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        found.clear()
        return out

    for batch in batches:
        for block in blocks(batch.column(0)):
            found.update(dict(zip(block.listed(), np.bincount(block.codes, minlength=len(block.words)).tolist())))
            if len(found) > WORDS:
                yield made()
    if found:
        yield made()


def held(word: bytes) -> bytes:
    """How the model holds a word: over LONGEST bytes as a blank, with which no word begins, and its SHA-256 digest."""
    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).digest()


class Grams:
    """Frequent sequences: words as ids from 0 on, and for each length k from 2 on the sorted keys (id of the first k - 1
    words as a sequence) * words + id of the last, with counts. A sequence's id is its place. Words are as held() gives them."""

    def __init__(self, words: dict[bytes, int], counts: np.ndarray):
        self.words, self.counts, self.keys, self.last = words, [counts], [None], None
        self.digests = any(w[:1] == b" " for w in words)

    def block_ids(self, block: Block) -> np.ndarray:
        """Word ids of a block's words: the distinct ones are looked up."""
        return self.ids([block.listed()])[0][block.codes]

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of lists of words (-1: not frequent), and the starts of the lists."""
        get = self.words.get
        each = list(chain.from_iterable(texts))
        flat = np.fromiter(map(get, each, repeat(-1)), np.int64, len(each))
        if self.digests:  # Long words are not found as they are.
            for k in np.flatnonzero(np.fromiter(map(len, each), np.int64, len(each)) > LONGEST).tolist():
                flat[k] = get(held(each[k]), -1)
        return flat, np.cumsum([0, *map(len, texts)])

    def longer(self, before: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keys of the sequences that extend those that end at the position before by the word at each position, else -1."""
        prior = np.empty_like(before)
        prior[1:] = before[:-1]
        prior[starts[starts < len(prior)]] = -1
        return np.where((prior >= 0) & (ids >= 0), prior * len(self.words) + ids, -1)

    def find(self, k: int, key: np.ndarray) -> np.ndarray:
        """Place of each key among the sequences of k words, else -1."""
        keys, out = self.keys[k - 1], np.full(len(key), -1, np.int64)
        on = np.flatnonzero(key >= 0)
        if len(keys) and len(on):
            at = np.minimum(np.searchsorted(keys, key[on]), len(keys) - 1)
            out[on] = np.where(keys[at] == key[on], at, -1)
        return out

    def ends(self, ids: np.ndarray, starts: np.ndarray, most: int) -> list[np.ndarray]:
        """For each length up to most the sequence that ends at each position; those with END end no context."""
        out = [ids]
        for k in range(2, most + 1):
            out.append(self.find(k, self.longer(out[-1], ids, starts)))
        return out


def _sequence_counts(grams, k: int):
    """Counts of the candidates of k words in bounded blocks of tokens."""

    def run(batches):
        waiting, size = [], 0

        def made():
            g = grams.value
            ids = np.concatenate([w for w, _ in waiting])
            before = np.cumsum([0, *(len(w) for w, _ in waiting)])
            starts = np.concatenate([s + b for (_, s), b in zip(waiting, before)])
            key = g.longer(g.ends(ids, starts, k - 1)[-1], ids, starts)
            keys, n = np.unique(key[key >= 0], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

        for batch in batches:
            for block in blocks(batch.column(0), k - 1):  # too few words before a part to be counted again
                waiting.append((grams.value.block_ids(block), block.starts))
                size += len(block.codes)
                if size > TOKENS:
                    yield made()
                    waiting, size = [], 0
        if waiting:
            yield made()

    return run


def frequent_sequences(train: DataFrame, counts: DataFrame, least: int) -> Grams:
    """The sequences of up to DEPTH + 1 words that occur least times or more in train (text); counts: (word, c) of all words."""
    spark = train.sparkSession
    digest = F.concat(F.lit(" ").cast("binary"), F.unhex(F.sha2("word", 256)))
    words = counts.filter(F.col("c") >= least).select(F.when(F.length("word") <= LONGEST, F.col("word")).otherwise(digest).alias("word"), "c").toArrow().sort_by("word")
    grams = Grams({w: k for k, w in enumerate(words["word"].to_pylist())}, words["c"].to_numpy())
    for k in range(2, DEPTH + 2):
        sent = spark.sparkContext.broadcast(grams)
        found = train.mapInArrow(_sequence_counts(sent, k), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow().sort_by("key")
        grams.keys.append(found["key"].to_numpy())
        grams.counts.append(found["n"].to_numpy())
    return grams


# ---------------------------------------------------------------- the tree


class Tree:
    """Smoothed states. For each length k of contexts: left[k - 1], the share left to the next shorter context (nan: no state);
    gain[k], the discounted share of the last word of a sequence of k + 1 words after the first k."""

    def __init__(self, grams: Grams, total: int, distinct: int):
        self.grams, self.total, self.distinct = grams, total, distinct
        words = len(grams.words)
        self.root = (grams.counts[0] + 1) / (total + distinct + 1)
        before = [None, *[keys // max(words, 1) for keys in grams.keys[1:]]]
        ends = [np.arange(words), *[keys % max(words, 1) for keys in grams.keys[1:]]]
        # The sequence without its first word: extend the one of its beginning.
        suffix = [None, ends[1] if len(ends) > 1 else None]
        for k in range(3, len(grams.keys) + 1):
            suffix.append(grams.find(k - 1, suffix[k - 2][before[k - 1]] * words + ends[k - 1]) if len(grams.keys[k - 1]) else np.zeros(0, np.int64))
        self.left, self.gain = [], [None]
        states, smooth = [], [self.root]
        for k in range(1, len(grams.keys)):
            context, n, of = grams.counts[k - 1], grams.counts[k], before[k]
            size = len(context)
            share = n / context[of] if len(n) else np.zeros(0)
            gain = (n - DISCOUNT) / context[of] if len(n) else np.zeros(0)
            left = 1 - np.bincount(of, gain, size)
            parent = smooth[k - 1][suffix[k]] if len(n) else np.zeros(0)
            own, theirs = np.bincount(of, share, size), np.bincount(of, parent, size)
            rest = np.maximum(1 - own, 0)
            gone = np.bincount(of, share * np.log(share / parent), size) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / np.maximum(1 - theirs, 1e-300)), 0)
            followers = np.bincount(of, minlength=size)
            states.append((followers > 0) & (context * gone >= 0.5 * math.log(max(total, 2)) * (followers + 1)))
            smooth.append(gain + left[of] * parent if len(n) else np.zeros(0))
            self.left.append(left)
            self.gain.append(gain)
        for k in range(len(states) - 1, 0, -1):  # suffixes of states are states
            states[k - 1][suffix[k][states[k]]] = True
        self.left = [np.where(s, x, np.nan) for s, x in zip(states, self.left)]

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; for words without id, without the root's part."""
        depth = len(self.left)
        ends = self.grams.ends(ids, starts, depth + 1)
        p = np.where(ids >= 0, self.root[ids] if len(self.root) else 1.0, 1.0)
        first = starts[starts < len(ids)]
        for k in range(1, depth + 1):
            context = np.empty_like(ids)
            context[1:] = ends[k - 1][:-1]
            context[first] = -1
            on = np.flatnonzero(context >= 0)
            left = self.left[k - 1][context[on]]
            on, left = on[~np.isnan(left)], left[~np.isnan(left)]
            at = ends[k][on]
            p[on] = (np.where(at >= 0, self.gain[k][at], 0.0) if len(self.gain[k]) else 0.0) + left * p[on]
        return np.log10(p)


def fit(docs: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of the rows (doc_id, text) outside the held-out fold, and (word, c) of all training words."""
    train = docs.filter(~held_out(F.col("doc_id"))).select("text")
    counts = cut(train.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    grams = frequent_sequences(train, counts, max(MINIMUM, math.ceil(RARE * total)))
    return Tree(grams, total, distinct), counts


# ---------------------------------------------------------------- scores

_PARTS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, n long"


def _scores(tree):
    """A row per text, or part of a long one, with the frequent words' part, and a row for each other word of it."""

    def run(batches):
        t = tree.value
        root = np.append(np.log10(t.root), 0.0)  # 0 for words without id, which are at -1
        names = [c.split()[0] for c in _PARTS.split(", ")]
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            rows, doc_ids, outs, texts = batch.columns
            for block in blocks(texts, DEPTH):
                ids, starts, size = t.grams.block_ids(block), block.starts, len(block.starts) - 1
                of = np.repeat(np.arange(size), np.diff(starts))
                logs = t.log10(ids, starts)
                ids, of, logs, codes = ids[block.skip :], of[block.skip :], logs[block.skip :], block.codes[block.skip :]
                row = rows.slice(block.at, size)
                n = np.bincount(of, minlength=size)
                known = np.bincount(of, ids >= 0, size).astype(np.int64)
                # No word begins with a blank: the text's own row meets no count, and is dealt like any word.
                own = pa.array([b" %d" % r for r in row.to_numpy().tolist()], pa.binary())
                sums = [np.bincount(of, x, size).astype(float) for x in (root[ids], logs)]  # whole numbers where a part has no words
                yield pa.RecordBatch.from_arrays([row, doc_ids.slice(block.at, size), outs.slice(block.at, size), *map(pa.array, (n, known, *sums)), own, pa.array(np.zeros(size, np.int64))], names)
                rare = ids < 0
                pairs, n = np.unique(of[rare] * len(block.words) + codes[rare], return_counts=True)
                if len(pairs):
                    none, zeros = [pa.nulls(len(pairs), kind) for kind in (pa.int64(), pa.bool_())], [pa.array(np.zeros(len(pairs), kind)) for kind in (np.int64, np.int64, float, float)]
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(pairs // len(block.words))), *none, *zeros, block.words.take(pa.array(pairs % len(block.words))), pa.array(n)], names)

    return run


def scores(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tree, counts = fit(rows)
    sent = docs.sparkSession.sparkContext.broadcast(tree)
    marked = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    parts = marked.mapInArrow(_scores(sent), _PARTS).join(counts, "word", "left")
    rare = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(tree.total + tree.distinct + 1)))
    return (
        parts.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
            F.lit(int(tree.total)).cast("long").alias("train_tokens"),
            F.sum(F.col("base") + rare).alias("base_score"),
            F.sum(F.col("score") + rare).alias("score"),
        )
        .drop("row")
    )


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
