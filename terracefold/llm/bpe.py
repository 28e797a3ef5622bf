"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

A partition's texts go through in blocks of a few MB. Texts are cut where the split pattern always cuts (a single
space between other characters), so a piece's tokens depend on the piece alone and frequent pieces come from a
bounded cache. New pieces are split by the pattern; new words go to DuckDB as token-position rows. A recursive query
joins neighbouring rows with the merge table and contracts each word's leftmost pair of least rank until no pair is
left. Decoding joins (document, position, id) rows with the vocabulary and aggregates their bytes in order.

Words over LONG bytes (no white space or change of character class for that long) go through a heap instead: the
recursion would need a round for each merge over all of the word's rows.

Defined results: a null text is empty; an empty text has no tokens. Strings of special tokens are ordinary text.
Repeated rows give repeated results; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LONG = 128
#: Bytes squared of the words in one recursive query: it makes a row for each byte and round.
QUERY_SQUARES = 1_500_000
BLOCK_CHARS = 1_000_000
#: Bytes of a generation from which the next one begins, for each of a worker's three caches, and of an entry beside its texts:
#: a worker holds at most 6 * CACHE_BYTES, and what one block adds.
CACHE_BYTES, ENTRY_BYTES = 40_000_000, 200
#: Texts in which white space stands beside a space or at an end are split by the pattern as a whole.
_UNCUT = re.compile(r"\A\s|\s\Z|\s | \s")

#: Positions run on over all words of a query. Of a word's keys (rank, position) the least is its leftmost pair of least rank; a
#: row whose left neighbour holds that pair goes. A word without a pair is done.
_CONTRACT = """
WITH RECURSIVE t(done, word, pos, id) AS (
  SELECT false, word, pos, id FROM start
  UNION ALL
  (WITH k AS (
    SELECT x.word, x.pos, x.id, x.before, m.rank * 4294967296 + x.pos AS key
    FROM (
      SELECT word, pos, id, lag(pos) OVER w AS before, CASE WHEN lead(word) OVER w = word THEN lead(id) OVER w END AS next
      FROM t WHERE NOT done WINDOW w AS (ORDER BY pos)
    ) x LEFT JOIN merges m ON m.l = x.id AND m.r = x.next
  ), least AS (SELECT word, min(key) AS best FROM k GROUP BY word)
  SELECT best IS NULL, word, pos, CASE WHEN key = best THEN (key // 4294967296)::INTEGER ELSE id END
  FROM k JOIN least USING (word) WHERE best IS NULL OR before IS DISTINCT FROM best % 4294967296)
)
SELECT word, id FROM t WHERE done ORDER BY pos
"""

_DECODE = "SELECT doc, string_agg(bytes, '') AS text FROM (SELECT doc, v.bytes FROM ids JOIN vocabulary v USING (id) ORDER BY pos) GROUP BY doc"


class Recent:
    """A cache of two generations: once the young one is full it becomes the old one, and what the old one held goes."""

    def __init__(self, bound: int):
        self.bound, self.size, self.young, self.old = bound, 0, {}, {}

    def turn(self) -> None:
        if self.size > self.bound:
            self.size, self.old, self.young = 0, self.young, {}

    def put(self, key: str, value: bytes) -> None:
        self.young[key] = value
        self.size += len(key) + len(value) + ENTRY_BYTES

    def missing(self, keys) -> list[str]:
        """Those of the keys that neither generation holds; the others are in the young one afterwards."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    self.put(k, old[k])
                else:
                    out.append(k)
        return out


class Coder:
    """Ranks of one vocabulary file, in memory and as DuckDB tables."""

    _open: dict[str, Coder] = {}

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self.load("merges", {"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int64())})
        self.load(
            "vocabulary",
            {"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())},
        )
        self.words, self.first, self.rest = (Recent(CACHE_BYTES) for _ in range(3))

    @classmethod
    def of(cls, path: str, pattern: str) -> Coder:
        if path not in cls._open:
            cls._open[path] = cls(path, pattern)
        return cls._open[path]

    def load(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def merged(self, word: bytes) -> bytes:
        """One long word by a heap of (rank, position)."""
        n = len(word)
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        part = [word[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(k: int) -> None:
            if after[k] < n:
                rank = self.ranks.get(part[k] + part[after[k]])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, part[k], part[after[k]]))

        for k in range(n):
            offer(k)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if part[k] is None or part[k] != a or j >= n or part[j] != b:
                continue
            part[k], part[j], ids[k] = a + b, None, rank
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        return np.array([i for i, p in zip(ids, part) if p is not None], "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Encode words that self.words lacks."""
        put = self.words.put
        raw = [w.encode() for w in new]
        short = [k for k, w in enumerate(raw) if len(w) <= LONG]
        for k, w in enumerate(raw):
            if len(w) > LONG:
                put(new[k], self.merged(w))
        part = np.cumsum([len(raw[k]) ** 2 for k in short], dtype=np.int64) // QUERY_SQUARES
        borders = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(short)] if short else []
        for at, to in zip(borders, borders[1:]):
            some = short[at:to]
            sizes = np.array([len(raw[k]) for k in some])
            word = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
            pos = np.arange(len(word), dtype=np.int32)
            ids = self.byte_id[np.frombuffer(b"".join(raw[k] for k in some), np.uint8)]
            self.db.register("start", pa.table({"word": word, "pos": pos, "id": ids}))
            got = self.db.execute(_CONTRACT).fetchnumpy()
            self.db.unregister("start")
            flat = np.asarray(got["id"]).astype("<u4").tobytes()
            ends = np.cumsum(np.bincount(np.asarray(got["word"]), minlength=len(some))) * 4
            begin = 0
            for k, end in zip(some, ends.tolist()):
                put(new[k], flat[begin:end])
                begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for cache in (self.words, self.first, self.rest):
            cache.turn()
        first, rest = self.first.young, self.rest.young
        alone = {k: self.pattern.findall(t) for k, t in enumerate(texts) if _UNCUT.search(t)}
        split = [() if k in alone else t.split(" ") for k, t in enumerate(texts)]
        begin, inner = {p[0] for p in split if p}, set()
        for p in split:
            inner.update(p[1:])
        todo = [(self.first, p, self.pattern.findall(p)) for p in self.first.missing(begin)]
        todo += [(self.rest, p, self.pattern.findall(" " + p)) for p in self.rest.missing(inner)]
        words = {w for _, _, ws in todo for w in ws}
        words.update(*alone.values())
        self.learn(self.words.missing(words))
        known = self.words.young.__getitem__
        for cache, p, ws in todo:
            cache.put(p, known(ws[0]) if len(ws) == 1 else b"".join(map(known, ws)))
        out = []
        for k, p in enumerate(split):
            if k in alone:
                out.append(b"".join(map(known, alone[k])))
            else:
                out.append(first[p[0]] + b"".join(map(rest.__getitem__, p[1:])))
        return out

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Each id sequence's bytes."""
        sizes = np.array([len(p) // 4 for p in packed])
        doc = np.repeat(np.arange(len(packed), dtype=np.int32), sizes)
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        out = [b""] * len(packed)
        if len(ids):
            self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            got = self.db.execute(_DECODE).fetchall()
            self.db.unregister("ids")
            for k, text in got:
                out[k] = text.encode("latin-1")
        return out


def _blocks(texts):
    """Slices of a text column of at most BLOCK_CHARS bytes, or one text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy()
    i = 0
    while i < len(sizes):
        j, size = i, 0
        while j < len(sizes) and (j == i or size + sizes[j] <= BLOCK_CHARS):
            size += sizes[j]
            j += 1
        yield i, [t or "" for t in texts.slice(i, j - i).to_pylist()]
        i = j


def tokenize(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, digests of the ids and of the decoded bytes; with ids=True also the packed ids themselves."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        coder = Coder.of(path, pattern)
        for batch in batches:
            for at, texts in _blocks(batch.column(1)):
                packed = coder.encode(texts)
                back = coder.decode(packed)
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                ]
                if ids:
                    columns.append(pa.array(packed, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else "")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), *public_vocabulary())


def encode_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return tokenize(docs, *public_vocabulary())
