"""The rules of sources.records as a state machine per file, for files that arrive in pieces.

A piece is a row (path, piece, value): pieces of a file are numbered from 0 on, and a line may begin in one and end in the
next. Each file has its own state, a few numbers and the line that is not ended; pieces that come before their turn wait in
the state. Findings come out as soon as they are certain: what a line breaks by itself or by what came before, with
its batch; what needs the whole file (numbers of entities that come later, end counts) with the file's last piece.

A file ends with its last piece, a row whose `last` is true. Without it nothing whole is judged. Repeated pieces count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import FINDING, MANY_REFS, ONE_REF, TAGS, VOCABULARIES

PIECE = "path string, piece long, value string, last boolean"
#: state of a file; waiting: pieces ahead of their turn; refs: lines whose numbers of entities may still come to exist.
STATE = "piece long, line long, rest string, first array<long>, counts array<long>, sizes array<long>, ends string, waiting array<struct<piece:long,value:string,last:boolean>>, refs array<struct<line:long,name:string,number:long,shown:string>>, done boolean"


class FileState:
    """What is known of one file after some of its lines."""

    def __init__(self, saved: tuple | None = None):
        piece, line, rest, first, counts, sizes, ends, waiting, refs, done = saved or (0, 0, "", [0] * 5, [0] * 3, [0] * 4, "", [], [], False)
        self.piece, self.line, self.rest, self.ends, self.done = piece, line, rest, ends, done
        self.first, self.counts, self.sizes = list(first), list(counts), list(sizes)
        self.waiting, self.refs = {w[0]: (w[1], w[2]) for w in waiting}, [tuple(r) for r in refs]

    def saved(self) -> tuple:
        waiting = [(k, v, last) for k, (v, last) in sorted(self.waiting.items())]
        return self.piece, self.line, self.rest, self.first, self.counts, self.sizes, self.ends, waiting, self.refs, self.done

    def arrive(self, pieces) -> Iterator[tuple]:
        """Findings (line, rule, detail) that new pieces (number, text, last) make certain."""
        for number, value, last in pieces:
            if number >= self.piece and not self.done:
                self.waiting.setdefault(int(number), (value or "", bool(last)))
        while self.piece in self.waiting and not self.done:
            value, last = self.waiting.pop(self.piece)
            self.piece += 1
            *lines, self.rest = (self.rest + value).split("\n")
            for text in [*lines, self.rest] if last else lines:
                self.line += 1
                yield from self._line(text.strip(" \t\r\n"))
            if last:
                self.done, self.waiting, self.rest = True, {}, ""
                yield from self._whole()

    def _line(self, text: str) -> Iterator[tuple]:
        if not text:
            return
        try:
            r = json.loads(text)
        except ValueError:
            yield self.line, "not-json", ""
            return
        tag = r.get("t") if isinstance(r, dict) else None
        if tag is None:
            yield self.line, "no-tag", ""
            return
        if tag not in TAGS:
            yield self.line, "unknown-record", str(tag)
            return
        section = TAGS.index(tag)
        fresh = not self.first[section]
        if section and not self.first[0]:
            yield self.line, "before-header", tag
        if section and any(self.first[section + 1 :]):
            yield self.line, "section-closed", tag
        self.first[section] = self.first[section] or self.line
        if section == 0:
            yield from self._header(r, fresh)
        elif section in (1, 2):
            if r.get("i") != self.counts[section - 1]:
                yield self.line, "not-dense", f"{_shown(r.get('i'))}<>{self.counts[section - 1]}"
            self.counts[section - 1] += 1
        elif section == 3:
            self.counts[2] += 1
        elif not fresh:
            yield self.line, "second-end", ""
        else:
            self.ends = json.dumps(r.get("counts") or {})
        if section in (2, 3):
            yield from self._numbers(r, section == 2)

    def _header(self, r: dict, fresh: bool) -> Iterator[tuple]:
        words = r.get("dict") or {}
        if not fresh:
            yield self.line, "second-header", ""
        elif self.line > 1:
            yield self.line, "header-not-first", str(self.line)
        repeats = [v for v in VOCABULARIES if len(set(words.get(v) or [])) < len(words.get(v) or [])]
        if repeats:
            yield self.line, "repeated-word", ";".join(repeats)
        if fresh:
            self.sizes = [len(words.get(v) or []) for v in VOCABULARIES]

    def _numbers(self, r: dict, entity: bool) -> Iterator[tuple]:
        kinds, traits, edges, provenance = self.sizes
        words = [("kind", r.get("k"), kinds), *[("trait", t, traits) for t in r.get("tr") or []]] if entity else [("edge", r.get("k"), edges), ("provenance", r.get("p"), provenance)]
        if entity and r.get("m") is not None and r.get("i") is not None and r["m"] > r["i"]:
            yield self.line, "module-later", str(r["m"])
        anchor = (r.get("anchor") or [None])[0]
        files = [("anchor", anchor)] if not entity or r.get("anchor") is not None else []
        files += [("definedIn", x) for x in r.get("definedIn") or []] if entity else [("sourceFile", r["sourceFile"])] if r.get("sourceFile") is not None else []
        for rule, bad in (("vocabulary", [f"{n}:{_shown(v)}" for n, v, bound in words if _outside(v, bound)]),):
            if bad:
                yield self.line, rule, ";".join(bad)
        if entity:
            refs = [(c, r[c]) for c in ONE_REF if r.get(c) is not None] + [(c, x) for c in MANY_REFS for x in r.get(c) or []]
        else:
            refs = [("from", r.get("f")), ("to", r.get("o")), *[("candidate", x) for x in r.get("candidates") or []]]
        # A number of a record that may yet come is kept; one that is none is kept as such.
        self.refs += [(self.line, f"e{n}", -1 if v is None or v < 0 else v, f"{n}:{_shown(v)}") for n, v in refs if _outside(v, self.counts[1])]
        self.refs += [(self.line, f"f{n}", -1 if v is None or v < 0 else v, f"{n}:{_shown(v)}") for n, v in files if _outside(v, self.counts[0])]

    def _whole(self) -> Iterator[tuple]:
        if not self.first[0]:
            yield 0, "no-header", ""
        if not self.first[4]:
            yield 0, "no-end", ""
        else:
            ends = json.loads(self.ends)
            wrong = [f"{n}:{_shown(ends.get(n))}<>{c}" for n, c in zip(("files", "entities", "edges"), self.counts) if ends.get(n) != c]
            if wrong:
                yield 0, "end-counts", ";".join(wrong)
        found: dict = {}
        for line, name, number, shown in self.refs:
            if _outside(number, self.counts[1 if name[0] == "e" else 0]):
                found.setdefault((line, "no-entity" if name[0] == "e" else "no-file"), []).append(shown)
        for (line, rule), shown in found.items():
            yield line, rule, ";".join(shown)
        self.refs = []


def _shown(value) -> str:
    return "null" if value is None else str(value)


def _outside(value, bound: int) -> bool:
    return value is None or not 0 <= value < bound


def _step(key, frames, state) -> Iterator[pd.DataFrame]:
    file = FileState(tuple(state.get) if state.exists else None)
    pieces = sorted((row for frame in frames for row in zip(frame["piece"], frame["value"], frame["last"])), key=lambda r: r[0])
    found = list(file.arrive(pieces))
    state.update(file.saved())
    yield pd.DataFrame({"path": key[0], "line": [f[0] for f in found], "rule": [f[1] for f in found], "detail": [f[2] for f in found]})


def findings(pieces: DataFrame) -> DataFrame:
    """A stream of findings (path, line, rule, detail) of a stream of pieces (path, piece, value, last)."""
    rows = pieces.select("path", F.col("piece").cast("long").alias("piece"), "value", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("path").applyInPandasWithState(_step, FINDING, STATE, "append", "NoTimeout")


def read_pieces(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the pieces of files: text files named NAME.partK, or NAME.partK.last for the last one. None may be empty: the
    reader gives no row for such a file."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    at = F.col("_metadata.file_name")
    return raw.select(F.regexp_extract(at, r"^(.*)\.part\d+(\.last)?$", 1).alias("path"), F.regexp_extract(at, r"\.part(\d+)(\.last)?$", 1).cast("long").alias("piece"), "value", at.endswith(".last").alias("last"))
