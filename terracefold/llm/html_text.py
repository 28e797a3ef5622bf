"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tags and words. A word scores by where it stands: the elements around it, and the names in
their class, id, role and aria-label attributes. The weights are those of a logistic regression on labelled pages
(labelled_pages), so words of content score positive and words of menus, notices, comments of readers and the like
negative. Start tags score negative, by how much denser they are in the pages' other parts than in content. A linear scan finds
the contiguous region with the largest sum; in it, words that score negative are left out, and block elements end blocks.
A stretch that is left out scores as one tag, so a long aside does not cut an article off.

Every page goes the same way. That an article or main element exists on a page is a feature of the text beside it.

Defined results: a null or empty page has an empty text, and so has one without a word that scores positive. Character
references are decoded as HTML5 says, also without a semicolon. White space is that of Python's str.split(). Cut-off pages
end where they end; an unfinished tag or comment is no text. Scripts, styles and other raw text end at their end tag
whatever they contain; quotes count in attribute values only. Repeated rows give repeated results; empty tables give none.
"""

from __future__ import annotations

import html
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled_pages
from .common import table

#: Quotes have a meaning after "=" only; possessive, so that no page takes more than one pass.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+|=)*+)(?:>|\Z)"
)
_OTHER = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|[\s/\"'])(class|id|role|aria-label|keep|drop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/>]|$))", re.I)
#: Fixed lists: elements without end tags, elements whose content is no text, block elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "noembed", "noframes", "xmp"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Fixed lists: elements that end an open paragraph; elements that end an open one of the first kind up to the second.
_ENDS_P = BLOCK - {"br", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "body", "html"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"})}
_PLAIN = {"html", "body", "head"}
_COPYRIGHT = re.compile(r"©|&copy|\bcopyright\b", re.I)


@lru_cache(100_000)
def _features(tag: str, attrs: str) -> tuple[str, ...]:
    """Features of an element: its tag, the names in its attributes, and the parts of these names without plural s."""
    out = [] if tag in _PLAIN else [f"<{tag}"]
    for kind, *values in _NAMES.findall(attrs) if attrs else ():
        if kind.lower() in ("keep", "drop"):
            continue
        for name in "".join(values).lower().split():
            parts = [p.removesuffix("s") if len(p) > 3 else p for p in re.split(r"[^a-z]+", name) if p]
            out += [f"={parts[0]}"] if len(parts) == 1 else [f"-{p}" for p in parts]
    return tuple(dict.fromkeys(out))


#: A slash before the end of a tag that belongs to an unquoted value.
_UNQUOTED = re.compile(r"=\s*[^\s\"'>][^\s>]*>\Z")


class _Open:
    """An open element: what is around its text."""

    __slots__ = ("tag", "features", "sum", "block", "article", "label")

    def __init__(self, tag, features, total, block, article, label):
        self.tag, self.features, self.sum, self.block, self.article, self.label = tag, features, total, block, article, label


def scan(page: str, weights: dict[str, float], labels: bool = False):
    """(text, block number, open element) for each run of text, (None, 0, open element) for each start tag, in page order."""
    out: list[tuple] = []
    stack = [_Open("", frozenset(), 0.0, "body", False, False)]
    places: dict[str, list[int]] = {}  # where in the stack elements of a tag are open
    block = at = 0
    size = len(page)

    def innermost(tags) -> int:
        return max((p[-1] for t in tags if (p := places.get(t))), default=0)

    def close(k: int) -> None:
        for x in stack[k:]:
            places[x.tag].pop()
        del stack[k:]

    def close_one_of(tags, within) -> None:
        k = innermost(tags)
        if k and k >= innermost(within):
            close(k)

    begin = 0
    while at < size:
        at = page.find("<", at)
        if at < 0:
            break
        m = _TAG.match(page, at) or _OTHER.match(page, at)
        if m is None:  # a "<" that is text
            at += 1
            continue
        if m.start() > begin:
            out.append((page[begin : m.start()], block, stack[-1]))
        at = begin = m.end()
        if m.re is _OTHER:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            block += 1
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = begin = size if end is None else end.end()
            continue
        if tag in _ENDS_P and places.get("p"):
            close_one_of({"p"}, BLOCK)
        if tag in _ENDS:
            close_one_of(*_ENDS[tag])
        if tag in VOID or m[0].endswith("/>") and tag not in BLOCK and not _UNQUOTED.search(m[0]):
            out.append((None, 0, stack[-1]))
            continue
        top = stack[-1]
        new = [f for f in _features(tag, m[3]) if f not in top.features]
        inner = tag if tag in BLOCK and tag not in _PLAIN else top.block
        total = top.sum + sum(weights.get(f, 0.0) for f in new)
        label = top.label
        if labels:
            for kind, *_ in _NAMES.findall(m[3]):
                label = {"keep": True, "drop": False}.get(kind.lower(), label)
        stack.append(_Open(tag, top.features.union(new) if new else top.features, total, inner, top.article or tag in ("article", "main"), label))
        places.setdefault(tag, []).append(len(stack) - 1)
        out.append((None, 0, stack[-1]))
    if begin < size:
        out.append((page[begin:], block, stack[-1]))
    return out


def _own(text: str, top: _Open, article: bool) -> list[str]:
    """Features of a run of text besides those of the elements around it."""
    out = [f"in {top.block}"]
    if article and not top.article:
        out.append("beside an article")
    if not top.article and len(text) < 400 and _COPYRIGHT.search(text):
        out.append("copyright")
    return out


@lru_cache(1)
def weights() -> tuple[dict[str, float], float]:
    """Log odds of content by feature ("" is the bias), and the score of a tag, learned from the labelled pages."""
    rows, labels, sizes, tags = [], [], [], {True: 1, False: 1}
    for page in labelled_pages.pages():
        found = scan(page, {}, labels=True)
        article = any(t is not None and top.article for t, _, top in found)
        for text, _, top in found:
            if text is None:
                tags[top.label] += 1
            elif n := sum(int(x) for x in re.findall(r"[0-9]+", text)) + ("copyright" in text):
                rows.append({"", *top.features, *_own(text, top, article)})
                labels.append(top.label)
                sizes.append(n)
    names = sorted(set().union(*rows))
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for k, r in enumerate(rows):
        x[k, [place[f] for f in r]] = 1
    y, w = np.array(labels, float), np.sqrt(np.array(sizes, float))
    w /= w.sum()
    b, pace = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(3000):
        g = x.T @ (w * (1 / (1 + np.exp(-(x @ b))) - y)) + 2e-5 * b
        pace += g * g
        b -= 0.3 * g / np.sqrt(pace)
    words = {kind: sum(n for n, label in zip(sizes, labels) if label == kind) for kind in (True, False)}
    return dict(zip(names, b.tolist())), -math.log((tags[False] / words[False]) / (tags[True] / words[True]))


def best_region(scores) -> tuple[int, int]:
    """The contiguous region with the largest sum, as (start, stop); the first and shortest of equal ones."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, region = run, (start, k + 1)
    return region


def main_text(page: str | None) -> str:
    """The page's main text: blocks joined by newlines."""
    by, tag_score = weights()
    rows = scan(page or "", by)
    article = any(t is not None and top.article and top.sum > 0 for t, _, top in rows)
    # All that stands between two pieces of content costs one tag, however much markup or other text it is.
    worth, scores, paid = [], [], False
    for text, _, top in rows:
        each = by[""] + top.sum
        if text is not None:
            each += sum(by.get(f, 0.0) for f in _own(text, top, article))
        words = text is not None and len(text.split())
        worth.append(each if text is not None else 0.0)
        if words and each > 0:
            scores.append(each * words)
            paid = False
        else:
            scores.append(0.0 if paid or text is not None and not words else tag_score)
            paid = paid or text is None or bool(words)
    start, stop = best_region(scores)
    blocks: list[list[str]] = []
    last = None
    for k in range(start, stop):
        text, block, _ = rows[k]
        if text is None or worth[k] <= 0:
            continue
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(html.unescape(text))
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
