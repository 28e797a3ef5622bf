"""Word clouds of a scope's heaviest terms: a few hundred words, laid out on the driver, and their SVG."""

from __future__ import annotations

import math
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heaviest(terms: DataFrame, scope: str, top: int = 100) -> list[tuple[str, int]]:
    """The top terms by weight, then text; top is the report's size."""
    rows = terms.filter(F.col("scope") == scope).orderBy(F.col("weight").desc(), "term").limit(top).collect()
    return [(r["term"], r["weight"]) for r in rows]


def monospace(text: str, size: float) -> tuple[float, float]:
    return 0.6 * size * len(text), 1.2 * size


def layout(words: list[tuple[str, float]], measure: Callable[[str, float], tuple[float, float]] = monospace, smallest: float = 10, largest: float = 60) -> list[dict]:
    """Boxes (text, size, x, y, width, height) along a spiral, heaviest first, without overlap."""
    if not words:
        return []
    top = max(w for _, w in words) or 1
    placed: list[dict] = []
    for text, weight in words:
        size = smallest + (largest - smallest) * math.sqrt(weight / top)
        w, h = measure(text, size)
        step = 0
        while True:
            angle = 0.35 * step
            x, y = 2.2 * angle * math.cos(angle) - w / 2, 1.3 * angle * math.sin(angle) - h / 2
            if all(x + w <= b["x"] or b["x"] + b["width"] <= x or y + h <= b["y"] or b["y"] + b["height"] <= y for b in placed):
                placed.append({"text": text, "size": size, "x": x, "y": y, "width": w, "height": h})
                break
            step += 1
    return placed


def svg(boxes: list[dict]) -> str:
    if not boxes:
        return '<svg xmlns="http://www.w3.org/2000/svg"/>'
    x0, y0 = min(b["x"] for b in boxes), min(b["y"] for b in boxes)
    x1, y1 = max(b["x"] + b["width"] for b in boxes), max(b["y"] + b["height"] for b in boxes)
    body = "".join(f'<text x="{b["x"]:.2f}" y="{b["y"] + 0.8 * b["height"]:.2f}" font-size="{b["size"]:.2f}">{escape(b["text"])}</text>' for b in boxes)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{x0:.2f} {y0:.2f} {x1 - x0:.2f} {y1 - y0:.2f}" font-family="monospace">{body}</svg>'
