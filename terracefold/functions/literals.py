"""Literals: recursive JSON values of nine cases; rendering, references, canonical numbers. Recursion needs Python."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REFERENCES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("id", T.StringType())]))
#: Fixed format: canonical decimal text.
DECIMAL = r"^-?(0|[1-9]\d*)(\.\d*[1-9])?$"


def render(value) -> str:
    """Short text of one literal."""
    kind = value.get("kind") if isinstance(value, dict) else None
    if kind == "string":
        return json.dumps(value["value"], ensure_ascii=False)
    if kind in ("number", "boolean"):
        return str(value["value"]).lower() if kind == "boolean" else str(value["value"])
    if kind == "null":
        return "null"
    if kind == "enum":
        return str(value.get("name", value.get("id", "")))
    if kind == "type":
        return f"{value.get('id', '')}.class"
    if kind == "array":
        return "[" + ", ".join(render(v) for v in value.get("values", [])) + "]"
    if kind == "annotation":
        return "@" + str(value.get("id", "")) + "(" + ", ".join(f"{a['name']}={render(a['value'])}" for a in value.get("arguments", [])) + ")"
    return str(value.get("text", "?")) if isinstance(value, dict) else "?"


def references(value, path: str = "") -> list[tuple[str, str]]:
    """(path, id) of all ids inside a literal."""
    if isinstance(value, list):
        return [r for k, v in enumerate(value) for r in references(v, f"{path}[{k}]")]
    if not isinstance(value, dict):
        return []
    own = [(path or ".", value["id"])] if isinstance(value.get("id"), str) else []
    return own + [r for key in ("values", "arguments", "value") if isinstance(value.get(key), (dict, list)) for r in references(value[key], f"{path}.{key}")]


@F.pandas_udf(T.StringType())
def render_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else render(json.loads(t)))


@F.pandas_udf(_REFERENCES)
def references_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [{"path": p, "id": i} for p, i in references(json.loads(t))])


def is_canonical_decimal(c: Column) -> Column:
    return c.rlike(DECIMAL)
