"""Scalar functions of the model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Subjects that mark fixes and reverts.
FIX = r"(?i)\b(fix(es|ed)?|bug|defect|hotfix|patch)\b"
REVERT = r"(?i)^revert\b"


def u16(c: Column) -> Column:
    """Sort key of the canonical order: UTF-16 code units."""
    return F.encode(c, "UTF-16BE")


def render_id(lang: Column, module: Column, symbol: Column, disambiguator: Column) -> Column:
    """lang:module[/symbol][#disambiguator]."""
    return F.concat(
        lang, F.lit(":"), module,
        F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit("/"), symbol)).otherwise(""),
        F.when(disambiguator.isNotNull(), F.concat(F.lit("#"), disambiguator)).otherwise(""),
    )


def parse_id(rendered: Column) -> Column:
    """Struct (lang, module, symbol, disambiguator) of a rendered id; null where it has no language."""
    lang = F.substring_index(rendered, ":", 1)
    tail = F.substring(rendered, F.length(lang) + 2, F.lit(1 << 30))
    hash_at = F.instr(tail, "#")
    body = F.when(hash_at > 0, F.substring(tail, F.lit(1), hash_at - 1)).otherwise(tail)
    dis = F.when(hash_at > 0, F.substring(tail, hash_at + 1, F.lit(1 << 30)))
    slash = F.instr(body, "/")
    module = F.when(slash > 0, F.substring(body, F.lit(1), slash - 1)).otherwise(body)
    symbol = F.when(slash > 0, F.substring(body, slash + 1, F.lit(1 << 30))).otherwise(F.lit(""))
    return F.when(
        F.instr(rendered, ":") > 1,
        F.struct(lang.alias("lang"), module.alias("module"), symbol.alias("symbol"), dis.alias("disambiguator")),
    )


def has_trait(traits: Column, trait: str) -> Column:
    return F.array_contains(traits, trait)


def is_stub(traits: Column, flag: Column) -> Column:
    """A stub: flagged so, and a type or a module."""
    return (has_trait(traits, "TType") | has_trait(traits, "TModule")) & F.coalesce(flag, F.lit(False))


def round_half_up(value: Column, digits: int = 3) -> Column:
    """Half toward plus infinity."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def scale_value(value: Column, low: Column, high: Column, to: tuple[float, float], scale: str = "linear") -> Column:
    """value in [low, high] scaled into `to`; a degenerate domain gives the middle, an unmeasured value null."""
    shape = {"linear": lambda c: c, "sqrt": F.sqrt, "log1p": F.log1p}.get(scale)
    if shape is None:
        raise ValueError(f"unknown scale: {scale}")
    part = (shape(value - low)) / shape(high - low)
    inside = F.greatest(F.least(part, F.lit(1.0)), F.lit(0.0))
    return F.when(value.isNull(), None).when(high <= low, F.lit((to[0] + to[1]) / 2)).otherwise(to[0] + inside * (to[1] - to[0]))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up."""
    return F.ceil(F.octet_length(F.encode(text, "UTF-16BE")) / 2 / 4).cast("long")


def clamp_confidence(c: Column) -> Column:
    """Into [0, 1]; what is not finite is 0."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite, F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def split_identifier(name: Column) -> Column:
    """Lower-case words of a name: letter and digit runs cut at camel boundaries; words of digits only are dropped."""
    camel = (
        r"(?<=[^\p{Lu}\p{Lt}\p{M}])(?=[\p{Lu}\p{Lt}])|(?<=[\p{Lu}\p{Lt}])(?=[\p{Lu}\p{Lt}][^\p{Lu}\p{Lt}\p{N}\p{M}])"
    )
    pieces = F.regexp_extract_all(name, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    words = F.flatten(F.transform(pieces, lambda p: F.split(p, camel)))
    return F.transform(F.filter(words, lambda w: (w != "") & ~w.rlike(r"^\p{N}+$")), F.lower)


def csv_field(c: Column, delimiter: str = ",") -> Column:
    """Quoted where it holds the delimiter, a quote, a line break, or white space at an end."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.contains(text, F.lit(delimiter)) | text.rlike(r'["\r\n]|(?U:^\s|\s$)'), quoted).otherwise(text)


def dot_text(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def directory_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
