"""Vocabularies of a corpus, its modules and its types at once, and how a model's judgements of words contradict their classes.

One pass: words are counted per entity, and one aggregation with grouping sets sums them over the corpus, by module and by
type. An entity that carries a word counts once however often its name says it. Entities are kept ones: no stubs.
names: (entity, module, type, role, name), module and type being the scopes around the entity, itself included, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import split_identifier
from .vocabulary import WEIGHTS, term_class

LEVELS = {"corpus": [], "module": ["module"], "type": ["type"]}
CLASSES, CONCERNS = ["domain", "technical", "keyword", "short"], ["domain", "technical", "ambiguous"]
#: The concern that contradicts a class; keywords and short words have none.
OPPOSITE = {"domain": "technical", "technical": "domain"}
_PIECE = "[A-Z]?[a-z][a-z0-9]*|[A-Z]+[0-9]*|[0-9]+"


def _by_scope(df: DataFrame, also: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates by corpus, module and type: (level, id, also..., aggregates); rows outside a scope of a level are not in it."""
    sets = [[*keys, *also] for keys in LEVELS.values()]
    level = F.when(F.grouping("module") == 0, "module").when(F.grouping("type") == 0, "type").otherwise("corpus")
    sums = df.groupingSets(sets, "module", "type", *also).agg(level.alias("level"), *aggregates)
    names = [c for c in sums.columns if c not in ("module", "type", "level", *also)]
    return sums.filter((F.col("level") == "corpus") | F.coalesce("module", "type").isNotNull()).select("level", F.coalesce("module", "type").alias("id"), *also, *names)


def terms(names: DataFrame, keywords: list[str], technical: list[str]) -> DataFrame:
    """(level, id, term, class, weight, occurrences, carriers); id is null for the corpus."""
    weight = F.coalesce(*[F.when(F.col("role") == r, w) for r, w in WEIGHTS.items()], F.lit(1))
    said = names.select("entity", "module", "type", weight.alias("w"), F.explode(split_identifier(F.coalesce("name", F.lit("")))).alias("term"))
    each = said.groupBy("entity", "module", "type", "term").agg(F.sum("w").alias("weight"), F.count("*").alias("occurrences"))
    rows = _by_scope(each, ["term"], [F.sum("weight").cast("long").alias("weight"), F.sum("occurrences").alias("occurrences"), F.count("*").alias("carriers")])
    return rows.withColumn("class", term_class(F.col("term"), keywords, technical))


def scopes(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(level, id, entities, unnamed, numeric, a count per role that speaks, distinct_terms, distinct_domain, weight, occurrences) of
    every scope, those without a word included. rows: terms()."""
    name = F.coalesce("name", F.lit(""))
    speaks = F.size(split_identifier(name)) > 0
    numeric = F.size(F.filter(F.regexp_extract_all(name, F.lit(_PIECE), F.lit(0)), lambda p: p.rlike("^[0-9]+$")))
    read = names.select("module", "type", "role", (name == "").alias("unnamed"), speaks.alias("speaks"), numeric.alias("numeric"))
    roles = [F.count_if((F.col("role") == r) & F.col("speaks")).alias(f"{r}s") for r in ("module", "type", "operation", "attribute", "parameter")]
    counted = _by_scope(read, [], [F.count("*").alias("entities"), F.count_if("unnamed").alias("unnamed"), F.sum("numeric").cast("long").alias("numeric"), *roles])
    sums = rows.groupBy(F.col("level").alias("l"), F.col("id").alias("i")).agg(F.count("*").alias("distinct_terms"), F.count_if(F.col("class") == "domain").alias("distinct_domain"), F.sum("weight").alias("weight"), F.sum("occurrences").alias("occurrences"))
    out = counted.join(sums, (F.col("level") == F.col("l")) & F.col("id").eqNullSafe(F.col("i")), "left").drop("l", "i")
    return out.fillna(0, ["distinct_terms", "distinct_domain", "weight", "occurrences"])


def spread(rows: DataFrame) -> DataFrame:
    """(term, class, modules, types, exclusive): in how many modules and types a term is said, and the module if it is one."""
    module, type_ = F.col("level") == "module", F.col("level") == "type"
    one = F.when(F.count_if(module) == 1, F.min(F.when(module, F.col("id"))))
    return rows.groupBy("term", "class").agg(F.count_if(module).alias("modules"), F.count_if(type_).alias("types"), one.alias("exclusive"))


def concern_drift(judgements: DataFrame, entities: DataFrame, keywords: list[str], technical: list[str]) -> tuple[DataFrame, DataFrame]:
    """Judgements (id, word, concern, sense, confidence) of entities (id, is_stub), against the classes of their words.

    (word, class, domain, technical, ambiguous, against, surest): counts by concern, how many contradict the class, and the entity
    of the surest of these (ties by entity, then sense); and one row (entries, entities, unknown, not_kept) of what was compared
    and, by distinct id, left out.
    """
    known = entities.groupBy(F.col("id").alias("k")).agg(F.bool_or(~F.coalesce("is_stub", F.lit(False))).alias("kept"))
    met = judgements.join(known, F.col("id") == F.col("k"), "left")
    left = met.agg(
        F.count_if("kept").alias("entries"),
        F.countDistinct(F.when(F.col("kept"), F.col("id"))).alias("entities"),
        F.countDistinct(F.when(F.col("k").isNull(), F.col("id"))).alias("unknown"),
        F.countDistinct(F.when(~F.col("kept"), F.col("id"))).alias("not_kept"),
    )
    of = met.filter("kept").withColumn("class", term_class(F.col("word"), keywords, technical))
    against = F.lit(False)
    for c, concern in OPPOSITE.items():
        against = against | ((F.col("class") == c) & (F.col("concern") == concern))
    first = F.struct(-F.col("confidence"), F.col("id"), F.col("sense"))
    pivot = [F.count_if(F.col("concern") == c).alias(c) for c in CONCERNS]
    words = of.withColumn("odd", against).groupBy("word", "class").agg(*pivot, F.count_if("odd").alias("against"), F.min_by("id", F.when(F.col("odd"), first)).alias("surest"))
    return words, left


def contradicted(words: DataFrame, n: int) -> DataFrame:
    """(class, place, word, against): the n words of each class that most judgements contradict, ties by word."""
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("against"), "word"))
    return words.filter("against > 0").select("class", place.alias("place"), "word", "against").filter(F.col("place") <= n)
