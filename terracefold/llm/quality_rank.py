"""Quality scores by Bradley-Terry ranking of preference pairs.

Features are counts over whole texts, made with DataFrame functions and written once. Labelled rows outside the
held-out fold give preference pairs (a good and a bad document); logistic loss on feature differences is minimised by
Newton steps on the driver, over at most SAMPLE labelled rows (those of least hash) and PAIRS pairs. The threshold is
the quantile of the sample's ranking scores at the share of bad labels; a score is the logistic of the distance to
it, shifted so that the threshold has CUT. Scoring is a sum of weighted columns over all documents.

Defined results: null and empty texts have zero counts and get the score that these have. Labels without a document,
or null ones, are ignored; of repeated labels the largest counts. Without pairs every score is CUT. Rows that repeat a
doc_id keep their own scores. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .quality_rules import with_counts

#: Bounds of the training sample.
SAMPLE, PAIRS = 20_000, 200_000
CUT = 0.3
FOLDS = 5
RIDGE = 1e-3
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "exclaims", "pipes", "digits", "punctuation", "line_words"]


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, FEATURES...): shares and logarithms of counts over each whole text."""
    counted, names = with_counts(docs.select("doc_id", F.col(text).alias("text")))
    n = F.greatest(F.col(names["n_words"]), F.lit(1)).cast("double")
    t = F.coalesce("text", F.lit(""))
    lines = (F.size(F.split(t, "\n"))).cast("double")
    made = {
        "log_words": F.log1p(F.col(names["n_words"]).cast("double")),
        "word_length": F.least(F.col(names["word_chars"]) / n, F.lit(50.0)),
        "symbols": F.least(F.col(names["n_symbols"]) / n, F.lit(5.0)),
        "dup_lines": F.col(names["n_dup_lines"]) / lines,
        "repeats": F.col(names["n_repeat_words"]) / n,
        "upper": F.least(_removed(t, r"\p{Lu}+") / n, F.lit(10.0)),
        "exclaims": F.least(_removed(t, "[!?]+") / n, F.lit(5.0)),
        "pipes": F.least(_removed(t, r"[|_=~]+") / n, F.lit(5.0)),
        "digits": F.least(_removed(t, "[0-9]+") / n, F.lit(10.0)),
        "punctuation": F.least(_removed(t, "[.,;:]+") / n, F.lit(5.0)),
        "line_words": F.log1p(n / lines),
    }
    return counted.select("doc_id", *[F.coalesce(made[f], F.lit(0.0)).cast("double").alias(f) for f in FEATURES])


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo FOLDS, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, threshold) of a Bradley-Terry model of rows x with labels y."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / len(d) + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w, float(np.quantile(z @ w, len(bad) / len(y)))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    table_ = cut(features(docs), "features").withColumn("held_out", held_out(F.col("doc_id")))
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    train = table_.filter(~F.col("held_out")).join(known.filter(~held_out(F.col("doc_id"))), "doc_id")
    rows = train.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(SAMPLE).select(*FEATURES, "quality").collect()
    y = np.array([r["quality"] for r in rows], int)
    score = F.lit(CUT)
    if len(set(y.tolist())) == 2:
        mean, scale, w, threshold = fit(np.array([r[:-1] for r in rows], float), y)
        total = F.lit(-threshold + float(np.log(CUT / (1 - CUT))))
        for k, f in enumerate(FEATURES):
            z = (F.col(f) - float(mean[k])) / float(scale[k])
            total = total + F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0)) * float(w[k])
        score = 1 / (1 + F.exp(-total))
    out = table_.select("doc_id", "held_out", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op6_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
