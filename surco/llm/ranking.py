"""Quality scores learnt from preference pairs: Bradley-Terry ranking on text features.

In a pair the better text is preferred with probability sigmoid(score(better) - score(worse)); the score is linear in
the features, so the fit is a logistic loss on feature differences. A quantile of the scores is the threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surco.llm.common import held_out, positions
from surco.llm.labelled import marked
from surco.operators.ranks import exact_quantiles
from surco.session import written_once

#: The least number of pairs for the fit.
PAIRS = 100_000
#: Scores at the threshold quantile become this.
THRESHOLD = 0.3
SEED = 6
_SIGNS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def features(text: str | None) -> list[float]:
    """Shares and sizes of a whole text; all 0 for a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 14
    chars = sum(map(len, words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    signs, upper = len(_SIGNS.findall(text)), len(_UPPER.findall(text))
    return [
        1.0, min(np.log1p(n), 4.0), np.log1p(n) / 4, float(n < 10), chars / n / 8, min(signs / n, 1.5), upper / chars, min(text.count("!") / n, 1.5),
        min(text.count("|") / n, 1.0), len(counts) / n, counts.most_common(1)[0][1] / n, 1 - pairs / max(n - 1, 1),
        1 - len(set(lines)) / len(lines), sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features_of(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


@dataclass(frozen=True)
class Ranking:
    """Centre, scale and weight of every feature, and the raw score at the threshold."""

    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    threshold: float


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every document, written: a few numbers travel to the labels, not the texts."""
    return written_once(docs.select("doc_id", features_of(F.col("text")).alias("x")))


def learn(docs: DataFrame, labels: DataFrame) -> Ranking | None:
    """The ranking of all labelled texts that are not held out; None without texts of both labels."""
    return _fit(featured(docs), labels)


def _fit(rows: DataFrame, labels: DataFrame) -> Ranking | None:
    """The ranking learnt from ``rows(doc_id, x)``.

    Texts of each label stand in the order of a hash, and each is paired with one of the other label, in as many rounds as give ``PAIRS`` pairs: every
    text takes part. Features, pairs, fit and the counts for the threshold stay in Spark; single values and vectors reach the driver.
    """
    size = len(features(None))
    x = lambda i: F.get("x", F.lit(i))
    seen = written_once(rows.join(marked(labels, "quality").filter(F.col("label").isin(0, 1)).hint("merge"), "doc_id").select("doc_id", "label", "x"))
    n = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    at = seen.agg(*[F.avg(x(i)) for i in range(size)], *[F.stddev_pop(x(i)) for i in range(size)]).first()
    centre, scale = np.array(at[:size]), np.array(at[size:]) + 1e-3
    z = F.array(*[(x(i) - float(centre[i])) / float(scale[i]) for i in range(size)])
    placed = written_once(positions(seen.select("doc_id", "label", z.alias("z")), ["label"], ["doc_id", "z"], "place"))
    longer = int(n[1] >= n[0])
    rounds = -(-PAIRS // n[longer])
    many = placed.filter(F.col("label") == longer).select("place", F.col("z").alias("zm"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    # a round goes on by a step of its own, so partners change
    partner = F.pmod(F.col("place") + F.pmod(F.xxhash64("round", F.lit(SEED)), F.lit(n[1 - longer])), F.lit(n[1 - longer]))
    met = many.withColumn("partner", partner).join(placed.filter(F.col("label") != longer).select(F.col("place").alias("partner"), F.col("z").alias("zf")), "partner")
    sign = F.when((F.col("place") + F.col("round")) % 2 == 0, 1.0).otherwise(-1.0)  # half of the pairs turned round, so that both outcomes occur
    pairs = met.select(array_to_vector(F.zip_with("zm", "zf", lambda a, b: (a - b) * sign)).alias("features"), ((sign > 0) == F.lit(bool(longer))).cast("double").alias("label"))
    fitted = LogisticRegression(fitIntercept=False, standardization=False, regParam=1.0 / (rounds * n[longer]), maxIter=60).fit(written_once(pairs))
    beta = fitted.coefficients.toArray()
    raw = written_once(placed.select("label", sum((F.get("z", F.lit(i)) * float(b) for i, b in enumerate(beta)), F.lit(0.0)).alias("raw")))
    share = n[0] / (n[0] + n[1])
    ends = exact_quantiles(raw.withColumn("all", F.lit(0)), ["all"], "raw", {"low": max(share - 0.01, 0), "high": min(share + 0.01, 1)}).first()
    # of the quantiles near the share of bad texts, the one that parts the labels best
    tried = np.linspace(ends["low"], ends["high"], 101)
    errors = np.array(raw.agg(*[F.count_if((F.col("raw") >= float(t)) != (F.col("label") == 1)) for t in tried]).first())
    best = np.flatnonzero(errors == errors.min())
    return Ranking(tuple(map(float, centre)), tuple(map(float, scale)), tuple(map(float, beta)), float(tried[best[len(best) // 2]]))


def score_of(x: Column, model: Ranking | None) -> Column:
    """Score between 0 and 1, ``THRESHOLD`` at the threshold, of the features ``x``; a text without words has features 0. Without a
    model every score is 0.5."""
    if model is None:
        return F.lit(0.5)
    centre, scale, weight = (np.array(v) for v in (model.centre, model.scale, model.weight))
    shift = model.threshold - np.log(THRESHOLD / (1 - THRESHOLD))

    def run(rows: pd.Series) -> pd.Series:
        raw = (np.array(rows.tolist(), float).reshape(len(rows), len(centre)) - centre) / scale @ weight
        return pd.Series(1 / (1 + np.exp(-np.clip(raw - shift, -500, 500))))

    return F.pandas_udf(run, T.DoubleType())(x)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; repeated rows get equal scores, each in its row."""
    rows = featured(docs)
    scored = rows.select("doc_id", score_of(F.col("x"), _fit(rows, labels)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
