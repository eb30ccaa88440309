"""Unsupervised groups of pixels with similar variables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surco.session import written_once

# Fixed values.
RESTARTS = 4
MAX_ITERATIONS = 100
TOLERANCE = 1e-4
CODE_NAMES = ("sin_curva", "maiz", "sorgo", "ambos", "ninguno", "incompleta")


def kmeans_groups(pixels: DataFrame, names: Sequence[str], k: int = 8, seed: int = 0) -> DataFrame:
    """(px_id, group): 1 is the largest group, 0 a pixel with a missing variable.

    All complete pixels take part. Variables are scaled by their mean and spread; the best of several starts is
    kept. The pixels are read once: counts, starts and assignment read the written copies.
    """
    clean = pixels.select("px_id", *[F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")).alias(n) for n in names])
    clean = written_once(clean)
    complete = clean.dropna(subset=list(names))
    stats = complete.agg(F.count(F.lit(1)).alias("total"), *[F.avg(n).alias(f"m_{n}") for n in names],
                         *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    if stats["total"] < 10 * k:
        raise ValueError(f"too few complete pixels ({stats['total']})")
    z = {n: (F.col(n) - stats[f"m_{n}"]) / (stats[f"s_{n}"] or 1.0) for n in names}
    vectors = VectorAssembler(inputCols=list(names), outputCol="features")
    train = written_once(vectors.transform(complete.withColumns(z)).select("px_id", "features"))
    best = min((KMeans(k=k, seed=seed + i, maxIter=MAX_ITERATIONS, tol=TOLERANCE).fit(train) for i in range(RESTARTS)),
               key=lambda m: m.summary.trainingCost)
    sizes = best.summary.clusterSizes
    order = sorted(range(len(sizes)), key=lambda c: (-sizes[c], c))
    number = F.lit(0)
    for rank, c in enumerate(order, 1):
        number = F.when(F.col("prediction") == c, rank).otherwise(number)
    assigned = best.transform(train).select("px_id", number.alias("group"))
    rest = clean.filter(" OR ".join(f"`{n}` IS NULL" for n in names)).select("px_id", F.lit(0).alias("group"))
    return assigned.unionByName(rest)


def group_profile(grouped: DataFrame, names: Sequence[str], px_km2: float, code: str | None = None) -> DataFrame:
    """Per group: pixels, area, mean of every variable and, if given, counts of the coherence codes.

    ``dominant`` is the most frequent code among pixels with a curve, with its share.
    """
    aggs = [F.count(F.lit(1)).alias("pixels"), (F.count(F.lit(1)) * px_km2).alias("km2"), *[F.avg(n).alias(n) for n in names]]
    if code:
        aggs += [F.count_if(F.least(F.col(code), F.lit(5)) == i).alias(f"ref_{n}") for i, n in enumerate(CODE_NAMES)]
    out = grouped.filter(F.col("group") > 0).groupBy("group").agg(*aggs)
    if not code:
        return out
    counts = F.array(*[F.col(f"ref_{n}") for n in CODE_NAMES[1:]])
    total = sum((F.col(f"ref_{n}") for n in CODE_NAMES[2:]), F.col(f"ref_{CODE_NAMES[1]}"))
    first = F.get(F.array(*[F.lit(n) for n in CODE_NAMES[1:]]), F.array_position(counts, F.array_max(counts)).cast("int") - 1)
    return out.withColumns({"dominant": F.when(total > 0, first).otherwise(CODE_NAMES[0]),
                            "dominant_share": F.try_divide(F.array_max(counts), total)})
