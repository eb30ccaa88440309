"""Random forests whose trees grow side by side: Spark deals every tree its draw of the training rows, and a task grows one tree from it.

Training rows are capped per class before (``samples.cap``), so a draw is bounded; its number of rows, not that of the cuts tried,
is what a node costs. A node tries every cut between the values of ceil(sqrt(variables)) variables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surco.session import ship

#: How often a row is drawn: the Poisson law of mean 1, up to nine times.
DRAWS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]
TREE = "tree int, feature array<int>, cut array<double>, left array<int>, share array<double>"


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree, level by level: variable, cut, left child (the right one follows) and class shares of every node; a leaf has variable -1 and
    itself as child."""
    per_node, levels, base, count = math.ceil(math.sqrt(x.shape[1])), [], 0, 1
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level in range(depth + 1):
        mass = np.bincount(node * classes + y[rows], w[rows], count * classes).reshape(count, classes)
        feature, cut, best, left = np.full(count, -1), np.full(count, np.inf), np.full(count, -np.inf), base + np.arange(count)
        keep = (((mass > 0).sum(axis=1) > 1) & (level < depth))[node]
        rows, node = rows[keep], node[keep]
        tried = draw.random((count, x.shape[1])).argsort(axis=1)[:, :per_node]
        for which in tried.T if len(rows) else ():
            v = x[rows, which[node]]
            order = np.lexsort((v, node))
            v, at = v[order], node[order]
            low = np.zeros((len(rows), classes))
            low[np.arange(len(rows)), y[rows[order]]] = w[rows[order]]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            low = np.cumsum(low, axis=0)
            low -= np.repeat(np.r_[np.zeros((1, classes)), low[first[1:] - 1]], np.diff(np.r_[first, len(at)]), axis=0)
            place = np.flatnonzero((at[1:] == at[:-1]) & (v[1:] > v[:-1]))
            if not len(place):
                continue
            at, low = at[place], low[place]
            high = np.maximum(mass[at] - low, 0)
            purity = (low ** 2).sum(axis=1) / low.sum(axis=1) + (high ** 2).sum(axis=1) / high.sum(axis=1)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            top = np.maximum.reduceat(purity, first)
            hit = np.flatnonzero(purity == np.repeat(top, np.diff(np.r_[first, len(at)])))
            nodes, i = np.unique(at[hit], return_index=True)
            a, b = v[place[hit[i]]], v[place[hit[i]] + 1]
            better = top > best[nodes]
            nodes, middle = nodes[better], np.where((a + b) / 2 < b, (a + b) / 2, a)[better]
            best[nodes], feature[nodes], cut[nodes] = top[better], which[nodes], middle
        split = feature >= 0
        child = 2 * (np.cumsum(split) - 1)
        left[split] = base + count + child[split]
        levels.append((feature, cut, left, (mass / mass.sum(axis=1, keepdims=True)).ravel()))
        keep = split[node]
        rows, node = rows[keep], node[keep]
        node = child[node] + (x[rows, feature[node]] > cut[node])
        base, count = base + count, 2 * int(split.sum())
        if not count:
            break
    return tuple(np.concatenate(part) for part in zip(*levels))


def votes(trees: list[tuple[np.ndarray, ...]], x: np.ndarray, classes: int) -> np.ndarray:
    """The mean of the class shares of all trees for each row."""
    out, rows = np.zeros((len(x), classes)), np.arange(len(x))
    for feature, cut, left, share in trees:
        at = np.zeros(len(x), np.int64)
        while True:
            after = left[at] + (x[rows, feature[at]] > cut[at])
            if np.array_equal(after, at):
                break
            at = after
        out += share.reshape(-1, classes)[at]
    return out / len(trees)


@dataclass(frozen=True)
class Model:
    """The trees of a fitted forest, broadcast to the tasks that predict."""

    trees: object
    getNumTrees: int
    numClasses: int
    numFeatures: int

    def probability(self, features: Column) -> Column:
        trees, classes = self.trees, self.numClasses

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(votes(trees.value, np.stack(x), classes))) if len(x) else pd.Series([], dtype=object)

        return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(vector_to_array(features))


@dataclass(frozen=True)
class Estimator:
    trees: int
    seed: int
    depth: int

    def fit(self, data: DataFrame) -> Model:
        """``data``: px_id, features, label (0, 1, ...), weight. How often a tree draws a row is a hash's, so results repeat."""
        spark, depth, seed = data.sparkSession, self.depth, self.seed
        ship(spark)
        classes, width = data.agg((F.max("label").cast("int") + 1), F.max(F.size(vector_to_array("features")))).first()
        each = data.select("px_id", vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), "weight",
                           F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree"))
        u = F.pmod(F.xxhash64("px_id", "x", "tree", F.lit(seed)), F.lit(1 << 32)) / (1 << 32)
        times = sum(((u >= p).cast("int") for p in DRAWS[1:]), (u >= DRAWS[0]).cast("int"))
        drawn = each.select("tree", "px_id", "x", "y", (F.col("weight") * times).alias("w")).filter("w > 0")

        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("px_id", kind="stable")
            tree = grow(np.stack(rows["x"]), rows["y"].to_numpy(), rows["w"].to_numpy(), classes, depth, np.random.default_rng((seed, key[0])))
            return pd.DataFrame([(key[0], *tree)], columns=["tree", "feature", "cut", "left", "share"])

        grown = drawn.groupBy("tree").applyInPandas(one, TREE).toPandas().sort_values("tree")
        trees = list(zip(*[[np.asarray(v) for v in grown[c]] for c in ("feature", "cut", "left", "share")]))
        return Model(spark.sparkContext.broadcast(trees), len(trees), classes, width)
