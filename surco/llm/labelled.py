"""The bounded sample of labelled rows that the two classifiers are fitted on, and their logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surco.llm.common import held_out

#: The most labelled rows that a model is fitted on, chosen by a hash of the id.
SAMPLE_ROWS = 20_000


def marked(labels: DataFrame, mark: str) -> DataFrame:
    """``doc_id, label`` of all labelled rows, none of them held out."""
    return labels.filter(F.col(mark).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col(mark).cast("int").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, mark: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, label`` of up to ``rows`` labelled documents, none of them held out."""
    chosen = marked(labels, mark).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` short rows


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Coefficients of a logistic regression without intercept, by damped Newton steps."""
    w = np.ones(len(y)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * beta
        curve = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 4.0 / max(np.abs(step).max(initial=0), 1e-12))
        if np.abs(step).max(initial=0) < 1e-6:
            break
    return beta
