"""Sinks of results: the variables table with its catalogue and parameters, validation reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(long: DataFrame, path: str, parameters: dict, counts: DataFrame | None = None) -> None:
    """Variables and observation counts partitioned by sensor and window, the catalogue of names, and the run's parameters.

    The partitions follow the way variables are read: a model asks for some windows of a sensor. Rows are
    rebalanced, so the size of the data decides how many files a partition gets. ``counts``: sensor, window, px_id, nobs.
    """
    spark = long.sparkSession
    long.select("sensor", "window", "px_id", "name", "variable", "value").hint("rebalance", "sensor", "window").write.partitionBy(
        "sensor", "window").parquet(f"{path}/variables")
    back = spark.read.parquet(f"{path}/variables")
    back.select("name", "sensor", "window", "variable").distinct().write.parquet(f"{path}/catalogue")
    if counts is not None:
        counts.select("sensor", "window", "px_id", "nobs").hint("rebalance", "sensor", "window").write.partitionBy("sensor", "window").parquet(f"{path}/counts")
    spark.createDataFrame([(json.dumps(parameters),)], "parameters string").write.json(f"{path}/parameters")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (spark.read.parquet(f"{path}/variables"), spark.read.parquet(f"{path}/catalogue"), spark.read.json(f"{path}/parameters"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/counts")


def write_report(path: str, confusions: dict[str, DataFrame], importance: DataFrame | None = None, parameters: dict | None = None) -> None:
    """A validation report: counts (level, clase, pred, n) of every table, importance by the first step, largest first, and the run's parameters.

    ``confusions``: by level, one row per true class and one column per predicted one; levels may have labels of their own.
    """
    rows = None
    for level, matrix in confusions.items():
        labels = [c for c in matrix.columns if c != "clase"]
        part = matrix.unpivot("clase", labels, "pred", "n").select(F.lit(level).alias("level"), "clase", "pred", "n")
        rows = part if rows is None else rows.unionByName(part)
    rows.write.csv(f"{path}/confusion", header=True)
    if importance is not None:
        importance.orderBy(F.desc("step1"), "var").select(
            "var", *[F.format_number(s, "0.0000").alias(s) for s in ("step1", "step2")]).write.csv(f"{path}/importance", header=True)
    if parameters is not None:
        rows.sparkSession.createDataFrame([(json.dumps(parameters),)], "parameters string").write.json(f"{path}/parameters")


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(f"{path}/confusion", header=True, schema="level string, clase string, pred string, n bigint")


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(f"{path}/importance", header=True, schema="var string, step1 double, step2 double")


def read_parameters(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(f"{path}/parameters").first()[0])
