"""Tables behind the municipal maps: every municipality with its value, class and label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surco.operators.ranks import exact_quantiles

# The month each cycle's legend starts with.
FIRST_MONTH = {"OI": 10, "PV": 4}


def choropleth(municipalities: DataFrame, summary: DataFrame, value: str, date: str) -> DataFrame:
    """All municipalities for every (cycle, year) of the summary; those without data keep NULL.

    The (cycle, year) pairs are a short list (one per season), carried as one array per
    municipality so that no pair table is joined.
    """
    seasons = summary.select("ciclo", "anio").distinct().agg(F.sort_array(F.collect_list(F.struct("ciclo", "anio"))))
    base = municipalities.withColumn("seasons", seasons.scalar()).select("cvegeo", "municipio", F.inline("seasons"))
    j = base.join(summary.select("ciclo", "anio", "cvegeo", F.col(value).alias("valor"), F.col(date).alias("fecha"), F.lit(1).alias("hit")),
                  ["ciclo", "anio", "cvegeo"], "left")
    text = F.when(F.col("fecha").isNotNull(), F.concat(
        F.lit(" / "), F.day("fecha").cast("string"), F.lit("-"), F.month("fecha").cast("string"))).otherwise("")
    return j.select("ciclo", "anio", "cvegeo", "municipio", F.col("hit").isNull().cast("int").alias("sin_dato"),
                    F.month("fecha").alias("mes"), F.concat("municipio", text).alias("etiqueta"),
                    (F.round("valor", 6) + 0.0).alias("valor"))


def quantile_classes(df: DataFrame, keys: Sequence[str], value: str, n: int = 5) -> DataFrame:
    """Class 1..n of each value by quantile; a value on a break belongs to the lower class."""
    probs = {f"b{i}": i / n for i in range(1, n)}
    breaks = exact_quantiles(df, keys, value, probs)
    above = sum(((F.col(value) > F.col(b)).cast("int") for b in probs), F.lit(1))
    return df.join(breaks, list(keys)).withColumn("class", above).drop(*probs)


def month_order(month: Column, cycle: Column) -> Column:
    """Months in the order of the cycle (OI from October, PV from April)."""
    first = F.when(cycle == "OI", FIRST_MONTH["OI"]).otherwise(FIRST_MONTH["PV"])
    return F.pmod(month - first, F.lit(12))
