"""Readers of the official crop-progress table (delimited text) and its sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surco.functions.text import NUMBER, norm_name

# Labels in the export.
CYCLE_LABELS = {"Otoño - Invierno": "OI", "Primavera - Verano": "PV"}
REGIME_LABELS = {"Riego": "riego", "Temporal": "temporal"}
FULL_COLUMNS = ("sembrada_ha", "cosechada_ha", "siniestrada_ha", "produccion")
KEY = ("cvegeo", "anio", "ciclo", "modalidad", "cultivo", "fecha")


def read_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A header CSV as strings; blank cells become NULL."""
    return spark.read.csv(path, header=True, encoding=encoding, escape='"', multiLine=False, inferSchema=False)


def write_text(df: DataFrame, path: str) -> None:
    """A header CSV; every file begins with a byte-order mark, by which spreadsheets know the encoding. Spark's reader skips it."""
    first = df.columns[0]
    df.withColumnRenamed(first, f"\ufeff{first}").write.mode("errorifexists").csv(path, header=True, escape='"')


def _code(column: str, labels: dict[str, str]) -> Column:
    text = F.trim(F.col(column))
    out = F.lit(None).cast("string")
    for label, code in labels.items():
        out = F.when(text == label, F.lit(code)).otherwise(out)
    return out


def _amount(column: str) -> Column:
    """Blank counts as zero, anything unreadable as NULL."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    return F.when(text == "", F.lit(0.0)).otherwise(F.when(text.rlike(NUMBER), text.try_cast("double")))


def with_municipality(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``cvegeo`` by municipality name; names that match nothing stay NULL.

    ``names`` has one row per municipality of the layer; Spark broadcasts it only when its
    measured size is small.
    """
    keyed = names.select(norm_name(F.col("municipio")).alias("name_key"), "cvegeo").groupBy("name_key").agg(
        F.max("cvegeo").alias("cvegeo"))
    return raw.withColumn("name_key", norm_name(F.col("municipio"))).join(keyed, "name_key", "left").drop("name_key")


def unmatched_names(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct municipality names of an export that the layer does not know."""
    known = names.select(norm_name(F.col("municipio")).alias("name_key")).distinct()
    return (raw.filter(F.trim("municipio") != "").select("municipio").distinct()
            .withColumn("name_key", norm_name(F.col("municipio"))).join(known, "name_key", "left_anti").select("municipio"))


def typed_rows(raw: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Usable rows: no warning, known cycle and regime, readable year, date and amounts, known municipality."""
    if "cvegeo" not in raw.columns:
        raw = with_municipality(raw, names)
    rows = raw.select(
        F.trim("cvegeo").alias("cvegeo"), "municipio", F.col("anio_agricola").try_cast("double").cast("int").alias("anio"),
        _code("ciclo", CYCLE_LABELS).alias("ciclo"), _code("modalidad", REGIME_LABELS).alias("modalidad"),
        F.trim("cultivo").alias("cultivo"), F.try_to_date(F.substring("fecha_corte", 1, 10), "yyyy-M-d").alias("fecha"),
        _amount("sembrada_ha").alias("sembrada"), _amount("cosechada_ha").alias("cosechada"),
        F.trim(F.coalesce("aviso", F.lit(""))).alias("aviso"))
    needed = ("anio", "ciclo", "modalidad", "cultivo", "fecha", "sembrada", "cosechada")
    return rows.filter((F.col("aviso") == "") & (F.col("cvegeo") != "")).dropna(subset=list(needed)).drop("aviso")


def read_full(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """The full table from its files: of rows with the same key the last one counts, in file and line order."""
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return merge_last_wins([full_rows(read_text(spark, path).withColumn("line", line), names, ("line",))], "line").drop("line")


def full_rows(raw: DataFrame, names: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """The reader of the maps: every amount, blanks as zero, only rows with a cut."""
    if "cvegeo" not in raw.columns:
        raw = with_municipality(raw, names)
    rows = raw.filter(F.trim(F.coalesce("aviso", F.lit(""))) == "").select(
        F.trim("cvegeo").alias("cvegeo"), "municipio", F.col("anio_agricola").try_cast("double").cast("int").alias("anio"),
        _code("ciclo", CYCLE_LABELS).alias("ciclo"), _code("modalidad", REGIME_LABELS).alias("modalidad"),
        F.trim("cultivo").alias("cultivo"), F.try_to_date(F.substring("fecha_corte", 1, 10), "yyyy-M-d").alias("fecha"),
        *[F.coalesce(_amount(c), F.lit(0.0)).alias(c.removesuffix("_ha")) for c in FULL_COLUMNS],
        F.col("anio_consulta").try_cast("double").cast("int").alias("anio_consulta"), *more)
    return rows.filter(F.col("fecha").isNotNull() & (F.col("cvegeo") != ""))


def require_rows(df: DataFrame) -> DataFrame:
    """An export without one usable row is an error."""
    if df.isEmpty():
        raise ValueError("no usable rows")
    return df


def merge_last_wins(parts: list[DataFrame], order_col: str, key=KEY) -> DataFrame:
    """Rows of later parts replace those with the same key; within a part the larger ``order_col`` wins.

    Equal places are settled by the rows' values. The maximum combines on the map side, so any number of
    copies of a key reduces before the shuffle.
    """
    tagged = None
    for i, part in enumerate(parts):
        rows = part.withColumn("merge_order", F.struct(F.lit(i).alias("part"), F.col(order_col).alias("row")))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    others = [c for c in tagged.columns if c not in (*key, "merge_order")]
    best = tagged.groupBy(*key).agg(F.max(F.struct("merge_order", *others)).alias("row"))
    return best.select(*key, *[F.col("row")[c].alias(c) for c in others])
