"""Raw responses of the official statistics site: whole texts in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surco.functions.text import number, spanish_date, strip_markup

# Request codes and the shape of the saved file names.
FILE_PATTERN = r"(\d{4})_(OI|PV)_(riego|temporal)_(sorgo|maiz)_mes(\d{2})\.xml$"
CYCLES = {"OI": "Otoño - Invierno", "PV": "Primavera - Verano"}
REGIMES = {"riego": "Riego", "temporal": "Temporal"}
CROPS = {"sorgo": "Sorgo grano", "maiz": "Maíz grano"}
BLOCK = '<div class="titulosTabla">'
HEADER = {
    "anio": r"Año agrícola:\s*(\d{4})",
    "ciclo": r"Ciclo:\s*(.*?)\s+Modalidad:",
    "modalidad": r"Modalidad:\s*(.*?)\s+(?:Cultivo:|Entidad|Situación)",
    "cultivo": r"Cultivo:\s*(.*?)\s+(?:Entidad|Situación)",
    "corte": r"Situación al\s*(.*)$",
}
AMOUNTS = ("sembrada_ha", "cosechada_ha", "siniestrada_ha", "produccion", "rendimiento")


def _label(code: Column, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, text in labels.items():
        out = F.when(code == key, F.lit(text)).otherwise(out)
    return out


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Saved responses, one whole file per row; the request is read from the file name."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    return with_request(files)


def write_raw(files: DataFrame, path: str) -> int:
    """Save responses (file_name, value), one file each, in the folder ``path``; tells how many. An existing file of the name is replaced.

    Every task writes its own rows, through the file system of the path.
    """
    def save(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for name, value in zip(batch.column("file_name").to_pylist(), batch.column("value").to_pylist()):
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(value.encode("utf-8"))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return files.select("file_name", "value").mapInArrow(save, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def with_request(files: DataFrame) -> DataFrame:
    """Files with a name of the known form, with the request it stands for."""
    part = lambda i: F.regexp_extract("file_name", FILE_PATTERN, i)
    return files.filter(F.col("file_name").rlike("^" + FILE_PATTERN)).select(
        "file_name", "value", part(1).cast("int").alias("anio_consulta"), part(2).alias("ciclo_pedido"),
        part(3).alias("modalidad_pedida"), part(4).alias("cultivo_pedido"), part(5).cast("int").alias("mes_consulta"))


def blocks(raw: DataFrame, text: str = "value") -> DataFrame:
    """One row per table block of a response (a response may carry an earlier year's block too)."""
    inner = F.regexp_extract(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1)
    body = F.regexp_replace(F.when(inner != "", inner).otherwise(F.col(text)), "(?s)<!--.*?-->", "")
    pieces = F.filter(F.split(body, f"(?={BLOCK})"), lambda p: p.contains("titulosTabla"))
    return raw.select("*", F.posexplode_outer(pieces).alias("block_no", "block")).drop(text)


def with_header(block_rows: DataFrame) -> DataFrame:
    """Year, cycle, regime, crop and cut read from the title of a block."""
    title = strip_markup(F.regexp_extract("block", r'(?s)titulosTabla">(.*?)</div>', 1))
    found = block_rows.withColumn("title", title)
    found = found.withColumns({f"cab_{k}": F.trim(F.regexp_extract("title", p, 1)) for k, p in HEADER.items()})
    return found.withColumn("fecha_corte", spanish_date(F.col("cab_corte"))).drop("title")


def with_rows(headed: DataFrame) -> DataFrame:
    """Table rows of each block: text cells after the first, five amounts or more; empty blocks keep one row."""
    trs = F.regexp_extract_all("block", F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1))

    def cells(tr: Column) -> Column:
        attrs = F.regexp_extract_all(tr, F.lit(r"(?s)<td([^>]*)>.*?</td>"), F.lit(1))
        texts = F.regexp_extract_all(tr, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
        pairs = F.arrays_zip(attrs.alias("a"), texts.alias("t"))
        words = F.transform(F.filter(pairs, lambda c: ~c["a"].contains("tdNum")), lambda c: strip_markup(c["t"]))
        nums = F.transform(F.filter(pairs, lambda c: c["a"].contains("tdNum")), lambda c: number(strip_markup(c["t"])))
        return F.struct(F.slice(words, F.lit(2), F.size(words)).alias("w"), nums.alias("n"))

    usable = F.filter(F.transform(trs, cells), lambda c: (F.size(c["n"]) >= 5) & (F.size(c["w"]) > 0))
    rows = headed.select("*", F.explode_outer(usable).alias("cell")).drop("block")
    w, n = F.col("cell.w"), F.col("cell.n")
    return rows.withColumns({
        "entidad": w[0], "distrito": F.when(F.size(w) >= 3, w[1]).when(F.size(w) > 0, ""),
        "municipio": F.try_element_at(w, F.lit(-1)),
        **{a: F.try_element_at(n, F.lit(i + 1)) for i, a in enumerate(AMOUNTS)}})


def with_check(rows: DataFrame) -> DataFrame:
    """``aviso``: what in the header differs from the request, and ``sin datos`` for an empty block."""

    def differs(got: str, asked: str, labels: dict[str, str], word: str) -> Column:
        return F.when((F.col(got) != "") & (F.col(got) != _label(F.col(asked), labels)), F.concat(F.lit(word), F.col(got)))

    got = F.coalesce("cab_cultivo", F.lit(""))
    crop = F.when(~got.startswith(_label(F.col("cultivo_pedido"), CROPS)), F.concat(
        F.lit("cultivo recibido: "), F.when(got == "", "(ninguno)").otherwise(got)))
    return rows.withColumn("aviso", F.concat_ws(
        "; ", differs("cab_ciclo", "ciclo_pedido", CYCLES, "ciclo recibido: "),
        differs("cab_modalidad", "modalidad_pedida", REGIMES, "modalidad recibida: "), crop,
        F.when(F.col("cell").isNull(), "sin datos")))


def report_rows(raw: DataFrame) -> DataFrame:
    """Rows of the progress table from raw responses, as text columns the progress reader accepts."""
    rows = with_check(with_rows(with_header(blocks(raw))))
    return rows.select(
        "anio_consulta", F.coalesce("cab_anio", F.lit("")).alias("anio_agricola"),
        _label(F.col("ciclo_pedido"), CYCLES).alias("ciclo"), _label(F.col("modalidad_pedida"), REGIMES).alias("modalidad"),
        _label(F.col("cultivo_pedido"), CROPS).alias("cultivo"), "mes_consulta",
        F.coalesce("fecha_corte", F.lit("")).alias("fecha_corte"), "entidad", "distrito", "municipio", *AMOUNTS, "aviso")


def request_plan(years: DataFrame, today: Column, cycles=("OI", "PV")) -> DataFrame:
    """Requests that cover the agricultural years completely: consult year, cycle, month, regime, crop.

    OI of a year takes October to December of the year before and the whole year; PV April to
    December and January to March of the next. Months still to come are left out.
    """

    def months(year: Column, cycle: str, lo: int, hi: int) -> Column:
        return F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda m: F.struct(
            year.cast("int").alias("anio_consulta"), F.lit(cycle).alias("ciclo"), m.alias("mes")))

    y = F.col("anio")
    spans = {"OI": [months(y - 1, "OI", 10, 12), months(y, "OI", 1, 12)],
             "PV": [months(y, "PV", 4, 12), months(y + 1, "PV", 1, 3)]}
    plan = years.select(F.inline(F.concat(*[s for c in cycles for s in spans[c]]))).distinct()
    plan = plan.filter(F.make_date("anio_consulta", "mes", F.lit(1)) <= today)
    return plan.select("*", F.explode(F.array(*[F.lit(r) for r in REGIMES])).alias("modalidad")).select(
        "*", F.explode(F.array(*[F.lit(c) for c in CROPS])).alias("cultivo"))
