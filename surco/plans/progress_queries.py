"""Queries over the official crop-progress figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from surco.functions import text as T
from surco.operators import maps as M
from surco.operators import progress as P
from surco.plans.curve_queries import rounded, with_cte
from surco.plans.registry import query
from surco.session import scratch_path
from surco.sources import progress as SRC
from surco.sources import reports as R
from surco.sources.adapters import oracle, view

CROPS_SQL = "('Maíz grano', 'Sorgo grano')"
NORM = "trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"


def progress(spark, sf_dir):
    return view(spark, sf_dir, "crop_progress")


def text_file(spark, sf_dir):
    """The export as delimited text in the shared folder, read back with the reader."""
    path = scratch_path(spark, "progress")
    SRC.write_text(view(spark, sf_dir, "progress_text"), path)
    return SRC.read_text(spark, path)


CTE_TEXT = f"""t AS (SELECT * FROM {{progress_text}} t),
names AS (SELECT cvegeo, {NORM.format('municipio')} AS k FROM {{municipality}} m),
tt AS (SELECT t.*, n.cvegeo FROM t LEFT JOIN names n ON n.k = {NORM.format('t.municipio')})"""
TYPED = """CAST(CAST(anio_agricola AS DOUBLE) AS INT) AS anio,
  CASE trim(ciclo) WHEN 'Otoño - Invierno' THEN 'OI' WHEN 'Primavera - Verano' THEN 'PV' END AS ciclo,
  lower(trim(modalidad)) AS modalidad, trim(cultivo) AS cultivo, left(fecha_corte, 10) AS fecha"""


@query("src_progress_table", with_cte(CTE_TEXT, f"""
SELECT * FROM (SELECT cvegeo, trim(municipio) AS municipio, {TYPED},
  CASE WHEN sembrada_ha = '' THEN 0e0 ELSE TRY_CAST(sembrada_ha AS DOUBLE) END AS sembrada,
  CASE WHEN cosechada_ha = '' THEN 0e0 ELSE TRY_CAST(cosechada_ha AS DOUBLE) END AS cosechada
  FROM tt WHERE aviso = '' AND cvegeo IS NOT NULL) WHERE ciclo IS NOT NULL AND sembrada IS NOT NULL AND cosechada IS NOT NULL"""))
def src_progress_table(spark, sf_dir):
    rows = SRC.require_rows(SRC.typed_rows(text_file(spark, sf_dir), view(spark, sf_dir, "municipality")))
    return rounded(rows.withColumn("municipio", F.trim("municipio")), ())


@query("src_progress_full", with_cte(CTE_TEXT, f"""
SELECT cvegeo, trim(municipio) AS municipio, {TYPED}, coalesce(TRY_CAST(nullif(sembrada_ha, '') AS DOUBLE), 0) AS sembrada,
  coalesce(TRY_CAST(nullif(cosechada_ha, '') AS DOUBLE), 0) AS cosechada, CAST(siniestrada_ha AS DOUBLE) AS siniestrada,
  CAST(produccion AS DOUBLE) AS produccion, CAST(anio_consulta AS INT) AS anio_consulta
FROM tt WHERE aviso = '' AND cvegeo IS NOT NULL"""))
def src_progress_full(spark, sf_dir):
    path = scratch_path(spark, "progress")
    SRC.write_text(view(spark, sf_dir, "progress_text"), path)
    rows = SRC.read_full(spark, path, view(spark, sf_dir, "municipality"))
    return rounded(rows.withColumn("municipio", F.trim("municipio")), ())


@query("name_match", with_cte(CTE_TEXT, """
SELECT t.municipio, cvegeo, count(*) AS n FROM tt t WHERE cvegeo IS NOT NULL GROUP BY 1, 2"""))
def name_match(spark, sf_dir):
    rows = SRC.with_municipality(view(spark, sf_dir, "progress_text"), view(spark, sf_dir, "municipality"))
    return rows.filter(F.col("cvegeo").isNotNull()).groupBy("municipio", "cvegeo").agg(F.count(F.lit(1)).alias("n"))


@query("unmatched_names", with_cte(CTE_TEXT, "SELECT DISTINCT municipio FROM tt WHERE cvegeo IS NULL"))
def unmatched_names(spark, sf_dir):
    return SRC.unmatched_names(view(spark, sf_dir, "progress_text"), view(spark, sf_dir, "municipality")).orderBy("municipio")


@query("norm_name", oracle("SELECT doc_id, " + NORM.replace("{}", "text").replace("{", "{{").replace("}", "}}") + " AS name_key FROM {documents}"))
def norm_name(spark, sf_dir):
    from surco.sources.adapters import table
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_name(F.col("text")).alias("name_key"))


@query("slug", oracle("""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'),
  '[^A-Za-z0-9]', '_', 'g'), '_') AS slug FROM {documents}"""))
def slug(spark, sf_dir):
    from surco.sources.adapters import table
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("merge_last_wins", oracle("""
SELECT cvegeo, anio, ciclo, modalidad, cultivo, CAST(fecha AS VARCHAR) AS fecha,
  CASE WHEN month(fecha) = 3 AND modalidad = 'riego' THEN -2e0 WHEN month(fecha) = 3 THEN -1e0 ELSE sembrada END AS sembrada
FROM {crop_progress} p UNION ALL
SELECT DISTINCT cvegeo, anio, ciclo, modalidad, 'Otro grano', CAST(fecha AS VARCHAR), -1e0 FROM {crop_progress} q WHERE month(fecha) = 3"""))
def merge_last_wins(spark, sf_dir):
    base = progress(spark, sf_dir).select(*SRC.KEY, "sembrada", F.lit(0).alias("line"))
    march = base.filter(F.month("fecha") == 3).withColumn("sembrada", F.lit(-1.0))
    new = march.withColumn("cultivo", F.lit("Otro grano")).distinct()
    irrigated = march.filter(F.col("modalidad") == "riego").withColumn("sembrada", F.lit(-2.0))
    return rounded(SRC.merge_last_wins([base, march.unionByName(new), irrigated], "line").drop("line"), ())


# ------------------------------------------------------------------ profile family
CTE_SERIES = f"""p AS (SELECT * FROM {{crop_progress}} p),
cuts AS (SELECT DISTINCT ciclo, anio, fecha FROM p),
c0 AS (SELECT ciclo, anio, min(fecha) AS fc FROM cuts GROUP BY 1, 2),
acc AS (SELECT cvegeo, modalidad, ciclo, anio, fecha, sum(sembrada) AS s, sum(cosechada) AS c FROM p WHERE cultivo IN {CROPS_SQL} GROUP BY 1, 2, 3, 4, 5),
fst AS (SELECT cvegeo, modalidad, ciclo, anio, min(fecha) AS f0 FROM acc GROUP BY 1, 2, 3, 4),
ser AS (SELECT * FROM acc
  UNION ALL SELECT f.cvegeo, f.modalidad, ciclo, anio, k.fecha, 0e0, 0e0 FROM fst f JOIN cuts k USING (ciclo, anio) WHERE k.fecha < f.f0
  UNION ALL SELECT f.cvegeo, f.modalidad, ciclo, anio, CAST(date_trunc('month', fc) AS DATE) - 1, 0e0, 0e0 FROM fst f JOIN c0 USING (ciclo, anio)
    WHERE fc <= CASE WHEN ciclo = 'OI' THEN make_date(anio - 1, 10, 31) ELSE make_date(anio, 5, 31) END)"""
KEYS = "cvegeo, modalidad, ciclo, anio"


def _cross(p, v):
    return (f"min(CASE WHEN {v}_first < {p} AND {v}_prev < {p} AND {v} >= {p} THEN prev + "
            f"CAST(round_even(({p} - {v}_prev) / ({v} - {v}_prev) * (fecha - prev), 0) AS INT) END)")


CTE_DATES = CTE_SERIES + f""",
tot AS (SELECT {KEYS}, max(s) AS ts, max(c) AS tc FROM ser GROUP BY ALL),
fr AS (SELECT x.*, ts, tc, CASE WHEN ts > 0 THEN s / ts END AS fs, CASE WHEN ts > 0 AND tc > 0 THEN c / tc END AS fc FROM ser x JOIN tot USING ({KEYS})),
lg AS (SELECT *, lag(fecha) OVER w AS prev, lag(fs) OVER w AS fs_prev, lag(fc) OVER w AS fc_prev, first_value(fs) OVER w AS fs_first,
  first_value(fc) OVER w AS fc_first FROM fr WINDOW w AS (PARTITION BY {KEYS} ORDER BY fecha)),
cyc AS (SELECT {KEYS}, any_value(ts) AS ts, any_value(tc) AS tc, {_cross('0.1e0', 'fs')} AS S10, {_cross('0.5e0', 'fs')} AS S50,
  {_cross('0.9e0', 'fs')} AS S90, {_cross('0.5e0', 'fc')} AS H50, {_cross('0.9e0', 'fc')} AS H90, min(fecha) AS cut0, any_value(fs_first) AS f0,
  arg_max(fc, fecha) AS last_h,
  string_agg(CASE WHEN fs - fs_prev > 0.5e0 AND fs >= 0.999e0 THEN CAST(CAST(round_even(100 * (fs - fs_prev), 0) AS INT) AS VARCHAR)
   || ' % de la siembra en el corte que cierra la serie (' || CAST(fecha AS VARCHAR) || '); puede ser un cierre administrativo' END, ' | ' ORDER BY fecha) AS jump
  FROM lg GROUP BY ALL),
wr AS (SELECT *, CASE WHEN ts <= 0 THEN 'sin siembra' ELSE concat_ws(' | ',
  CASE WHEN f0 > 0.1e0 THEN 'sin datos del arranque (primer corte ' || CAST(cut0 AS VARCHAR) || ' ya al ' || CAST(CAST(round_even(100 * f0, 0) AS INT) AS VARCHAR) || ' %)' END,
  jump, CASE WHEN tc <= 0 THEN 'sin cosecha registrada' WHEN last_h < 0.9e0 THEN 'cosecha sin terminar en el último corte' END) END AS warnings FROM cyc)"""


@query("progress_series_profile", with_cte(CTE_SERIES, f"SELECT {KEYS}, CAST(fecha AS VARCHAR) AS fecha, s AS sembrada, c AS cosechada FROM ser"))
def progress_series_profile(spark, sf_dir):
    return rounded(P.series_profile(progress(spark, sf_dir)), ())


def dates(spark, sf_dir):
    return P.cycle_dates(P.series_profile(progress(spark, sf_dir)))


@query("cumulative_crossing", with_cte(CTE_DATES, f"SELECT {KEYS}, ts AS sembrada, tc AS cosechada, " + ", ".join(
    f"CAST({q} AS VARCHAR) AS {q}" for q in P.QUANTILES) + " FROM cyc"))
def cumulative_crossing(spark, sf_dir):
    return rounded(dates(spark, sf_dir).drop("warnings"), ())


@query("series_warnings", with_cte(CTE_DATES, f"SELECT {KEYS}, warnings FROM wr"))
def series_warnings(spark, sf_dir):
    return dates(spark, sf_dir).select(*P.SERIES, F.array_join("warnings", " | ").alias("warnings"))


CTE_MEDIAN = CTE_DATES + """,
lng AS (SELECT cvegeo, modalidad, ciclo, anio, q.key AS key, q.d AS d FROM (SELECT cvegeo, modalidad, ciclo, anio, unnest([""" + ", ".join(
    f"{{{{'key': '{q}', 'd': {q}}}}}" for q in P.QUANTILES) + """]) AS q FROM cyc)),
md AS (SELECT cvegeo, modalidad, ciclo, key, (CASE WHEN ciclo = 'OI' THEN DATE '2000-08-01' ELSE DATE '2001-01-01' END)
   + CAST(round_even(median(d - CASE WHEN ciclo = 'OI' THEN make_date(anio - 1, 8, 1) ELSE make_date(anio, 1, 1) END), 0) AS INT) AS d,
  string_agg(CAST(anio AS VARCHAR), ',' ORDER BY anio) AS years FROM lng WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query("profile_dates_median", with_cte(CTE_MEDIAN, "SELECT cvegeo, modalidad, ciclo, key, strftime(d, '%m-%d') AS mmdd, years FROM md"))
def profile_dates_median(spark, sf_dir):
    return P.median_dates(dates(spark, sf_dir)).select(
        "cvegeo", "modalidad", "ciclo", "key", P.mmdd(F.col("date")).alias("mmdd"),
        F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


CTE_STAGES = CTE_MEDIAN + """,
wd AS (SELECT cvegeo, modalidad, ciclo, """ + ", ".join(f"max(d) FILTER (WHERE key = '{q}') AS {q}" for q in P.QUANTILES) + """
  FROM md GROUP BY 1, 2, 3),
yy AS (SELECT cvegeo, modalidad, ciclo, string_agg(CAST(anio AS VARCHAR), ',' ORDER BY anio) AS years FROM
  (SELECT DISTINCT cvegeo, modalidad, ciclo, anio FROM lng WHERE d IS NOT NULL) GROUP BY 1, 2, 3),
ar AS (SELECT cvegeo, modalidad, ciclo, median(ts) AS area FROM cyc GROUP BY 1, 2, 3),
s1 AS (SELECT *, CASE WHEN H50 - 30 <= S90 + 12 THEN S90 + 10 + CAST(floor((H50 - (S90 + 10)) / 2) AS INT) END AS mid0
  FROM ar LEFT JOIN wd USING (cvegeo, modalidad, ciclo) LEFT JOIN yy USING (cvegeo, modalidad, ciclo)),
s2 AS (SELECT *, coalesce(mid0 - 1, S90 + 10) AS e0, coalesce(mid0 + 1, H50 - 30) AS m0 FROM s1),
s3 AS (SELECT *, e0 + CAST(floor((m0 - e0) / 2) AS INT) AS mid,
  CASE WHEN S10 IS NULL OR S90 IS NULL OR H50 IS NULL OR H90 IS NULL THEN 'faltan ' || concat_ws(',', CASE WHEN S10 IS NULL THEN 'S10' END,
   CASE WHEN S90 IS NULL THEN 'S90' END, CASE WHEN H50 IS NULL THEN 'H50' END, CASE WHEN H90 IS NULL THEN 'H90' END)
   WHEN H90 <= m0 THEN 'cosecha antes de la madurez' END AS err FROM s2),
s4 AS (SELECT *, CASE WHEN area < 500 THEN 'omitido: ' || CAST(CAST(round_even(area, 0) AS BIGINT) AS VARCHAR) || ' ha < 500'
   WHEN err IS NOT NULL THEN 'omitido: ' || err ELSE 'ok: ' || CAST(CAST(round_even(area, 0) AS BIGINT) AS VARCHAR) || ' ha' END AS report,
  CASE WHEN err IS NULL THEN strftime(S10, '%m-%d') || '..' || strftime(e0, '%m-%d') || ' ' || strftime(e0 + 1, '%m-%d') || '..' || strftime(mid, '%m-%d')
   || ' ' || strftime(mid + 1, '%m-%d') || '..' || strftime(m0 - 1, '%m-%d') || ' ' || strftime(m0, '%m-%d') || '..' || strftime(H90, '%m-%d') END AS stages FROM s3)"""


def stage_text():
    return F.array_join(F.transform("stages", lambda s: F.concat(P.mmdd(s["from"]), F.lit(".."), P.mmdd(s["to"]))), " ")


@query("stages_from_dates", with_cte(CTE_STAGES, "SELECT cvegeo, modalidad, ciclo, stages, CASE WHEN err IS NULL THEN '" + " | ".join(P.stage_origins(10, 30)) + "' END AS origins, err AS stage_error FROM s3 "
                                    "JOIN (SELECT cvegeo, modalidad, ciclo, stages FROM s4) USING (cvegeo, modalidad, ciclo) "
                                    "SEMI JOIN wd USING (cvegeo, modalidad, ciclo)"))
def stages_from_dates(spark, sf_dir):
    med = P.medians_wide(P.median_dates(dates(spark, sf_dir)))
    return P.stages_from_dates(med).select("cvegeo", "modalidad", "ciclo", stage_text().alias("stages"), origin_text().alias("origins"), "stage_error")


def origin_text():
    return F.array_join(F.transform("stages", lambda s: s["origin"]), " | ")


@query("build_profiles", with_cte(CTE_STAGES + """,
wn AS (SELECT cvegeo, modalidad, ciclo, string_agg(ciclo || ' ' || anio || ': ' || w, ' | ' ORDER BY anio, i) AS warnings FROM
  (SELECT cvegeo, modalidad, ciclo, anio, unnest(string_split(warnings, ' | ')) AS w, generate_subscripts(string_split(warnings, ' | '), 1) AS i
   FROM wr WHERE warnings <> '') GROUP BY 1, 2, 3)""", """
SELECT cvegeo, modalidad, ciclo, report, stages, years, round(area, 4) AS area, concat_ws(' | ', warnings,
 CASE WHEN area >= 500 AND H50 - S50 < 90 THEN ciclo || ': de siembra al 50 % a cosecha al 50 % solo ' || (H50 - S50)
  || ' días; no cuadra con maíz o sorgo de grano. Las fechas del Avance pueden reflejar cuándo se registró, no cuándo se sembró. REVISAR' END) AS warnings
FROM s4 LEFT JOIN wn USING (cvegeo, modalidad, ciclo)"""))
def build_profiles(spark, sf_dir):
    c = P.cycle_profiles(progress(spark, sf_dir))
    return rounded(c.select("cvegeo", "modalidad", "ciclo", "report", stage_text().alias("stages"), "area",
                            F.array_join(F.col("years").cast("array<string>"), ",").alias("years"),
                            F.array_join("warnings", " | ").alias("warnings")), (), 4)


@query("profile_json", with_cte(CTE_STAGES + """,
ky AS (SELECT cvegeo, modalidad, ciclo, string_agg(key || '=' || years, ';' ORDER BY key) AS anios FROM md GROUP BY 1, 2, 3)""", f"""
SELECT 'siap_' || cvegeo || '_' || regexp_replace(municipio, '[^A-Za-z0-9]', '_', 'g') || '_' || modalidad AS profile, cvegeo, modalidad, ciclo, stages,
 '{" | ".join(P.stage_origins(10, 30))}' AS origins, anios,
 'SIAP Avance de Siembras y Cosechas, ' || municipio || ', ' || modalidad || '; cultivos: {" + ".join(P.CROPS_DEFAULT)}; emergencia +10 d y madurez -30 d SUPUESTOS' AS note,
 10 AS emergencia_dias, 30 AS madurez_dias
FROM s4 JOIN {{municipality}} m USING (cvegeo) JOIN ky USING (cvegeo, modalidad, ciclo) WHERE report LIKE 'ok%'"""))
def profile_json(spark, sf_dir):
    """Profiles written as JSON documents in the shared folder and read back."""
    from surco.sources import profiles as PR
    docs = P.build_profiles(P.cycle_profiles(progress(spark, sf_dir)), view(spark, sf_dir, "municipality"))
    path = scratch_path(spark, "profiles")
    PR.export_profiles(docs, path)
    back = PR.import_profiles(spark, path, docs.schema)
    years = F.array_join(F.transform("anios", lambda k: F.concat(k["key"], F.lit("="), F.array_join(k["years"].cast("array<string>"), ","))), ";")
    return back.select("profile", "cvegeo", "modalidad", "note", "supuestos.emergencia_dias", "supuestos.madurez_dias", F.explode("cycles").alias("c")).select(
        "profile", "cvegeo", "modalidad", "note", "emergencia_dias", "madurez_dias", "c.ciclo", "c.stages", "c.anios"
    ).withColumns({"origins": origin_text(), "stages": stage_text(), "anios": years})


# ------------------------------------------------------------------ map family
SEL = ("riego", "temporal"), P.CROPS_DEFAULT
CTE_MAP = f"""p AS (SELECT * FROM {{crop_progress}} p), sel AS (SELECT * FROM p WHERE cultivo IN {CROPS_SQL}),
cuts AS (SELECT DISTINCT ciclo, anio, fecha FROM sel), mu AS (SELECT DISTINCT ciclo, anio, cvegeo FROM sel),
sm AS (SELECT ciclo, anio, cvegeo, c.fecha, coalesce(sum(sembrada), 0) AS sembrada, coalesce(sum(cosechada), 0) AS cosechada,
   coalesce(sum(siniestrada), 0) AS siniestrada, coalesce(sum(produccion), 0) AS produccion
  FROM mu JOIN cuts c USING (ciclo, anio) LEFT JOIN sel s USING (ciclo, anio, cvegeo, fecha) GROUP BY ALL),
q AS (SELECT DISTINCT anio_consulta AS y FROM p),
state AS (SELECT ciclo, anio, (CASE WHEN ciclo = 'OI' THEN anio - 1 ELSE anio END) IN (SELECT y FROM q) AS start_ok,
  (CASE WHEN ciclo = 'OI' THEN anio ELSE anio + 1 END) IN (SELECT y FROM q) AS end_ok FROM (SELECT DISTINCT ciclo, anio FROM p)),
lastv AS (SELECT ciclo, anio, cvegeo, max(fecha) AS fecha, arg_max(sembrada, fecha) AS sembrada, arg_max(cosechada, fecha) AS cosechada,
  arg_max(siniestrada, fecha) AS siniestrada, arg_max(produccion, fecha) AS produccion FROM sm GROUP BY 1, 2, 3)"""


def map_series(spark, sf_dir, keys=("cvegeo",)):
    return P.series_map(P.select_rows(progress(spark, sf_dir), *SEL), keys)


@query("progress_series_map", with_cte(CTE_MAP, "SELECT ciclo, anio, cvegeo, CAST(fecha AS VARCHAR) AS fecha, sembrada, cosechada, siniestrada, produccion FROM sm"))
def progress_series_map(spark, sf_dir):
    return rounded(map_series(spark, sf_dir), ())


@query("value_at", with_cte(CTE_MAP, "SELECT ciclo, anio, cvegeo, sembrada AS value FROM sm WHERE fecha = last_day(make_date(anio, 6, 1))"))
def value_at(spark, sf_dir):
    cut = F.last_day(F.make_date("anio", F.lit(6), F.lit(1)))
    return P.value_at(map_series(spark, sf_dir), ("ciclo", "anio", "cvegeo"), "sembrada", cut)


@query("closing", with_cte(CTE_MAP, "SELECT ciclo, anio, cvegeo, CAST(fecha AS VARCHAR) AS fecha, sembrada, cosechada, siniestrada, produccion FROM lastv"))
def closing(spark, sf_dir):
    return rounded(P.closing(map_series(spark, sf_dir), ("ciclo", "anio", "cvegeo")), ())


@query("cutoffs", oracle("SELECT DISTINCT ciclo, anio, CAST(fecha AS VARCHAR) AS fecha FROM {crop_progress} p"))
def cutoffs(spark, sf_dir):
    return rounded(P.cutoffs(progress(spark, sf_dir)), ()).orderBy("ciclo", "anio", "fecha")


@query("years", oracle("SELECT DISTINCT ciclo, anio FROM {crop_progress} p"))
def years(spark, sf_dir):
    return P.years(progress(spark, sf_dir)).orderBy("ciclo", "anio")


@query("cycle_state", with_cte(CTE_MAP, "SELECT ciclo, anio, CAST(start_ok AS INT) AS start_ok, CAST(end_ok AS INT) AS end_ok FROM state"))
def cycle_state(spark, sf_dir):
    return P.cycle_state(progress(spark, sf_dir)).select(
        "ciclo", "anio", F.col("start_ok").cast("int").alias("start_ok"), F.col("end_ok").cast("int").alias("end_ok"))


@query("complete_years", with_cte(CTE_MAP, "SELECT ciclo, anio FROM state WHERE start_ok AND end_ok"))
def complete_years(spark, sf_dir):
    return P.complete_years(P.cycle_state(progress(spark, sf_dir)))


@query("cycle_warning", with_cte(CTE_MAP, "SELECT ciclo, anio, concat_ws(',', CASE WHEN NOT start_ok THEN 'start' END, CASE WHEN NOT end_ok THEN 'end' END) AS warnings FROM state"))
def cycle_warning(spark, sf_dir):
    return P.cycle_warning(P.cycle_state(progress(spark, sf_dir))).withColumn("warnings", F.array_join("warnings", ","))


def _curve_cte(var, name):
    return f""",
{name}_t AS (SELECT s.*, arg_max({var}, fecha) OVER (PARTITION BY ciclo, anio, cvegeo) AS tot,
  CASE WHEN ciclo = 'OI' THEN make_date(anio - 1, 9, 30) ELSE make_date(anio, 3, 31) END AS a0 FROM sm s),
{name}_p AS (SELECT ciclo, anio, cvegeo, a0, fecha - a0 AS day, least(1e0, {var} / tot) AS f FROM {name}_t WHERE tot > 0
  UNION ALL SELECT DISTINCT ciclo, anio, cvegeo, a0, 0, 0e0 FROM {name}_t JOIN state USING (ciclo, anio) WHERE tot > 0 AND start_ok),
{name}_c AS (SELECT ciclo, anio, cvegeo, a0, day, max(f) OVER (PARTITION BY ciclo, anio, cvegeo ORDER BY day, f ROWS UNBOUNDED PRECEDING) AS share FROM {name}_p),
{name}_l AS (SELECT *, lag(day) OVER w AS d0, lag(share) OVER w AS f0, first_value(day) OVER w AS dd, first_value(share) OVER w AS ff,
  row_number() OVER w AS rn FROM {name}_c WINDOW w AS (PARTITION BY ciclo, anio, cvegeo ORDER BY day, share)),
{name}_d AS (SELECT ciclo, anio, cvegeo, any_value(a0) AS a0, arg_min(CASE WHEN share = f0 THEN d0 ELSE d0 + (0.5e0 - f0) / (share - f0) * (day - d0) END, rn)
  FILTER (WHERE d0 IS NOT NULL AND share >= 0.5e0 AND NOT (ff >= 0.5e0 AND dd > 0)) AS day FROM {name}_l GROUP BY 1, 2, 3)"""


@query("fraction_curve", with_cte(CTE_MAP + _curve_cte("sembrada", "sw"), "SELECT ciclo, anio, cvegeo, CAST(day AS INT) AS day, round(share, 6) AS share FROM sw_c"))
def fraction_curve(spark, sf_dir):
    state = P.cycle_state(progress(spark, sf_dir))
    return rounded(P.fraction_curve(map_series(spark, sf_dir), "sembrada", state, ("ciclo", "anio", "cvegeo")), ())


@query("curve_day_p50", with_cte(CTE_MAP + _curve_cte("cosechada", "hv"), "SELECT ciclo, anio, cvegeo, round(day, 6) AS day FROM hv_d"))
def curve_day_p50(spark, sf_dir):
    keys = ("ciclo", "anio", "cvegeo")
    state = P.cycle_state(progress(spark, sf_dir))
    return rounded(P.curve_day(P.fraction_curve(map_series(spark, sf_dir), "cosechada", state, keys), 0.5, keys), ())


CTE_SUMMARY = CTE_MAP + _curve_cte("sembrada", "sw") + _curve_cte("cosechada", "hv") + """,
summ AS (SELECT ciclo, anio, cvegeo, l.fecha, sembrada, cosechada, siniestrada, produccion,
  CASE WHEN cosechada > 0 THEN produccion / cosechada END AS rendimiento,
  CASE WHEN sembrada > 0 THEN 100 * siniestrada / sembrada END AS pct_siniestrada,
  s.a0 + CAST(round_even(s.day, 0) AS INT) AS p50_siembra, h.a0 + CAST(round_even(h.day, 0) AS INT) AS p50_cosecha
  FROM lastv l LEFT JOIN sw_d s USING (ciclo, anio, cvegeo) LEFT JOIN hv_d h USING (ciclo, anio, cvegeo))"""
SUMMARY_SELECT = """SELECT ciclo, anio, cvegeo, CAST(fecha AS VARCHAR) AS fecha, sembrada, cosechada, siniestrada, produccion,
 round(rendimiento, 6) AS rendimiento, round(pct_siniestrada, 6) AS pct_siniestrada, CAST(p50_siembra AS VARCHAR) AS p50_siembra,
 CAST(p50_cosecha AS VARCHAR) AS p50_cosecha FROM summ"""


def summary(spark, sf_dir):
    return P.progress_summary(progress(spark, sf_dir), *SEL)


@query("progress_summary", with_cte(CTE_SUMMARY, SUMMARY_SELECT))
def progress_summary(spark, sf_dir):
    return rounded(summary(spark, sf_dir), ())


@query("snk_summary_csv", with_cte(CTE_SUMMARY, SUMMARY_SELECT))
def snk_summary_csv(spark, sf_dir):
    """The summary exported as delimited text and read back."""
    path = scratch_path(spark, "summary")
    out = rounded(summary(spark, sf_dir), ())
    SRC.write_text(out, path)
    return spark.read.csv(path, header=True, schema=out.schema, escape='"')


@query("choropleth_join", with_cte(CTE_SUMMARY, """
SELECT y.ciclo, y.anio, m.cvegeo, m.municipio, s.pct_siniestrada IS NULL AS sin_dato, CAST(month(p50_siembra) AS INT) AS mes,
  m.municipio || coalesce(' / ' || day(p50_siembra) || '-' || month(p50_siembra), '') AS etiqueta, round(sembrada, 6) AS valor
FROM {municipality} m JOIN (SELECT DISTINCT ciclo, anio FROM summ) y ON TRUE LEFT JOIN summ s ON s.cvegeo = m.cvegeo AND s.ciclo = y.ciclo AND s.anio = y.anio""").replace(
    "s.pct_siniestrada IS NULL AS sin_dato", "CAST(s.cvegeo IS NULL AS INT) AS sin_dato"))
def choropleth_join(spark, sf_dir):
    return M.choropleth(view(spark, sf_dir, "municipality"), summary(spark, sf_dir), "sembrada", "p50_siembra")


@query("classes_quantile", with_cte(CTE_SUMMARY + """,
br AS (SELECT ciclo, anio, quantile_cont(sembrada, [0.2, 0.4, 0.6, 0.8]) AS b FROM summ GROUP BY 1, 2)""", """
SELECT ciclo, anio, cvegeo, CAST(1 + len(list_filter(b, lambda x: x < sembrada)) AS INT) AS class FROM summ JOIN br USING (ciclo, anio)"""))
def classes_quantile(spark, sf_dir):
    return M.quantile_classes(summary(spark, sf_dir), ("ciclo", "anio"), "sembrada", 5).select("ciclo", "anio", "cvegeo", "class")


@query("official_sown", oracle("""
SELECT ciclo, anio, cvegeo, modalidad, cultivo, arg_max(sembrada, fecha) AS sembrada, CAST(max(fecha) AS VARCHAR) AS fecha FROM {crop_progress} p GROUP BY 1, 2, 3, 4, 5"""))
def official_sown(spark, sf_dir):
    return rounded(P.official_sown(progress(spark, sf_dir)), ())


# ------------------------------------------------------------------ raw reports
@query("request_plan", with_cte("""y AS (SELECT DISTINCT anio FROM {crop_progress} p),
pl AS (SELECT anio - 1 AS a, 'OI' AS c, unnest(range(10, 13)) AS m FROM y UNION SELECT anio, 'OI', unnest(range(1, 13)) FROM y
  UNION SELECT anio, 'PV', unnest(range(4, 13)) FROM y UNION SELECT anio + 1, 'PV', unnest(range(1, 4)) FROM y)""", """
SELECT CAST(a AS INT) AS anio_consulta, c AS ciclo, CAST(m AS INT) AS mes, modalidad, cultivo FROM pl,
 (VALUES ('riego'), ('temporal')) AS r(modalidad), (VALUES ('sorgo'), ('maiz')) AS k(cultivo) WHERE make_date(a, m, 1) <= DATE '1998-03-15'"""))
def request_plan(spark, sf_dir):
    return R.request_plan(progress(spark, sf_dir).select("anio").distinct(), F.lit("1998-03-15").cast("date"))


def raw_reports(spark, sf_dir):
    """One response text per (year, cycle, regime, crop, cut); a block lists its municipalities."""
    p = progress(spark, sf_dir)
    months = F.element_at(F.array(*[F.lit(m) for m in T.MONTHS]), F.month("fecha"))
    day = F.concat(F.day("fecha").cast("string"), F.lit(" de "), months, F.lit(" de "), F.year("fecha").cast("string"))
    num = lambda c: F.concat(F.lit('<td class="tdNum">'), F.format_number(c, 2), F.lit("</td>"))
    line = F.concat(F.lit("<tr><td>1</td><td>Tamaulipas</td><td> "), F.col("municipio"), F.lit("<!-- x --> &amp; Cía</td>"),
                    num("sembrada"), num("cosechada"), num("siniestrada"), num("produccion"), F.lit('<td class="tdNum">n/d</td></tr>'))
    label = lambda c, m: R._label(F.col(c), m)
    title = F.concat(F.lit("<!-- a\nb -->" + R.BLOCK + "Año agrícola: "), F.col("anio").cast("string"), F.lit(" Ciclo: "),
                     label("ciclo", R.CYCLES), F.lit(" Modalidad:\n"), label("modalidad", R.REGIMES), F.lit(" Cultivo: "), F.col("cultivo"),
                     F.lit(" Entidad: <b>Tamaulipas</b> Situación al "), day, F.lit("</div><table><tr><th>#</th></tr>"))
    # a block holds the state's municipalities, one row each
    texts = p.groupBy("anio", "ciclo", "modalidad", "cultivo", "fecha").agg(
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines")).withColumn("title", title)
    asked = F.when(F.col("cultivo") == "Sorgo grano", "sorgo").otherwise("maiz")
    name = F.concat(F.col("anio").cast("string"), F.lit("_"), F.col("ciclo"), F.lit("_"), F.col("modalidad"), F.lit("_"), asked,
                    F.lit("_mes"), F.lpad(F.month("fecha").cast("string"), 2, "0"), F.lit(".xml"))
    empty = F.concat(F.lit(R.BLOCK + "Año agrícola: 1900 Ciclo: Perennes Modalidad: Riego Cultivo: "), F.col("cultivo"), F.lit(" Entidad: x</div>"))
    return R.with_request(texts.select(name.alias("file_name"), F.concat(
        F.lit("<xjx><![CDATA["), "title", "lines", F.lit("</table>"), empty, F.lit("]]></xjx>")).alias("value")))


CTE_REPORT = """p AS (SELECT *, CASE WHEN cultivo = 'Sorgo grano' THEN 'Sorgo grano' ELSE 'Maíz grano' END AS asked,
  CASE WHEN ciclo = 'OI' THEN 'Otoño - Invierno' ELSE 'Primavera - Verano' END AS clab,
  CASE WHEN modalidad = 'riego' THEN 'Riego' ELSE 'Temporal' END AS mlab FROM {crop_progress} p),
full_rows AS (SELECT anio AS anio_consulta, CAST(anio AS VARCHAR) AS anio_agricola, clab AS ciclo, mlab AS modalidad, asked AS cultivo,
  CAST(month(fecha) AS INT) AS mes_consulta, CAST(fecha AS VARCHAR) AS fecha_corte, 'Tamaulipas' AS entidad, '' AS distrito,
  municipio || ' & Cía' AS municipio, sembrada AS sembrada_ha, cosechada AS cosechada_ha, siniestrada AS siniestrada_ha, produccion,
  CASE WHEN cultivo = 'Otro' THEN 'cultivo recibido: Otro' ELSE '' END AS aviso FROM p),
empties AS (SELECT DISTINCT anio AS anio_consulta, '1900' AS anio_agricola, clab, mlab, asked, cultivo, CAST(month(fecha) AS INT) AS m,
  concat_ws('; ', 'ciclo recibido: Perennes', CASE WHEN mlab <> 'Riego' THEN 'modalidad recibida: Riego' END,
   CASE WHEN cultivo = 'Otro' THEN 'cultivo recibido: Otro' END, 'sin datos') AS aviso, fecha FROM p)"""
REPORT_SELECT = """SELECT * FROM full_rows UNION ALL
SELECT anio_consulta, anio_agricola, clab, mlab, asked, m, '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, aviso FROM empties"""


@query("src_raw_reports", with_cte(CTE_REPORT, REPORT_SELECT))
def src_raw_reports(spark, sf_dir):
    """Responses saved one file each, in a folder per run, beside files of other names; read back whole and turned into rows."""
    path = scratch_path(spark, "reports")
    raw = raw_reports(spark, sf_dir).select("file_name", "value")
    # two crops that are asked for by one name come from two runs
    other = F.col("value").contains("Cultivo: Otro")
    for run, part in (("first", raw.filter(~other)), ("second", raw.filter(other))):
        R.write_raw(part, f"{path}/{run}")
        R.write_raw(part.limit(1).withColumn("file_name", F.concat(F.lit("copia de "), "file_name")), f"{path}/{run}")
    return R.report_rows(R.read_raw(spark, f"{path}/*")).drop("rendimiento")


@query("report_parse", with_cte(CTE_REPORT, """
SELECT anio_consulta, fecha_corte, ciclo, modalidad, cultivo, municipio, sembrada_ha, cosechada_ha, CAST(NULL AS DOUBLE) AS rendimiento
FROM full_rows WHERE aviso = ''"""))
def report_parse(spark, sf_dir):
    rows = R.report_rows(raw_reports(spark, sf_dir)).filter("aviso = ''")
    return rows.select("anio_consulta", "fecha_corte", "ciclo", "modalidad", "cultivo", "municipio", "sembrada_ha", "cosechada_ha", "rendimiento")


@query("report_check", with_cte(CTE_REPORT, f"SELECT aviso, count(*) AS n FROM ({REPORT_SELECT}) GROUP BY 1"))
def report_check(spark, sf_dir):
    return R.report_rows(raw_reports(spark, sf_dir)).groupBy("aviso").agg(F.count(F.lit(1)).alias("n"))


@query("report_text", oracle("""
SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM (
 SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]+>', ' ', 'gs'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'),
  '[\\s\\x{{00A0}}]+', ' ', 'g')) AS t FROM {pages})"""))
def report_text(spark, sf_dir):
    from surco.sources.adapters import table
    t = T.strip_markup(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select(
        "page_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))
