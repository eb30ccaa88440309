"""Views over the driver tables in the shapes the operators expect.

Each view is one SELECT that Spark and DuckDB both read. ``{name}`` stands for a
driver table or another view. Values are multiples of small powers of two where the
operators compare floats, so both engines agree bit for bit.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
}

VIEWS: dict[str, str] = {}

# --- satellite observations: one row per (sensor, pixel, date, tile) -------------------
VIEWS["obs_dn"] = """
SELECT sensor, px_id, obs_date, tile_ord, 'T' || CAST(tile_ord % 3 AS STRING) AS tile, mask,
  2048 + 16 * f AS dn_nir, 2048 - 16 * f AS dn_red, 1024 + 4 * f AS dn_green,
  1024 - 4 * f AS dn_swir1, CASE WHEN k % 11 = 0 THEN 0 ELSE 512 END AS dn_swir2,
  CASE WHEN sensor = 'S2' THEN 2048 + 8 * f END AS dn_nir8a,
  CASE WHEN sensor = 'S2' THEN 1024 + 2 * f END AS dn_re1,
  CASE WHEN sensor = 'S2' THEN 1536 + f END AS dn_re3
FROM (SELECT
    CASE WHEN event_type IN ('error','signup') THEN 'LANDSAT' ELSE 'S2' END AS sensor,
    user_id AS px_id, CAST(ts AS DATE) AS obs_date, event_id AS tile_ord, k, f,
    CASE WHEN event_type IN ('error','signup')
      THEN CASE k % 6 WHEN 0 THEN 21832 WHEN 1 THEN 1 ELSE 21824 END
      ELSE CASE k % 6 WHEN 0 THEN 9 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE 5 END END AS mask
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    CAST(greatest(0, 60 - 4 * abs(day(ts) - 1 - (12 + user_id % 7))) + event_id % 4 AS INT) AS f
    FROM {events}) e) o
"""

# --- official crop progress: cumulative per municipality, regime, crop, cycle, year, cut -
VIEWS["crop_progress"] = """
SELECT cvegeo, municipio,
  CASE ls WHEN 'O' THEN 'riego' ELSE 'temporal' END AS modalidad, ciclo, anio,
  CASE rf WHEN 'A' THEN 'Maíz grano' WHEN 'N' THEN 'Sorgo grano' ELSE 'Otro' END AS cultivo,
  fecha, sembrada,
  coalesce(lag(sembrada, 2) OVER (PARTITION BY cvegeo, ls, rf, ciclo, anio ORDER BY fecha), 0) AS cosechada,
  siniestrada, 3 * sembrada AS produccion, CAST(year(fecha) AS INT) AS anio_consulta
FROM (SELECT *,
    sum(q) OVER (PARTITION BY cvegeo, ls, rf, ciclo, anio ORDER BY fecha
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sembrada,
    sum(lost) OVER (PARTITION BY cvegeo, ls, rf, ciclo, anio ORDER BY fecha
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS siniestrada
  FROM (SELECT CAST(28001 + s.s_nationkey AS STRING) AS cvegeo, 'Río ' || n.n_name AS municipio,
      l.l_linestatus AS ls, l.l_returnflag AS rf,
      CASE WHEN month(l.l_shipdate) BETWEEN 4 AND 9 THEN 'PV' ELSE 'OI' END AS ciclo,
      CAST(CASE WHEN month(l.l_shipdate) >= 10 THEN year(l.l_shipdate) + 1
        ELSE year(l.l_shipdate) END AS INT) AS anio,
      last_day(CAST(l.l_shipdate AS DATE)) AS fecha, sum(l.l_quantity) AS q,
      sum(CASE WHEN l.l_discount > 8e-2 THEN l.l_quantity ELSE 0e0 END) AS lost
    FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
      JOIN {nation} n ON s.s_nationkey = n.n_nationkey
    GROUP BY 1, 2, 3, 4, 5, 6, 7) m) c
"""

# the same facts as the text of an export, with the defects a reader meets
VIEWS["progress_text"] = """
SELECT CASE WHEN anio % 2 = 0 THEN CAST(anio AS STRING) || '.0' ELSE CAST(anio AS STRING) END AS anio_agricola,
  CASE WHEN ciclo = 'OI' THEN 'Otoño - Invierno' WHEN month(fecha) = 4 AND cultivo = 'Otro' THEN 'Perennes'
    ELSE 'Primavera - Verano' END AS ciclo,
  CASE WHEN modalidad = 'riego' THEN ' Riego' ELSE 'Temporal ' END AS modalidad,
  ' ' || cultivo AS cultivo,
  CASE WHEN month(fecha) = 5 THEN CAST(fecha AS STRING) || 'T00:00:00' ELSE CAST(fecha AS STRING) END AS fecha_corte,
  CASE WHEN anio % 3 = 0 THEN upper(municipio) || '  ' WHEN cvegeo = '28003' THEN 'Villa Inventada'
    WHEN cvegeo = '28005' THEN 'Río  Nation_4' ELSE municipio END AS municipio,
  CASE WHEN month(fecha) = 7 AND modalidad = 'riego' AND cultivo = 'Otro' THEN 'n/d'
    WHEN month(fecha) = 10 AND cultivo = 'Otro' THEN '' ELSE CAST(CAST(sembrada AS BIGINT) AS STRING) END AS sembrada_ha,
  CASE WHEN cosechada = 0 THEN '' ELSE CAST(CAST(cosechada AS BIGINT) AS STRING) || '.5' END AS cosechada_ha,
  CAST(CAST(siniestrada AS BIGINT) AS STRING) AS siniestrada_ha,
  CAST(CAST(produccion AS BIGINT) AS STRING) AS produccion,
  CASE WHEN month(fecha) = 2 AND cultivo = 'Otro' THEN 'sin datos' ELSE '' END AS aviso,
  CAST(anio_consulta AS STRING) AS anio_consulta
FROM {crop_progress} p
"""

VIEWS["municipality"] = """
SELECT CAST(28001 + n_nationkey AS STRING) AS cvegeo, 'Rio ' || n_name AS municipio FROM {nation}
"""

# --- labelled samples -------------------------------------------------------------------
VIEWS["samples"] = """
SELECT CAST(label * 10 + vec_id % 5 AS STRING) AS grupo,
  CASE WHEN label < 3 THEN 'maiz' WHEN label < 6 THEN 'sorgo' ELSE 'otros' END AS clase,
  vec_id AS px_id, CAST(floor(vec_id / 40) AS INT) AS fila, CAST(vec_id % 40 AS INT) AS col,
  CAST(element_at(embedding, 1) AS DOUBLE) AS e1,
  CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(element_at(embedding, 2) AS DOUBLE) END AS e2,
  CAST(element_at(embedding, 3) AS DOUBLE) AS e3, CAST(element_at(embedding, 4) AS DOUBLE) AS e4,
  CAST(element_at(embedding, 5) AS DOUBLE) AS e5, CAST(element_at(embedding, 6) AS DOUBLE) AS e6,
  CAST(element_at(embedding, 7) AS DOUBLE) AS e7, CAST(element_at(embedding, 8) AS DOUBLE) AS e8
FROM {embeddings}
"""

# --- class map on a 40-column grid of 20 m pixels ----------------------------------------
VIEWS["class_map"] = """
SELECT c_custkey AS px_id, CAST(floor(c_custkey / 40) AS INT) AS fila, CAST(c_custkey % 40 AS INT) AS col,
  CAST(c_custkey % 40 AS INT) * 20e0 + 10e0 AS x, CAST(floor(c_custkey / 40) AS INT) * 20e0 + 10e0 AS y,
  CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_nationkey % 3 + 1 END AS INT) AS clase,
  CAST(c_nationkey % 5 AS INT) AS scl,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal / 16) AS DOUBLE) / 64 END AS valor
FROM {customer}
"""

# --- polygons: vertices in ring order; zones cover the class-map grid ---------------------
VIEWS["grid_height"] = """
SELECT 20e0 * (floor(max(c_custkey) / 40) + 1) AS hh FROM {customer}
"""

VIEWS["zone_vertex"] = """
SELECT zone_id, zone_name, 0 AS ring_id, v_ord,
  CAST(160 * bc + 160 * CASE v_ord WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 WHEN 2 THEN 1e0 WHEN 3 THEN 5e-1 ELSE 0e0 END AS DOUBLE) AS x,
  CAST(hh * br + hh * CASE v_ord WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 WHEN 2 THEN 1e0 WHEN 3 THEN 625e-3 ELSE 1e0 END AS DOUBLE) AS y
FROM (SELECT CAST(28001 + n_nationkey AS INT) AS zone_id, 'Rio ' || n_name AS zone_name, n_nationkey % 5 AS bc,
    floor(n_nationkey / 5) AS br, (SELECT hh / 5 FROM {grid_height} g) AS hh,
    explode(array(0, 1, 2, 3, 4)) AS v_ord FROM {nation}) z
"""

VIEWS["district_vertex"] = """
SELECT zone_id, zone_name, 0 AS ring_id, v_ord,
  CAST(160 * rk - 30 + 190 * CASE v_ord WHEN 0 THEN 5e-1 WHEN 1 THEN 1e0 WHEN 2 THEN 5e-1 ELSE 0e0 END AS DOUBLE) AS x,
  CAST(hh * CASE v_ord WHEN 0 THEN 1e-1 WHEN 1 THEN 5e-1 WHEN 2 THEN 9e-1 ELSE 5e-1 END AS DOUBLE) AS y
FROM (SELECT CAST(100 - 7 * r_regionkey AS INT) AS zone_id, r_name AS zone_name, r_regionkey AS rk,
    (SELECT hh FROM {grid_height} g) AS hh, explode(array(0, 1, 2, 3)) AS v_ord FROM {region}) z
"""

# labelled fields: polygons and points (kind) with a free-text label
VIEWS["field_vertex"] = """
SELECT field_ord, grupo, kind, etiqueta, 0 AS ring_id, v_ord,
  CAST((field_ord * 47) % 760 + w * CASE v_ord WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 WHEN 2 THEN 875e-3 ELSE 125e-3 END AS DOUBLE) AS x,
  CAST((field_ord * 131) % hh + w * CASE v_ord WHEN 0 THEN 125e-3 WHEN 1 THEN 0e0 WHEN 2 THEN 1e0 ELSE 875e-3 END AS DOUBLE) AS y
FROM (SELECT s_suppkey AS field_ord, 'F' || CAST(s_suppkey AS STRING) AS grupo,
    CASE WHEN s_suppkey % 5 = 0 THEN 'point' ELSE 'polygon' END AS kind,
    CASE WHEN s_suppkey % 9 = 4 THEN 16e0 ELSE 90e0 END AS w,
    CASE s_nationkey % 7 WHEN 0 THEN 'Maíz' WHEN 1 THEN 'maize' WHEN 2 THEN 'Sorgo grano' WHEN 3 THEN 'sorghum'
      WHEN 4 THEN 'Field corn' WHEN 5 THEN 'soya' ELSE 'arroz' END AS etiqueta,
    (SELECT CAST(hh AS BIGINT) FROM {grid_height} g) AS hh, explode(array(0, 1, 2, 3)) AS v_ord FROM {supplier}) f
WHERE kind = 'polygon' OR v_ord = 0
"""

# --- calendars: one cycle per customer, some with one of the defects a validator must name -
VIEWS["calendars"] = """
SELECT profile, cycle, stage_ord, k,
  CASE WHEN k % 17 = 0 AND stage_ord = 1 THEN 'a b' WHEN k % 19 = 0 AND stage_ord = 2 THEN 'etapa_1'
    ELSE 'etapa_' || CAST(stage_ord AS STRING) END AS stage,
  substr(CAST(d0 AS STRING), 6, 5) AS start_mmdd,
  CASE WHEN k % 23 = 0 AND stage_ord = 0 THEN '02-30' WHEN k % 29 = 0 AND stage_ord = 3 THEN substr(CAST(d0 + (-1) AS STRING), 6, 5)
    ELSE substr(CAST(d1 AS STRING), 6, 5) END AS end_mmdd,
  CASE WHEN k % 4 = 0 THEN NULL WHEN stage_ord % 3 = 0 THEN 'siap' ELSE 'estimada' END AS origin
FROM (SELECT profile, cycle, k, stage_ord,
    DATE '2001-01-01' + CAST((k * 37) % 365 + stage_ord * 40 - CASE WHEN k % 13 = 0 AND stage_ord = 2 THEN 6 ELSE 0 END AS INT) AS d0,
    DATE '2001-01-01' + CAST((k * 37) % 365 + stage_ord * 40 + 34 + k % 6 AS INT) AS d1
  FROM (SELECT 'P' || CAST(c_custkey AS STRING) AS profile, CASE WHEN c_nationkey % 2 = 0 THEN 'OI' ELSE 'PV' END AS cycle,
      c_custkey AS k, explode(array(0, 1, 2, 3)) AS stage_ord FROM {customer}) a) b
"""

# crop windows and offsets of the same profiles; empty text means no window
VIEWS["crop_windows"] = """
SELECT profile, cycle, k, crop, kind,
  CASE WHEN k % 7 = 0 AND kind = 'maximo' THEN '' WHEN k % 31 = 0 THEN '13-01' ELSE substr(CAST(d0 AS STRING), 6, 5) END AS from_mmdd,
  CASE WHEN k % 7 = 0 AND kind = 'maximo' AND k % 2 = 0 THEN '' ELSE substr(CAST(d0 + CAST(20 + k % 40 AS INT) AS STRING), 6, 5) END AS to_mmdd,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 30 AS INT) END AS days_min,
  CASE WHEN k % 22 = 0 THEN NULL WHEN k % 15 = 0 THEN -5 ELSE CAST(k % 30 + 15 AS INT) END AS days_max
FROM (SELECT *, CASE WHEN i < 2 THEN 'maiz' WHEN k % 37 = 0 THEN 'trigo' ELSE 'sorgo' END AS crop,
    CASE WHEN i % 2 = 0 THEN 'arranque' ELSE 'maximo' END AS kind,
    DATE '2001-01-01' + CAST((k * 37 + 25 * i) % 365 AS INT) AS d0
  FROM (SELECT 'P' || CAST(c_custkey AS STRING) AS profile, CASE WHEN c_nationkey % 2 = 0 THEN 'OI' ELSE 'PV' END AS cycle,
      c_custkey AS k, explode(array(0, 1, 2, 3)) AS i FROM {customer}) a) b
"""

# --- scenes: what each order's catalogue item must come out as --------------------------
VIEWS["scene_facts"] = """
SELECT *, CASE WHEN sensor = 'LANDSAT' THEN 'LC09_L2SP_' || CASE WHEN l = 4 THEN 'x' ELSE path || '042' END || '_' || ymd || '_02_' || CAST(k AS STRING)
    WHEN l = 3 THEN 'S2A_MSIL2A_' || ymd || 'T170901_N0511_T' || square || '_' || CAST(k AS STRING)
    WHEN l = 4 THEN 'S2A_' || square || '_' || ymd || '_0_' || CAST(k AS STRING)
    ELSE 'S2A_MSIL2A_' || ymd || 'T170901_R069_' || CAST(k AS STRING) END AS id
FROM (SELECT o_orderkey AS k, o_orderkey % 5 AS l, o_orderkey % 4 AS src, CASE WHEN o_orderkey % 4 < 2 THEN 'S2' ELSE 'LANDSAT' END AS sensor,
    CASE o_orderkey % 4 WHEN 0 THEN 'es-s2' WHEN 1 THEN 'pc-s2' WHEN 2 THEN 'pc-ls' ELSE 'es-ls' END AS source,
    CASE WHEN o_orderkey % 4 >= 2 THEN 'landsat-' || CAST(7 + o_orderkey % 3 AS STRING) WHEN o_orderkey % 8 < 4 THEN 'sentinel-2a' ELSE 'Sentinel-2B' END AS platform,
    '14R' || substr('ABCDEFGHJKLMNPQRSTUVWXYZ', CAST(o_orderkey % 24 + 1 AS INT), 1) || substr('PQRSTU', CAST(o_orderkey % 6 + 1 AS INT), 1) AS square,
    lpad(CAST(o_orderkey % 97 AS STRING), 3, '0') AS path,
    substr(CAST(o_orderdate AS STRING), 1, 10) AS day, replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') AS ymd,
    CAST(o_orderdate AS DATE) AS obs_date, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) % 100 AS DOUBLE) END AS cloud,
    (o_orderkey % 10) / 10e0 - 985e-1 AS x0, 245e-1 + (o_orderkey % 4) / 4e0 AS y0 FROM {orders}) o
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(text: str) -> list[str]:
    return sorted({field for _, field, _, _ in string.Formatter().parse(text) if field})


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run ``text`` with every ``{name}`` bound to a driver table or a view."""
    frames = {n: table(spark, sf_dir, n) if n in TABLES else view(spark, sf_dir, n) for n in _names(text)}
    return spark.sql(text, **frames)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, VIEWS[name])


def oracle(text: str) -> str:
    """The same text as one self-contained query for the oracle engine."""
    parts = {n: n if n in TABLES else f"({oracle(VIEWS[n])})" for n in _names(text)}
    text = text.format(**parts)
    for spark_name, oracle_name in (("element_at(", "list_extract("), ("explode(array(", "unnest(list_value(")):
        text = text.replace(spark_name, oracle_name)
    return text
