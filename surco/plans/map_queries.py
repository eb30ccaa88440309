"""Queries over the pixel grid: polygons, zones, class maps, areas, comparison with official figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from surco.functions import text as T
from surco.operators import progress as P
from surco.operators import raster as RS
from surco.operators import samples as SM
from surco.operators import zones as Z
from surco.plans.curve_queries import rounded, with_cte
from surco.plans.registry import query
from surco.session import scratch_path
from surco.sources.adapters import oracle, view

RES = 20.0
PX_KM2, PX_HA = 400 / 1e6, 400 / 1e4


def class_map(spark, sf_dir):
    return view(spark, sf_dir, "class_map")


def municipality_edges(spark, sf_dir):
    return Z.edges(view(spark, sf_dir, "zone_vertex"))


def zoned(spark, sf_dir):
    return Z.pixel_zones(class_map(spark, sf_dir), municipality_edges(spark, sf_dir), Z.edges(view(spark, sf_dir, "district_vertex")), RES)


def edge_cte(name, source, key="zone_id"):
    return f"""{name} AS (SELECT {key}, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM {source} v WINDOW w AS (PARTITION BY {key}, ring_id ORDER BY v_ord))"""


def parity_cte(name, edges_, key="zone_id"):
    """Brute force: every pixel against every edge."""
    return f"""{name} AS (SELECT px_id, e.{key} FROM px, {edges_} e WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


CTE_ZONES = "px AS (SELECT * FROM {class_map} c), " + ", ".join([
    edge_cte("me", "{zone_vertex}"), edge_cte("de", "{district_vertex}"), parity_cte("inm", "me"), parity_cte("ind", "de")]) + """,
dc AS (SELECT zone_id, CAST(row_number() OVER (ORDER BY zone_id) AS INT) AS code FROM (SELECT DISTINCT zone_id FROM de)),
pz AS (SELECT px.*, coalesce(m.z, 0) AS mun, coalesce(d.z, 0) AS district FROM px
  LEFT JOIN (SELECT px_id, max(zone_id) AS z FROM inm GROUP BY 1) m USING (px_id)
  LEFT JOIN (SELECT px_id, max(code) AS z FROM ind JOIN dc USING (zone_id) GROUP BY 1) d USING (px_id))"""


@query("point_in_polygon", with_cte(CTE_ZONES, "SELECT px_id, zone_id FROM ind"))
def point_in_polygon(spark, sf_dir):
    return Z.point_in_polygon(class_map(spark, sf_dir), Z.edges(view(spark, sf_dir, "district_vertex")), RES).select("px_id", "zone_id")


@query("pixel_zones", with_cte(CTE_ZONES, "SELECT px_id, mun, district FROM pz"))
def pixel_zones(spark, sf_dir):
    return zoned(spark, sf_dir).select("px_id", "mun", "district")


@query("zone_counts", with_cte(CTE_ZONES, """SELECT 'municipio' AS layer, mun AS code, count(*) AS pixels FROM pz WHERE mun <> 0 GROUP BY 1, 2
UNION ALL SELECT 'distrito', district, count(*) FROM pz WHERE district <> 0 GROUP BY 1, 2"""))
def zone_counts(spark, sf_dir):
    return Z.zone_counts(zoned(spark, sf_dir))


def area_pixels(spark, sf_dir):
    """Study areas of five grid rows each."""
    return zoned(spark, sf_dir).withColumn("area_id", F.floor(F.col("fila") / 5).cast("int"))


CTE_SHARES = CTE_ZONES + """,
ap AS (SELECT *, CAST(floor(fila / 5) AS INT) AS area_id FROM pz),
tot AS (SELECT area_id, count(*) AS n, count(*) FILTER (WHERE district > 0) / CAST(count(*) AS DOUBLE) AS dr, count(*) FILTER (WHERE mun = 0) / CAST(count(*) AS DOUBLE) AS o FROM ap GROUP BY 1),
sh AS (SELECT area_id, mun, count(*) / CAST(any_value(n) AS DOUBLE) AS share, any_value(dr) AS dr, any_value(o) AS o FROM ap JOIN tot USING (area_id) WHERE mun <> 0 GROUP BY 1, 2)"""


@query("zone_shares", with_cte(CTE_SHARES, "SELECT area_id, mun, round(share, 6) AS share, round(dr, 6) AS district_share, round(o, 6) AS outside FROM sh"))
def zone_shares(spark, sf_dir):
    return rounded(Z.zone_shares(area_pixels(spark, sf_dir)), ())


@query("shares_topk", with_cte(CTE_SHARES, """SELECT area_id, mun, round(share, 6) AS share, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY area_id ORDER BY share DESC, mun) AS INT) AS rk FROM sh) WHERE rk <= 4"""))
def shares_topk(spark, sf_dir):
    """The four largest municipalities of each study area."""
    w = Window.partitionBy("area_id").orderBy(F.desc("share"), "mun")
    top = Z.zone_shares(area_pixels(spark, sf_dir)).withColumn("rk", F.row_number().over(w)).filter("rk <= 4")
    return rounded(top.select("area_id", "mun", "share", "rk"), ())


@query("suggest_profile", with_cte(CTE_SHARES + """,
b AS (SELECT area_id, arg_max(mun, share * 1e6 - mun / 1e6) AS mun, count(*) FILTER (WHERE share >= 0.1e0) AS large FROM sh GROUP BY 1),
j AS (SELECT t.area_id, lpad(CAST(mun AS VARCHAR), 5, '0') AS cvegeo, CASE WHEN mun IS NULL THEN NULL WHEN dr >= 0.5e0 THEN 'riego' ELSE 'temporal' END AS modalidad,
  dr, o, large, mun FROM tot t LEFT JOIN b USING (area_id)),
k AS (SELECT j.*, CASE WHEN mun % 3 <> 0 THEN 'siap_' || cvegeo || '_' || modalidad END AS profile FROM j)""", """
SELECT area_id, cvegeo, modalidad, profile, CASE WHEN mun IS NULL THEN 'fuera de Tamaulipas' ELSE concat_ws(' | ',
 CASE WHEN large > 1 THEN 'la zona pilla varios municipios' END,
 CASE WHEN dr > 0.2e0 AND dr < 0.8e0 THEN 'la zona mezcla distrito de riego (' || CAST(round_even(100 * dr, 0) AS INT) || ' %) y fuera' END,
 CASE WHEN o > 0.05e0 THEN CAST(round_even(100 * o, 0) AS INT) || ' % de la zona cae fuera de Tamaulipas' END,
 CASE WHEN profile IS NULL THEN 'no hay perfil del SIAP para ' || coalesce(municipio, cvegeo) || ' (' || modalidad || ')' END) END AS warnings FROM k LEFT JOIN {municipality} mn USING (cvegeo)"""))
def suggest_profile(spark, sf_dir):
    munis = view(spark, sf_dir, "municipality").filter(F.col("cvegeo").cast("int") % 3 != 0)
    profiles = munis.select("cvegeo", F.explode(F.array(F.lit("riego"), F.lit("temporal"))).alias("modalidad")).withColumn(
        "profile", F.concat_ws("_", F.lit("siap"), "cvegeo", "modalidad"))
    s = Z.suggest_profile(area_pixels(spark, sf_dir), profiles, view(spark, sf_dir, "municipality"))
    return s.select("area_id", "cvegeo", "modalidad", "profile", F.array_join("warnings", " | ").alias("warnings"))


# ------------------------------------------------------------------ class map
@query("majority3x3", oracle("""
WITH m AS (SELECT fila, col, clase FROM {class_map} c),
v AS (SELECT a.fila, a.col, b.clase, count(*) AS n, bool_or(a.fila = b.fila AND a.col = b.col) AS own FROM m a
  JOIN m b ON abs(a.fila - b.fila) <= 1 AND abs(a.col - b.col) <= 1 WHERE a.clase <> 0 AND b.clase <> 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fila, col ORDER BY n DESC, own DESC, clase) AS i FROM v)
SELECT fila, col, clase FROM r WHERE i = 1 UNION ALL SELECT fila, col, clase FROM m WHERE clase = 0"""))
def majority3x3(spark, sf_dir):
    return RS.majority3x3(class_map(spark, sf_dir))


@query("class_areas", oracle("""
SELECT CASE clase WHEN 0 THEN 'nodata' WHEN 1 THEN 'maiz' WHEN 2 THEN 'sorgo' ELSE 'otros' END AS clase, count(*) AS pixels,
 CASE WHEN any_value(c.clase) <> 0 THEN round(count(*) * 4e-4, 6) END AS km2 FROM {class_map} c GROUP BY c.clase"""))
def class_areas(spark, sf_dir):
    return rounded(RS.class_areas(class_map(spark, sf_dir), PX_KM2), ())


@query("rule_map", oracle("""
SELECT px_id, CASE WHEN valor IS NOT NULL THEN CAST(valor > 5e0 AS INT) END AS rule,
 (SELECT round(count(*) * 4e-4, 6) FROM {class_map} d WHERE valor > 5e0) AS km2 FROM {class_map} c"""))
def rule_map(spark, sf_dir):
    ruled = RS.rule_map(class_map(spark, sf_dir), "valor", 5.0, ">")
    area = RS.rule_area(ruled, PX_KM2)
    return ruled.select("px_id", "rule", F.round(area.scalar(), 6).alias("km2"))


@query("regrid", oracle("""
WITH m AS (SELECT fila, col, scl, valor FROM {class_map} c),
md AS (SELECT fila // 2 AS fila, col // 2 AS col, scl, count(*) AS n FROM m GROUP BY 1, 2, 3),
mm AS (SELECT fila, col, scl FROM (SELECT *, row_number() OVER (PARTITION BY fila, col ORDER BY n DESC, scl) AS i FROM md) WHERE i = 1),
av AS (SELECT fila // 2 AS fila, col // 2 AS col, avg(valor) AS valor FROM m GROUP BY 1, 2),
fine AS (SELECT m.fila * 2 + a.i AS fila, m.col * 2 + b.i AS col, m.fila AS f0, m.col AS c0, scl FROM m, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(i)),
nb AS (SELECT f.fila, f.col, f.scl, m.valor, (1 - abs((f.fila + 5e-1) / 2 - 5e-1 - m.fila)) * (1 - abs((f.col + 5e-1) / 2 - 5e-1 - m.col)) AS w
  FROM fine f JOIN m ON abs((f.fila + 5e-1) / 2 - 5e-1 - m.fila) < 1 AND abs((f.col + 5e-1) / 2 - 5e-1 - m.col) < 1)
SELECT 'coarse' AS grid, CAST(fila AS INT) AS fila, CAST(col AS INT) AS col, round(valor, 6) + 0e0 AS valor, scl FROM av JOIN mm USING (fila, col)
UNION ALL SELECT 'fine', CAST(fila AS INT), CAST(col AS INT), round(sum(w * valor) / nullif(sum(CASE WHEN valor IS NOT NULL THEN w END), 0), 6) + 0e0, any_value(scl) FROM nb GROUP BY fila, col"""))
def regrid(spark, sf_dir):
    m = class_map(spark, sf_dir)
    both = RS.coarsen(m, 2).withColumn("grid", F.lit("coarse")).unionByName(RS.refine(m, 2).withColumn("grid", F.lit("fine")))
    return rounded(both.select("grid", "fila", "col", "valor", "scl"), ())


def _new_centre(cell: str, shift: int) -> str:
    return f"(({cell} + 5e-1) * 20 + {shift}) / 30"


@query("regrid_any", oracle(f"""
WITH m AS (SELECT fila, col, scl, valor FROM {{class_map}} c),
t AS (SELECT DISTINCT CAST(floor((m.fila * 30e0 + 20) / 20) AS INT) + a.i AS f, CAST(floor((m.col * 30e0 - 10) / 20) AS INT) + b.i AS c
  FROM m, (VALUES (-2), (-1), (0), (1), (2)) AS a(i), (VALUES (-2), (-1), (0), (1), (2)) AS b(i)),
p AS (SELECT f, c, {_new_centre("f", -20)} AS y, {_new_centre("c", 10)} AS x FROM t),
i AS (SELECT p.*, m.scl FROM p JOIN m ON m.fila = CAST(floor(y) AS INT) AND m.col = CAST(floor(x) AS INT)),
n AS (SELECT i.f, i.c, i.scl, m.valor, (1 - abs(y - 5e-1 - m.fila)) * (1 - abs(x - 5e-1 - m.col)) AS w FROM i JOIN m
  ON m.fila BETWEEN CAST(floor(y) AS INT) - 1 AND CAST(floor(y) AS INT) + 1 AND m.col BETWEEN CAST(floor(x) AS INT) - 1 AND CAST(floor(x) AS INT) + 1
  WHERE abs(y - 5e-1 - m.fila) < 1 AND abs(x - 5e-1 - m.col) < 1)
SELECT f AS fila, c AS col, round(sum(w * valor) / nullif(sum(CASE WHEN valor IS NOT NULL THEN w END), 0), 6) + 0e0 AS valor, any_value(scl) AS scl FROM n GROUP BY 1, 2"""))
def regrid_any(spark, sf_dir):
    """From 30 m to 20 m, on a grid that begins 10 m to the right and 20 m above."""
    return rounded(RS.resample(class_map(spark, sf_dir), 30, 20, 10, -20).select("fila", "col", "valor", "scl"), ())


CTE_AREAS = CTE_ZONES + """,
mp AS (SELECT lpad(CAST(mun AS VARCHAR), 5, '0') AS cvegeo, CASE WHEN district > 0 THEN 'riego' ELSE 'temporal' END AS modalidad, clase FROM pz WHERE mun > 0 AND clase > 0),
ma AS (SELECT cvegeo, modalidad, count(*) FILTER (WHERE clase = 1) * 4e-2 AS maiz_ha, count(*) FILTER (WHERE clase = 2) * 4e-2 AS sorgo_ha,
  count(*) FILTER (WHERE clase = 3) * 4e-2 AS otros_ha, count(*) * 4e-2 AS covered_ha FROM mp GROUP BY 1, 2),
cv AS (SELECT cvegeo, sum(maiz_ha) AS maiz_ha, sum(sorgo_ha) AS sorgo_ha, sum(otros_ha) AS otros_ha, sum(covered_ha) AS covered_ha FROM ma GROUP BY 1)"""


@query("mapped_areas", with_cte(CTE_AREAS, """
SELECT cvegeo, modalidad, round(maiz_ha, 6) AS maiz_ha, round(sorgo_ha, 6) AS sorgo_ha, round(otros_ha, 6) AS otros_ha, round(covered_ha, 6) AS covered_ha, 0 AS is_total FROM ma
UNION ALL SELECT cvegeo, NULL, round(maiz_ha, 6), round(sorgo_ha, 6), round(otros_ha, 6), round(covered_ha, 6), 1 FROM cv"""))
def mapped_areas(spark, sf_dir):
    return rounded(RS.mapped_areas(zoned(spark, sf_dir), PX_HA), ())


@query("map_vs_official", with_cte(CTE_AREAS + """,
ar AS (SELECT lpad(CAST(zone_id AS VARCHAR), 5, '0') AS cvegeo, abs(sum(x1 * y2 - x2 * y1)) / 2 / 1e4 AS area_ha FROM me GROUP BY 1),
off AS (SELECT cvegeo, modalidad, cultivo, arg_max(sembrada, fecha) AS s, max(fecha) AS fecha FROM {crop_progress} p WHERE ciclo = 'OI' AND anio = 1995 GROUP BY 1, 2, 3),
o2 AS (SELECT cvegeo, modalidad, sum(s) FILTER (WHERE cultivo = 'Maíz grano') AS om, sum(s) FILTER (WHERE cultivo = 'Sorgo grano') AS os FROM off
  WHERE cultivo IN ('Maíz grano', 'Sorgo grano') GROUP BY 1, 2),
j AS (SELECT cvegeo, modalidad, round_even(coalesce(maiz_ha, 0), 1) AS mm, round_even(coalesce(sorgo_ha, 0), 1) AS ms, round_even(coalesce(om, 0), 1) AS sm,
  round_even(coalesce(os, 0), 1) AS ss FROM ma FULL JOIN o2 USING (cvegeo, modalidad)),
k AS (SELECT j.*, round_even(mm + ms, 1) AS mt, round_even(sm + ss, 1) AS st, coalesce(cv.covered_ha / area_ha, 0) AS share FROM j LEFT JOIN cv USING (cvegeo) LEFT JOIN ar USING (cvegeo))""", """
SELECT cvegeo, modalidad, (SELECT CAST(max(fecha) AS VARCHAR) FROM off) AS corte_siap, mm AS mapa_maiz_ha, sm AS siap_maiz_ha, ms AS mapa_sorgo_ha, ss AS siap_sorgo_ha,
 mt AS mapa_total_ha, st AS siap_total_ha, round_even(100 * share, 1) AS cobertura_pct, CASE WHEN st > 0 AND share >= 0.9e0 THEN round_even(mt / st, 3) END AS cociente FROM k"""))
def map_vs_official(spark, sf_dir):
    areas = RS.mapped_areas(zoned(spark, sf_dir), PX_HA)
    official = P.official_sown(view(spark, sf_dir, "crop_progress").filter("ciclo = 'OI' AND anio = 1995"))
    size = Z.polygon_area(municipality_edges(spark, sf_dir)).select(
        F.lpad(F.col("zone_id").cast("string"), 5, "0").alias("cvegeo"), (F.col("area_m2") / 1e4).alias("area_ha"))
    return rounded(RS.map_vs_official(areas, official, size, official.agg(F.max("fecha"))), ())


# ------------------------------------------------------------------ samples under fields
def mapping(spark, sf_dir):
    m = SM.class_mapping(view(spark, sf_dir, "field_vertex"))
    return m.withColumn("clase", F.when(F.col("value") == "arroz", "").otherwise(F.col("clase")))


def extracted(spark, sf_dir, cap=None):
    return SM.extract(class_map(spark, sf_dir), view(spark, sf_dir, "field_vertex"), mapping(spark, sf_dir), RES, 3.0, 15.0, cap, far_borders=True)


CTE_FIELDS = "px AS (SELECT * FROM {class_map} c), " + """
fv AS (SELECT * FROM (SELECT *, CASE WHEN etiqueta IN ('Maíz', 'maize', 'Field corn') THEN 'maiz' WHEN etiqueta IN ('Sorgo grano', 'sorghum') THEN 'sorgo'
  WHEN etiqueta = 'arroz' THEN '' ELSE 'otros' END AS cl FROM {field_vertex} f) WHERE cl <> ''),
pg AS (SELECT * FROM fv WHERE kind = 'polygon'), pt AS (SELECT * FROM fv WHERE kind = 'point'), """ + edge_cte("fe", "pg", "field_ord") + ", " + parity_cte("inside", "fe", "field_ord") + """,
dst AS (SELECT px.px_id, e.field_ord, min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))) AS d FROM inside i JOIN px USING (px_id)
  JOIN (SELECT * FROM fe) e USING (field_ord), LATERAL (SELECT greatest(0e0, least(1e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t) GROUP BY 1, 2),
hits AS (SELECT px_id, field_ord FROM dst WHERE d >= 3 UNION ALL
  SELECT px_id, field_ord FROM px, pt WHERE sqrt(pow(px.x - pt.x, 2) + pow(px.y - pt.y, 2)) <= 15),
tk AS (SELECT px_id, max(field_ord) AS field_ord FROM hits GROUP BY 1),
lf AS (SELECT DISTINCT field_ord FROM fv WHERE field_ord NOT IN (SELECT field_ord FROM tk)),
mid AS (SELECT field_ord, avg(x) AS mx, avg(y) AS my, floor(min(x) / 20) AS kx0, ceil(max(x) / 20) AS kx1, floor(min(y) / 20) AS ky0, ceil(max(y) / 20) AS ky1
  FROM pg WHERE field_ord IN (SELECT field_ord FROM lf) GROUP BY 1),
nm AS (SELECT field_ord, x1, y1, (y1 - y2) / l AS a, (x2 - x1) / l AS c FROM (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS l FROM fe)),
hp AS (SELECT *, a0 * s AS a, c0 * s AS c, (a0 * x1 + c0 * y1) * s + 3 AS d FROM (SELECT mid.*, x1, y1, a AS a0, c AS c0,
  CASE WHEN a * (mx - x1) + c * (my - y1) > 0 THEN 1e0 ELSE -1e0 END AS s FROM nm JOIN mid USING (field_ord))),
cr AS (SELECT field_ord, (g.d * h.c - h.d * g.c) / (g.a * h.c - h.a * g.c) AS x, (g.a * h.d - h.a * g.d) / (g.a * h.c - h.a * g.c) AS y
  FROM hp g JOIN hp h USING (field_ord) WHERE abs(g.a * h.c - h.a * g.c) > 1e-12),
cd AS (SELECT field_ord, x, y, floor(y / 20) AS fila, floor(x / 20) AS col FROM cr
  UNION ALL SELECT field_ord, k * 20e0, (d - a * k * 20) / c, floor((d - a * k * 20) / c / 20), k - o FROM (SELECT *, unnest(range(kx0::BIGINT, kx1::BIGINT + 1)) AS k FROM hp WHERE c <> 0), (VALUES (0), (1)) AS t(o)
  UNION ALL SELECT field_ord, (d - c * k * 20) / a, k * 20e0, k - o, floor((d - c * k * 20) / a / 20) FROM (SELECT *, unnest(range(ky0::BIGINT, ky1::BIGINT + 1)) AS k FROM hp WHERE a <> 0), (VALUES (0), (1)) AS t(o)),
tp AS (SELECT DISTINCT field_ord, fila, col FROM cd WHERE NOT EXISTS (SELECT 1 FROM hp WHERE hp.field_ord = cd.field_ord AND hp.a * cd.x + hp.c * cd.y < hp.d - 4e-7)),
td AS (SELECT field_ord, fila, col FROM (SELECT field_ord, x AS dx, y AS dy FROM pt WHERE field_ord IN (SELECT field_ord FROM lf)) JOIN px
  ON pow(dx - greatest(col * 20, least(dx, col * 20 + 20)), 2) + pow(dy - greatest(fila * 20, least(dy, fila * 20 + 20)), 2) <= 225),
ex AS (SELECT px_id, max(field_ord) AS field_ord FROM px JOIN (SELECT * FROM tp UNION ALL SELECT * FROM td) USING (fila, col) WHERE px_id NOT IN (SELECT px_id FROM tk) GROUP BY 1),
smp AS (SELECT px_id, fila, col, 'F' || field_ord AS grupo, cl AS clase FROM (SELECT * FROM tk UNION ALL SELECT * FROM ex) JOIN px USING (px_id)
  JOIN (SELECT DISTINCT field_ord, cl FROM fv) USING (field_ord))"""


@query("sample_extract", with_cte(CTE_FIELDS, "SELECT px_id, fila, col, grupo, clase FROM smp"))
def sample_extract(spark, sf_dir):
    return extracted(spark, sf_dir)


@query("sample_report", with_cte(CTE_FIELDS, """SELECT (SELECT count(DISTINCT field_ord) FROM {field_vertex} f) AS features,
 (SELECT count(DISTINCT field_ord) FROM {field_vertex} f WHERE etiqueta = 'arroz') AS ignored_class,
 (SELECT count(DISTINCT field_ord) FROM pg WHERE grupo NOT IN (SELECT grupo FROM smp) AND field_ord NOT IN (SELECT field_ord FROM tp)) AS empty_after_buffer,
 (SELECT count(DISTINCT field_ord) FROM fv WHERE grupo NOT IN (SELECT grupo FROM smp) AND (kind = 'point' OR field_ord IN (SELECT field_ord FROM tp))) AS outside"""))
def sample_report(spark, sf_dir):
    return SM.extract_report(view(spark, sf_dir, "field_vertex"), mapping(spark, sf_dir), extracted(spark, sf_dir), RES, 3.0, 15.0)


@query("sample_summary", with_cte(CTE_FIELDS, "SELECT clase, count(*) AS pixels, count(DISTINCT grupo) AS fields, CAST(count(DISTINCT grupo) < 10 AS INT) AS few_fields FROM smp GROUP BY 1"))
def sample_summary(spark, sf_dir):
    return SM.summary(extracted(spark, sf_dir))


@query("class_cap", with_cte(CTE_FIELDS, """SELECT px_id, fila, col, grupo, clase FROM
 (SELECT *, row_number() OVER (PARTITION BY clase ORDER BY md5(px_id || ':7'), px_id) AS i FROM smp) WHERE i <= 40"""))
def class_cap(spark, sf_dir):
    """At most 40 pixels of each class, chosen by a seeded hash."""
    return SM.cap(extracted(spark, sf_dir), ["clase"], 40, 7)


@query("class_guess", oracle("""
SELECT field_ord, etiqueta, CASE WHEN etiqueta IN ('Maíz', 'maize', 'Field corn') THEN 'maiz' WHEN etiqueta LIKE 'S%rg%' OR etiqueta LIKE 's%rg%' THEN 'sorgo' ELSE 'otros' END AS clase
FROM {field_vertex} f WHERE v_ord = 0"""))
def class_guess(spark, sf_dir):
    return view(spark, sf_dir, "field_vertex").filter("v_ord = 0").select("field_ord", "etiqueta", T.class_guess(F.col("etiqueta")).alias("clase"))


@query("class_mapping", oracle("""
SELECT DISTINCT etiqueta AS value, CASE WHEN etiqueta IN ('Maíz', 'maize', 'Field corn') THEN 'maiz' WHEN etiqueta IN ('Sorgo grano', 'sorghum') THEN 'sorgo' ELSE 'otros' END AS clase
FROM {field_vertex} f ORDER BY 1"""))
def class_mapping(spark, sf_dir):
    return SM.class_mapping(view(spark, sf_dir, "field_vertex"))


NAMES = [f"e{i}" for i in range(1, 9)]


def _samples_csv(spark, sf_dir):
    path = scratch_path(spark, "samples")
    SM.save_csv(view(spark, sf_dir, "samples").withColumns({"fila": F.when(F.col("col") != 3, F.col("fila"))}), NAMES, path)
    return path


@query("src_samples_csv", oracle("SELECT grupo, clase, CASE WHEN col = 3 THEN -1 ELSE fila END AS fila, col, " + ", ".join(
    f"round(CAST(printf('%.6g', {n}) AS DOUBLE), 9) AS {n}" for n in NAMES) + " FROM {samples} s"))
def src_samples_csv(spark, sf_dir):
    return rounded(SM.load_csv(spark, _samples_csv(spark, sf_dir), NAMES), (), 9)


@query("snk_samples_csv", oracle("SELECT count(*) AS n, count(DISTINCT grupo) AS groups, count(e1) AS e1, count(e2) AS e2, count(*) FILTER (WHERE col <> 3) AS fila FROM {samples} s"))
def snk_samples_csv(spark, sf_dir):
    """What the text file holds, read without the reader's rules."""
    raw = spark.read.csv(_samples_csv(spark, sf_dir), header=True)
    return raw.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("grupo").alias("groups"), F.count("e1").alias("e1"),
                   F.count("e2").alias("e2"), F.count("fila").alias("fila"))
