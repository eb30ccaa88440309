"""Known values: dates, codes, distances and curves whose right answer is stated or computed by brute force."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surco.functions import bands as B
from surco.functions import text as T
from surco.operators import calendar as CAL
from surco.operators import classify as CL
from surco.operators import curve as C
from surco.operators import maps as M
from surco.operators import progress as P
from surco.operators import ranks as R
from surco.operators import raster as RS
from surco.operators import separability as SEP
from surco.operators import zones as Z
from surco.sources import catalogue as CT
from surco.sources import progress as SRC
from surco.sources import reports as REP

D = dt.date


# ---------------------------------------------------------------- calendar
def windows(spark, cycles, year):
    rows = CAL.windows(CAL.calendar_table(spark, cycles).withColumn("year", F.lit(year)))
    return {(r.cycle, r.stage): (r.start_date, r.end_date) for r in rows.collect()}


def test_default_calendar(spark):
    w = windows(spark, CAL.DEFAULT_CALENDAR, 2026)
    assert w["OI", "00_siembra_emergencia"][0] == D(2026, 1, 15) and w["OI", "03_madurez_senescencia"][1] == D(2026, 7, 15)
    assert CAL.violations(CAL.calendar_table(spark)).isEmpty()


def test_cycle_crossing_new_year(spark):
    cycle = {"X": [("a", "11-01", "12-15"), ("b", "12-16", "01-31"), ("c", "02-01", "03-31")]}
    w = windows(spark, cycle, 2025)
    assert w["X", "b"] == (D(2025, 12, 16), D(2026, 1, 31)) and w["X", "c"][0] == D(2026, 2, 1)


@pytest.mark.parametrize("day, stage", [("2026-04-20", "02_floracion_espigamiento"), ("2026-02-28", "00_siembra_emergencia"), ("2026-08-01", "fuera_de_etapa")])
def test_stage_of_a_day(spark, day, stage):
    w = CAL.windows(CAL.calendar_table(spark, {"OI": CAL.DEFAULT_CALENDAR["OI"]}).withColumn("year", F.lit(2026)))
    assert CAL.stage_assign(spark.sql(f"SELECT DATE '{day}' AS d"), w, "d").first().stage == stage


@pytest.mark.parametrize("stages, problem", [
    ([("a", "01-01", "02-10"), ("b", "02-05", "03-01")], "overlap"), ([("a b", "01-01", "02-10")], "stage name"),
    ([("a", "02-30", "03-01")], "bad date"), ([("a", "01-01", "02-01"), ("a", "03-01", "04-01")], "repeated stage name"),
    ([("a", "02-29", "03-01")], "bad date"), ([("fuera_de_etapa", "02-01", "03-01")], "stage name")])
def test_invalid_calendars(spark, stages, problem):
    assert problem in {r.problem for r in CAL.violations(CAL.calendar_table(spark, {"X": stages})).collect()}


def test_reference_days(spark):
    refs = spark.sql("""SELECT * FROM VALUES ('OI', 'maiz', 'arranque', '02-20', '03-31'), ('OI', 'maiz', 'maximo', '', ''),
      ('OI', 'sorgo', 'maximo', '03-01', '04-15'), ('X', 'maiz', 'arranque', '12-15', '01-15') AS t(cycle, crop, kind, from_mmdd, to_mmdd)""")
    starts = spark.sql("SELECT * FROM VALUES ('OI', 2026, '01-15', DATE '2026-01-15'), ('X', 2025, '11-01', DATE '2025-11-01') AS t(cycle, year, first_mmdd, first_day)")
    got = {(r.cycle, r.crop, r.kind): (r.d0, r.d1) for r in CAL.reference_days(refs, starts, ["cycle"]).collect()}
    assert got == {("OI", "maiz", "arranque"): (36, 75), ("OI", "sorgo", "maximo"): (45, 90), ("X", "maiz", "arranque"): (44, 75)}


def test_official_year_and_inverse(spark):
    def both(cycles, official):
        cal = CAL.calendar_table(spark, cycles)
        wanted = spark.sql(f"SELECT 'OI' AS cycle, {official} AS official")
        return CAL.cycle_year(cal, wanted).first().cycle_year
    assert both(CAL.DEFAULT_CALENDAR, 2025) == 2025
    october = {"OI": [("00_siembra_emergencia", "10-15", "12-31"), ("01_vegetativo", "01-01", "02-15"), ("03_madurez_senescencia", "04-01", "06-15")]}
    assert both(october, 2025) == 2024


# ---------------------------------------------------------------- the curve
RAMP = ((0, 0.15), (24, 0.15), (72, 0.87), (96, 0.87), (144, 0.15), (168, 0.15))  # day, value; straight in between


def ramp(day, shift=0):
    return float(np.interp(day - shift, *zip(*RAMP)))


@pytest.fixture(scope="module")
def curves(spark):
    shapes = {
        10: lambda d: ramp(d),
        11: lambda d: 0.02 if d == 60 else ramp(d),  # one cloud that was missed
        12: lambda d: None if d % 12 == 8 else ramp(d),  # every third date is missing
        13: lambda d: ramp(d) if d in (40, 80) else None,
        14: lambda d: ramp(d, 20),  # sown later
    }
    rows = [("S2", px, day, f(day)) for px, f in shapes.items() for day in range(0, 193, 4)]
    df = spark.createDataFrame(rows, "sensor string, px_id bigint, day int, NDVI double")
    return {r.px_id: r for r in C.curve_metrics(df).collect()}


def test_curve_of_straight_ramps(curves):
    half_up, half_down, climb = 48, 120, 0.72 / 48  # by hand from RAMP; the grid step is 5 days
    plain = curves[10]
    assert abs(plain.DIAsube50 - half_up) <= 5 and abs(plain.DIAbaja50 - half_down) <= 5
    assert 0.8 <= plain.NDVImax <= 0.88 and 72 - 5 <= plain.DIAmax <= 96 + 5
    assert plain.DIASsubemax == plain.DIAmax - plain.DIAsube50
    assert abs(plain.VELsube - climb) < 0.25 * climb and plain.VELbaja > 0
    assert abs(curves[11].DIAsube50 - plain.DIAsube50) <= 5 and abs(curves[11].NDVImax - plain.NDVImax) < 0.02
    assert abs(curves[12].DIAsube50 - half_up) <= 10 and abs(curves[12].DIAbaja50 - half_down) <= 10
    assert 13 not in curves
    assert abs(curves[14].DIAsube50 - plain.DIAsube50 - 20) <= 5 and abs(curves[14].VELsube - plain.VELsube) < 0.1 * climb


def test_coherence_codes(spark):
    refs = {"maiz": {"arranque": (5, 20), "maximo": (50, 70)}, "sorgo": {"arranque": (15, 30), "maximo": None}}
    # both crops, maize by rise and peak, sorghum by its rise twice, neither, rise unknown, no curve
    curves = [(18, 60, 3), (10, 60, 1), (25, 40, 2), (18, 80, 2), (2, 60, 4), (None, 60, 5), (None, None, 0)]
    df = spark.createDataFrame(curves, "rise int, peak int, want int")
    assert df.filter(C.coherence_code(F.col("rise"), F.col("peak"), refs) != F.col("want")).count() == 0


# ---------------------------------------------------------------- progress
def rows(spark, cuts, cvegeo="28001", anio=2025):
    data = [(cvegeo, "x", "riego", "OI", anio, "Sorgo grano", d, float(s), float(c)) for d, s, c in cuts]
    return spark.createDataFrame(data, "cvegeo string, municipio string, modalidad string, ciclo string, anio int, cultivo string, fecha date, sembrada double, cosechada double")


def test_dates_between_cuts(spark):
    # another municipality reports a month earlier, so this one is zero there; the season's first month, October, is in no report
    early = rows(spark, [(D(2017, 11, 30), 3, 0)], "28040", 2018)
    own = rows(spark, [(D(2017, 12, 31), 8, 0), (D(2018, 1, 31), 40, 0), (D(2018, 2, 28), 80, 0), (D(2018, 5, 31), 80, 40), (D(2018, 6, 30), 80, 80)], "28033", 2018)
    series = P.series_profile(early.unionByName(own)).filter("cvegeo = '28033'")
    points = [(r.fecha, r.sembrada) for r in series.orderBy("fecha").collect()]
    assert points[:3] == [(D(2017, 11, 30), 0.0), (D(2017, 12, 31), 8.0), (D(2018, 1, 31), 40.0)]
    d = P.cycle_dates(series).first()
    # 8 of 80 on the cut itself; 72 is 0.8 of the way through the 28 days of February: 22.4 days; half of the harvest on a cut
    assert (d.S10, d.S90, d.H50) == (D(2017, 12, 31), D(2018, 2, 22), D(2018, 5, 31))
    assert not any("cierr" in w for w in d.warnings)


def test_missing_start_and_closing_jump(spark):
    d = P.cycle_dates(P.series_profile(rows(spark, [(D(2025, 1, 31), 20, 0), (D(2025, 2, 28), 100, 0)], anio=2023))).first()
    assert d.S10 is None and any("arranque" in w for w in d.warnings) and any("cierre administrativo" in w for w in d.warnings)
    assert "sin cosecha registrada" in d.warnings


def test_stages_split_a_short_cycle(spark):
    df = spark.sql("SELECT DATE '2001-01-01' AS S10, DATE '2001-02-01' AS S90, DATE '2001-02-20' AS H50, DATE '2001-04-01' AS H90")
    s = P.stages_from_dates(df).first().stages
    assert [(x["from"], x["to"]) for x in s] == [(D(2001, 1, 1), D(2001, 2, 14)), (D(2001, 2, 15), D(2001, 2, 15)), (D(2001, 2, 16), D(2001, 2, 15)), (D(2001, 2, 16), D(2001, 4, 1))]


def test_names_of_an_export(spark):
    raw = spark.createDataFrame([("2018.0", "Primavera - Verano", " Temporal", "Maíz grano", "2018-09-30", m, v, "", "") for m, v in (("XICOTÉNCATL", "7.5"), ("xicotencatl", "2"), ("Pueblo Ninguno", "1"))],
                                "anio_agricola string, ciclo string, modalidad string, cultivo string, fecha_corte string, municipio string, sembrada_ha string, cosechada_ha string, aviso string")
    names = spark.createDataFrame([("28041", "Xicoténcatl"), ("28003", "Altamira")], "cvegeo string, municipio string")
    got = SRC.typed_rows(raw, names).collect()
    assert sorted((r.cvegeo, r.anio, r.ciclo, r.modalidad, r.sembrada, r.cosechada) for r in got) == [("28041", 2018, "PV", "temporal", 2.0, 0.0), ("28041", 2018, "PV", "temporal", 7.5, 0.0)]
    assert [r.municipio for r in SRC.unmatched_names(raw, names).collect()] == ["Pueblo Ninguno"]


def test_text_files_begin_with_a_mark(spark, tmp_path):
    SRC.write_text(spark.createDataFrame([("ñandú", 1.5)], "nombre string, valor double").coalesce(1), f"{tmp_path}/out")
    raw = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfnombre,valor")
    assert SRC.read_text(spark, f"{tmp_path}/out").collect()[0].asDict() == {"nombre": "ñandú", "valor": "1.5"}


def test_empty_export_is_an_error(spark):
    with pytest.raises(ValueError):
        SRC.require_rows(spark.range(0))


def test_request_plan(spark):
    plan = REP.request_plan(spark.sql("SELECT 2019 AS anio"), F.lit(D(2019, 12, 15)))
    got = {(r.anio_consulta, r.ciclo, r.mes) for r in plan.collect()}
    winter = {(2018, "OI", m) for m in (10, 11, 12)} | {(2019, "OI", m) for m in range(1, 13)}
    assert got == winter | {(2019, "PV", m) for m in range(4, 13)}  # January to March of 2020 are still to come
    assert plan.count() == 24 * 2 * 2


def test_raw_responses_one_file_each(spark, tmp_path):
    files = spark.createDataFrame([(f"2019_OI_riego_maiz_mes{m:02d}.xml", f"<x>línea\n{m}</x>") for m in range(1, 13)] + [("notes.xml", "other")], "file_name string, value string").repartition(3)
    assert REP.write_raw(files, str(tmp_path / "raw")) == 13
    back = REP.read_raw(spark, str(tmp_path / "raw")).collect()
    assert {(r.mes_consulta, r.value) for r in back} == {(m, f"<x>línea\n{m}</x>") for m in range(1, 13)}
    assert {(r.anio_consulta, r.ciclo_pedido, r.modalidad_pedida, r.cultivo_pedido) for r in back} == {(2019, "OI", "riego", "maiz")}


def test_report_of_another_crop_than_asked(spark):
    page = ('<x><![CDATA[<p>aviso</p><div class="titulosTabla">Año agrícola: 2019 Ciclo: Primavera - Verano Modalidad: Temporal Cultivo: Maíz grano '
            'Entidad: Veracruz Situación al 31 de octubre de 2019</div><table>'
            '<tr><td>7</td><td>Veracruz</td><td>&Aacute;lamo &amp; Tihuatl&aacute;n</td>'
            + "".join(f'<td class="tdNum">{v}</td>' for v in ("87.25", "2,000", "n/d", "0", "3.5")) + "</tr></table>]]></x>")
    files = spark.createDataFrame([("2019_PV_temporal_sorgo_mes10.xml", page), ("notes.md", page)], "file_name string, value string")
    row, = REP.report_rows(REP.with_request(files)).collect()
    assert (row.municipio, row.fecha_corte, row.sembrada_ha) == ("Álamo & Tihuatlán", "2019-10-31", 87.25)
    assert row.aviso.startswith("cultivo recibido: Ma")


def test_character_references(spark):
    df = spark.createDataFrame([("&lt;b&gt; &amp;amp; &#233;&#xE9; &ntilde; &nope; a&b &#128512;",)], "t string")
    assert df.select(T.unescape(F.col("t"))).first()[0] == "<b> &amp; éé ñ &nope; a&b 😀"


def test_month_order(spark):
    rows_ = spark.sql("SELECT explode(sequence(1, 12)) AS m").select("m", M.month_order(F.col("m"), F.lit("OI")).alias("o")).orderBy("o").collect()
    assert [r.m for r in rows_][:4] == [10, 11, 12, 1]


# ---------------------------------------------------------------- catalogue
def test_scene_facts_from_one_page(spark):
    scene = {"id": "S2B_13QGB_20210704_0_L2A", "geometry": None, "assets": {"B03": {"href": "https://host/green.tif"}, "SCL": {"href": "https://host/classes.tif"}},
             "properties": {"datetime": "2021-07-04T17:31:09Z", "eo:cloud_cover": 41.0, "platform": "Sentinel-2B", "grid:code": "MGRS-13QGB", "s2:processing_baseline": "04.00"}}
    page = json.dumps({"features": [scene]})
    s = CT.scenes(CT.parse_pages(spark.createDataFrame([(4, "pc-s2", page)], "page int, source string, value string"))).first()
    band = {b.band: (b.scale, b.offset) for b in s.bands}
    assert (s.tile, s.date, s.footprint) == ("13QGB", "2021-07-04", None)
    assert band["B03"] == (1e-4, -0.1) and band["SCL"] == (1.0, 0.0) and "B12" in s.missing


def test_masks(spark):
    df = spark.createDataFrame([("LANDSAT", m) for m in (21824, 21832, 21826, 21840, 1, 0)] + [("S2", m) for m in (4, 6, 9, 0)], "sensor string, mask int")
    got = [(r.a, r.b, r.c) for r in df.select(*[f(F.col("sensor"), F.col("mask")).alias(n) for f, n in (
        (B.clear_for_screening, "a"), (B.clear_for_variables, "b"), (B.has_data, "c"))]).collect()]
    t, f = True, False
    assert got == [(t, t, t), (f, f, t), (f, f, t), (f, f, t), (f, f, f), (t, f, t), (t, t, t), (t, f, t), (f, f, t), (f, f, f)]


# ---------------------------------------------------------------- distributed ranks
def test_bucket_never_decreases(spark):
    rng = random.Random(1)
    values = sorted([rng.uniform(-5, 5) * 10 ** rng.randint(-8, 8) for _ in range(3000)] + [0.0] + [s * 2.0 ** e * (1 + d) for s in (1, -1) for e in range(-30, 30) for d in (0, 1e-15, -1e-16)])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", R.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(a.b <= b.b for a, b in zip(got, got[1:]))


def test_quantiles_on_a_hot_group(spark):
    rng = np.random.default_rng(3)
    data = {"hot": np.concatenate([rng.normal(0, 1, 4000), np.full(2500, 0.25)]), "b": rng.exponential(3, 301), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: r for r in R.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p05": 0.005, "p90": 0.9}).collect()}
    for k, vs in data.items():
        for name, q in (("p50", 50), ("p05", 0.5), ("p90", 90)):
            assert math.isclose(got[k][name], np.percentile(vs, q), rel_tol=1e-12, abs_tol=1e-12)


def test_first_n_is_exact(spark):
    df = spark.range(5000).select("id", (F.col("id") < 4000).alias("g"))
    got = R.first_n(df, ["g"], [F.desc("id")], 30, 4).collect()
    assert sorted(r.id for r in got if r.g) == list(range(3970, 4000)) and sum(not r.g for r in got) == 30


# ---------------------------------------------------------------- separability
def frame(spark, X, y, g=None):
    names = [f"v{i}" for i in range(X.shape[1])]
    data = [(i, str(g[i]) if g is not None else str(i), y[i], *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(len(y))]
    return spark.createDataFrame(data, "px_id bigint, grupo string, clase string, " + ", ".join(f"{n} double" for n in names)), names


def test_distance_and_threshold(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(2, 1, 1500), rng.normal(0, 1, 1500)
    df, names = frame(spark, np.concatenate([a, b])[:, None], ["maiz"] * 1500 + ["sorgo"] * 1500)
    g = SEP.two_groups(df, names, comparisons=("ms",))
    assert abs(SEP.jm_distance(g).first().jm - 2 * (1 - math.exp(-0.5))) < 0.06
    t = SEP.best_threshold(g).first()
    assert t.dir == ">" and 0.5 < t.thr < 1.5 and t.bal_acc > 0.8
    v, lab = np.concatenate([a, b]), np.array([1] * 1500 + [0] * 1500)
    brute = max(((v[lab == 1] > c).mean() + (v[lab == 0] <= c).mean()) / 2 for c in v)
    assert math.isclose(t.bal_acc, brute, rel_tol=1e-12)


def brute_jm(A, B_, ridge=1e-6):
    m, p = A.mean(0) - B_.mean(0), A.shape[1]
    s1, s2 = np.cov(A, rowvar=False).reshape(p, p), np.cov(B_, rowvar=False).reshape(p, p)
    scale = np.mean(np.diag(s1) + np.diag(s2)) / 2
    s1, s2 = s1 + np.eye(p) * ridge * scale, s2 + np.eye(p) * ridge * scale
    s = (s1 + s2) / 2
    return 2 * (1 - np.exp(-(m @ np.linalg.inv(s) @ m / 8 + 0.5 * np.log(np.linalg.det(s) / np.sqrt(np.linalg.det(s1) * np.linalg.det(s2))))))


def test_forward_selection_against_brute_force(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(0, 1, (400, 5))
    X[:200] += np.array([0.9, 0.5, 0.7, 0.0, 0.3])
    X[:, 2] = X[:, 0] + rng.normal(0, 0.01, 400)  # a near copy of v0
    X[::17, 1] = np.nan
    df, names = frame(spark, X, ["maiz"] * 200 + ["sorgo"] * 200)
    got = SEP.forward_selection(df, "ms", names, 3)
    chosen = []
    for _ in range(3):
        best = None
        for j in range(5):
            if j in chosen:
                continue
            cols = chosen + [j]
            ok = ~np.isnan(X[:, cols]).any(1)
            if chosen and max(abs(np.corrcoef(X[ok][:, j], X[ok][:, c])[0, 1]) for c in chosen) > 0.95:
                continue
            jm = brute_jm(X[:200][ok[:200]][:, cols], X[200:][ok[200:]][:, cols])
            if best is None or jm > best[1]:
                best = (j, jm)
        chosen.append(best[0])
        assert got[len(chosen) - 1][0] == f"v{best[0]}" and math.isclose(got[len(chosen) - 1][1], best[1], rel_tol=1e-6)
    assert not {"v0", "v2"} <= {v for v, _ in got}


# ---------------------------------------------------------------- folds, votes, maps
def test_folds_keep_fields_whole(spark):
    y = ["maiz"] * 60 + ["sorgo"] * 60 + ["otros"] * 60
    df, _ = frame(spark, np.zeros((180, 1)), y, [f"f{i // 10}" for i in range(180)])
    folds, k, warn = CL.group_folds(df, 5)
    j = df.join(folds, "grupo").select("fold", "clase", "grupo").distinct().collect()
    assert k == 5 and not warn and len(folds.collect()) == 18
    assert all({r.clase for r in j if r.fold == f} == {"maiz", "sorgo", "otros"} for f in range(5))
    few = df.filter("px_id < 140")
    assert CL.group_folds(few, 5)[1] == 2 and CL.group_folds(few, 5)[2]
    assert CL.group_folds(df.filter("px_id < 130"), 5)[0] is None


def test_forest_learns_and_importance_ranks(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(0, 1, (600, 4))
    y = np.where(X[:, 0] > 0.6, "otros", np.where(X[:, 1] > 0, "maiz", "sorgo"))
    df, names = frame(spark, X, list(y), [f"f{i % 60}" for i in range(600)])
    preds, imp = CL.cross_validate(df, names, "hierarchical", 2, trees=15, importance=True, depth=8)
    rows_ = preds.collect()
    assert len(rows_) == 600 and sum(r.pred == r.clase for r in rows_) / 600 > 0.85
    by = {r["var"]: r for r in imp.collect()}
    assert by["v0"].step1 == max(r.step1 for r in by.values()) and by["v1"].step2 == max(r.step2 for r in by.values())


def test_one_crop_only(spark):
    df, names = frame(spark, np.array([[0.0], [0.1], [5.0], [5.1]] * 5), ["maiz", "maiz", "otros", "otros"] * 5)
    m = CL.fit_final(df, names, "hierarchical", trees=5, depth=4)
    p = m.probabilities(CL.assemble(df, names)).select("clase", CL.predicted(F.col("p")).alias("pred")).collect()
    assert m.second is None and all(r.pred == r.clase for r in p)


def test_majority(spark):
    cells = [(i, j, 0 if i == 0 else 2 if (i, j) == (2, 2) else 1) for i in range(5) for j in range(5)]
    got = {(r.fila, r.col): r.clase for r in RS.majority3x3(spark.createDataFrame(cells, "fila int, col int, clase int")).collect()}
    assert got[2, 2] == 1 and all(got[0, j] == 0 for j in range(5)) and len(got) == 25


def test_polygons_against_brute_force(spark):
    rng = np.random.default_rng(9)
    polys = {z: rng.uniform(0, 400, (7, 2)) for z in range(6)}  # self-crossing on purpose: even-odd rule
    vertices = spark.createDataFrame([(z, 0, i, float(x), float(y)) for z, p in polys.items() for i, (x, y) in enumerate(p)], "zone_id int, ring_id int, v_ord int, x double, y double")
    pixels = [(r * 150 + c, r, c) for r in range(40) for c in range(150)]
    got = {(r.px_id, r.zone_id) for r in Z.point_in_polygon(spark.createDataFrame(pixels, "px_id int, fila int, col int"), Z.edges(vertices), 10.0).collect()}
    want = set()
    for px, r, c in pixels:
        x, y = (c + 0.5) * 10, (r + 0.5) * 10
        for z, p in polys.items():
            q = np.roll(p, -1, axis=0)
            hits = sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(p, q))
            if hits % 2:
                want.add((px, z))
    assert got == want


@pytest.mark.parametrize("kind", ["star", "rectangle"])
def test_near_edges_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    ring = rng.uniform(0, 300, (6, 2)) if kind == "star" else np.array([[20.0, 30.0], [280.0, 30.0], [280.0, 250.0], [20.0, 250.0]])
    vertices = spark.createDataFrame([(1, 0, i, float(x), float(y)) for i, (x, y) in enumerate(ring)], "zone_id int, ring_id int, v_ord int, x double, y double")
    pts = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-20, 320, (1500, 2)))]
    got = {r.px_id for r in Z.near_edges(spark.createDataFrame(pts, "zone_id int, px_id int, x double, y double"), Z.edges(vertices), 12.0, "zone_id").collect()}

    def dist(x, y):
        best = 1e9
        for a, b in zip(ring, np.roll(ring, -1, axis=0)):
            t = max(0.0, min(1.0, np.dot([x - a[0], y - a[1]], b - a) / np.dot(b - a, b - a)))
            best = min(best, math.hypot(x - a[0] - t * (b - a)[0], y - a[1] - t * (b - a)[1]))
        return best

    assert got == {i for _, i, x, y in pts if dist(x, y) < 12.0}


def test_class_mapping_keeps_every_label(spark):
    from surco.operators import samples as SM

    labels = spark.createDataFrame([(f"campo {k}",) for k in range(300)] * 2, "etiqueta string")
    assert SM.class_mapping(labels).count() == 300


def test_numbers_without_type_suffixes(spark):
    from surco.functions.text import number

    df = spark.createDataFrame([("1,234.50",), ("1d",), ("5f",), ("-3",), ("",), ("1e3",)], "t string")
    assert [r[0] for r in df.select(number(F.col("t"))).collect()] == [1234.5, None, None, -3.0, None, 1000.0]


def test_merge_takes_the_last_row_of_a_part(spark):
    from surco.sources.progress import merge_last_wins

    part = spark.range(1000).select(F.lit("k").alias("key"), F.col("id").alias("line"), (2 * F.col("id")).alias("v")).repartition(8)
    assert merge_last_wins([part], "line", ("key",)).first()["v"] == 1998
    earlier = part.withColumn("line", F.col("line") + 5000)
    assert merge_last_wins([earlier, part], "line", ("key",)).first()["line"] == 999


def test_permutation_is_one_cycle_whatever_the_parts(spark, monkeypatch):
    from surco.operators import classify as CL

    held = spark.range(200).select(F.col("id").alias("px_id"), F.lit("maiz").alias("clase"), F.col("id").cast("double").alias("a"), (F.col("id") * 10.0).alias("b"))
    once = sorted(map(tuple, CL.permuted(held, ["a", "b"], 3).collect()))
    monkeypatch.setattr(CL, "SORT_ROWS", 17)
    assert sorted(map(tuple, CL.permuted(held, ["a", "b"], 3).collect())) == once
    moved = {r[0]: int(r[3]) for r in once if r[2] == "a"}
    at, seen = 0, set()
    while at not in seen:
        seen.add(at)
        at = moved[at]
    assert len(seen) == 200 and all(r[4] == r[0] * 10.0 for r in once if r[2] == "a")


def test_unknown_footprints_pass_the_box(spark):
    from surco.operators import scenes as S

    df = spark.createDataFrame([("a", None), ("b", [[(0.0, 0.0), (1.0, 1.0)]]), ("c", [[(8.0, 8.0), (9.0, 9.0)]])], "id string, footprint array<array<struct<x:double,y:double>>>")
    df = df.selectExpr("*", "'S2' AS sensor", "null AS platform", "1.0D AS cloud_tile", "'2020' AS date")
    assert {r["id"] for r in S.search(df, (0, 0, 2, 2)).collect()} == {"a", "b"}


def test_full_table_keeps_the_last_line(spark, tmp_path):
    head = "cvegeo,municipio,anio_agricola,ciclo,modalidad,cultivo,fecha_corte,sembrada_ha,cosechada_ha,siniestrada_ha,produccion,anio_consulta,aviso\n"
    line = "28001,M,2025,Otoño - Invierno,Riego,Sorgo grano,2025-02-28,{},0,0,0,2025,\n"
    for name, amounts in (("a.csv", (1, 2)), ("b.csv", range(3, 900))):
        (tmp_path / name).write_text(head + "".join(line.format(v) for v in amounts), encoding="utf-8")
    got = SRC.read_full(spark, str(tmp_path)).collect()
    assert [r["sembrada"] for r in got] == [899.0]


def test_free_names_skip_taken_numbers(spark):
    from surco.sources.profiles import free_names

    stored = spark.createDataFrame([("n",), ("n_3",), ("n_4",), ("m_2",)], "profile string")
    incoming = spark.createDataFrame([(k, name) for k, name in enumerate(["n", "n", "n", "m", "m", "new", "n"])], "import_ord int, profile string")
    got = {r["import_ord"]: r["profile"] for r in free_names(incoming, stored).collect()}
    assert got == {0: "n_2", 1: "n_5", 2: "n_6", 3: "m", 4: "m_3", 5: "new", 6: "n_7"}


def test_footprints_of_several_polygons(spark):
    from surco.operators import scenes as S

    def square(x, y, side):
        return [[[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]]

    def scene(name, kind, coordinates):
        return {"id": name, "geometry": {"type": kind, "coordinates": coordinates}, "assets": {},
                "properties": {"datetime": "2022-05-01T17:00:00Z", "eo:cloud_cover": 1.0, "platform": "Sentinel-2A", "s2:mgrs_tile": name, "s2:datatake_id": "GS2A_20220501T170000_1_N04"}}

    page = json.dumps({"features": [scene("AA", "MultiPolygon", [square(50, 50, 5), square(0, 0, 10)]), scene("BB", "MultiPolygon", [square(0, 0, 3), square(6, 6, 9)]),
                                    scene("CC", "Polygon", square(-5, -5, 30)), scene("DD", "Point", [1, 1])]})
    found = CT.scenes(CT.parse_pages(spark.createDataFrame([(1, "pc-s2", page)], "page int, source string, value string"))).cache()
    assert {r["id"] for r in S.search(found, (51, 51, 52, 52)).collect()} == {"AA", "DD"}
    area = [(2, 2), (7, 2), (7, 7), (2, 7)]
    whole = {r["id"]: r["whole"] for r in S.holds_area(found, area).collect()}
    assert whole == {"AA": True, "BB": False, "CC": True, "DD": False}
    assert {(r["id"], r["kept_tile"]) for r in S.duplicates(found, area).collect()} == {("BB", "AA"), ("CC", "AA"), ("DD", "AA")}


@pytest.mark.parametrize("name", ["rf_flat", "rf_hierarchical", "predict_map"])
def test_registered_forests_are_full(spark, sf_dir, monkeypatch, name):
    from surco.operators import classify
    from surco.plans import model_queries  # noqa: F401
    from surco.plans.registry import REGISTRY

    grown = []
    forest = classify._forest
    monkeypatch.setattr(classify, "_forest", lambda trees, seed, depth: grown.append((trees, depth)) or forest(2, seed, 2))
    REGISTRY[name].run(spark, sf_dir)
    assert set(grown) == {(200, 25)}
