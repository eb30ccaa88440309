"""Queries over pixel observations: masks, merging, indices, the curve and its variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surco.functions import bands as B
from surco.operators import curve as C
from surco.operators import observations as O
from surco.operators import calendar as CAL
from surco.plans.registry import query
from surco.sources.adapters import oracle, sql, view

# The driver's observations span one month, so steps and windows are days, not weeks.
STEP = 2
SCALE = 1 / 4096  # of the view's numbers
WINDOWS = (("REL1_arranque", "DIAsube50", -3, 3), ("REL2_maximo", "DIAmax", -3, 3),
           ("REL3_postmax", "DIAmax", 4, 8), ("REL4_bajada", "DIAbaja50", -3, 3))
LANDSAT_EXTRA = 2
STAGES = {"OI": [("00_siembra_emergencia", "01-02", "01-08"), ("01_vegetativo", "01-09", "01-14"),
                 ("02_floracion_espigamiento", "01-15", "01-21"), ("03_madurez_senescencia", "01-23", "01-28")]}
REFS = {"maiz": {"arranque": (2, 9), "maximo": (11, 14)}, "sorgo": {"arranque": None, "maximo": (13, 17)}}
VARS = ("nir", "red", *B.INDICES)
DAY0 = "2024-01-01"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = O.to_reflectance(view(spark, sf_dir, "obs_dn"), scale=SCALE)
    return C.with_day(O.add_indices(O.tile_first_valid(tiles)), F.lit(DAY0).cast("date"))


def rounded(df: DataFrame, keys, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text: the form compared with the oracle."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        kind = f.dataType.typeName()
        if kind == "double" and f.name not in keys:
            c = F.round(c, digits) + F.lit(0.0)
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


ROLES = B.ROLES
CTE_CLEAR = """dn AS (SELECT * FROM {obs_dn} o),
cl AS (SELECT *, CASE WHEN sensor = 'S2' THEN mask IN (4, 5) ELSE (mask & 63) = 0 AND mask <> 0 END AS ok FROM dn),
refl AS (SELECT sensor, px_id, obs_date, tile_ord, """ + ", ".join(
    f"CASE WHEN ok AND dn_{r} <> 0 THEN dn_{r} / 4096e0 END AS {r}" for r in ROLES) + " FROM cl)"
CTE_OBS = CTE_CLEAR + """,
fv AS (SELECT sensor, px_id, obs_date, """ + ", ".join(
    f"arg_min({r}, tile_ord) FILTER (WHERE {r} IS NOT NULL) AS {r}" for r in ROLES) + """ FROM refl GROUP BY 1, 2, 3),
obs AS (SELECT *, CAST(datediff('day', DATE '2024-01-01', obs_date) AS INT) AS day,
  (nir - red) / nullif(nir + red, 0) AS NDVI, nir / nullif(green, 0) - 1 AS GCVI,
  CASE WHEN sensor = 'S2' THEN (nir8a - swir1) / nullif(nir8a + swir1, 0) ELSE (nir - swir1) / nullif(nir + swir1, 0) END AS NDMI,
  (swir1 - swir2) / nullif(swir1 + swir2, 0) AS NDTI,
  CASE WHEN sensor = 'S2' THEN (nir8a - re1) / nullif(nir8a + re1, 0) END AS NDRE,
  CASE WHEN sensor = 'S2' THEN re3 / nullif(re1, 0) - 1 END AS CIre FROM fv)"""
CTE_DESPIKE = CTE_OBS + """,
near AS (SELECT sensor, px_id, day, NDVI, lag(NDVI) OVER w AS p, lead(NDVI) OVER w AS n FROM obs WHERE NDVI IS NOT NULL
  WINDOW w AS (PARTITION BY sensor, px_id ORDER BY day)),
clean AS (SELECT sensor, px_id, day, NDVI FROM near
  WHERE NOT (p IS NOT NULL AND n IS NOT NULL AND NDVI < least(p, n) - 0.1e0))"""
CTE_GATE = CTE_DESPIKE + """,
axis AS (SELECT sensor, min(day) AS t0, max(day) AS t_end, count(DISTINCT day) AS n_dates FROM obs GROUP BY 1),
kept AS (SELECT c.*, t0, t_end, n_valid FROM (SELECT *, count(*) OVER (PARTITION BY sensor, px_id) AS n_valid FROM clean) c
  JOIN axis a ON a.sensor = c.sensor AND n_dates >= 3 WHERE n_valid >= 4)"""
# the oracle uses the dense spine, a different route to the same grid
CTE_GRID = CTE_GATE + """,
seg AS (SELECT *, lead(day) OVER w AS nd, lead(NDVI) OVER w AS nv FROM kept WINDOW w AS (PARTITION BY sensor, px_id ORDER BY day)),
spine AS (SELECT sensor, t0, t_end, unnest(range(t0, t_end + 1, 2)) AS gday FROM axis),
grid AS (SELECT s.sensor, s.px_id, CAST((p.gday - p.t0) / 2 AS BIGINT) AS k, CAST(p.gday AS INT) AS day,
   CAST(floor((p.t_end - p.t0) / 2) AS BIGINT) AS last_k,
   CASE WHEN nd IS NULL THEN NDVI ELSE NDVI + (nv - NDVI) * ((p.gday - s.day) / CAST(nd - s.day AS DOUBLE)) END AS g
  FROM seg s JOIN spine p ON s.sensor = p.sensor AND p.gday >= s.day AND p.gday < coalesce(nd, s.day + 1))"""
CTE_SMOOTH = CTE_GRID + """,
nb AS (SELECT *, lag(g) OVER w AS b, lead(g) OVER w AS a FROM grid WINDOW w AS (PARTITION BY sensor, px_id ORDER BY k)),
curve AS (SELECT sensor, px_id, k, day, CASE WHEN k = 0 OR k = last_k THEN g ELSE
  (coalesce(b, 0e0) + g + coalesce(a, 0e0)) / (1 + (b IS NOT NULL)::INT + (a IS NOT NULL)::INT) END AS s FROM nb)"""
CTE_METRICS = CTE_SMOOTH + """,
pk AS (SELECT sensor, px_id, max(s) AS vmax FROM curve GROUP BY 1, 2),
pk2 AS (SELECT c.sensor, c.px_id, any_value(vmax) AS vmax, min(k) AS kmax, min(day) AS dmax FROM curve c
  JOIN pk USING (sensor, px_id) WHERE c.s = pk.vmax GROUP BY 1, 2),
bs AS (SELECT c.sensor, c.px_id, min(s) FILTER (WHERE k <= kmax) AS bu, min(s) FILTER (WHERE k >= kmax) AS bd, avg(s) AS mean
  FROM curve c JOIN pk2 USING (sensor, px_id) GROUP BY 1, 2),
hit AS (SELECT c.sensor, c.px_id, min(day) FILTER (WHERE k <= kmax AND s >= bu + 5e-1 * (vmax - bu)) AS rd,
  min(day) FILTER (WHERE k > kmax AND s < bd + 5e-1 * (vmax - bd)) AS fd
  FROM curve c JOIN pk2 USING (sensor, px_id) JOIN bs USING (sensor, px_id) GROUP BY 1, 2),
sl AS (SELECT c.sensor, c.px_id, max(d) FILTER (WHERE k < kmax) AS vu, -min(d) FILTER (WHERE k >= kmax) AS vd FROM
  (SELECT *, (lead(s) OVER (PARTITION BY sensor, px_id ORDER BY k) - s) / 2 AS d FROM curve) c
  JOIN pk2 USING (sensor, px_id) GROUP BY 1, 2),
met0 AS (SELECT *, CASE WHEN vmax - bu >= 1e-1 THEN rd END AS rise, CASE WHEN vmax - bd >= 1e-1 THEN fd END AS fall
  FROM pk2 JOIN bs USING (sensor, px_id) JOIN hit USING (sensor, px_id) JOIN sl USING (sensor, px_id)),
met AS (SELECT sensor, px_id, vmax AS NDVImax, vmax - bu AS AMPLITUD, vu AS VELsube, vd AS VELbaja, dmax - rise AS DIASsubemax,
  fall - rise AS DUR50, mean AS NDVImedio, rise AS DIAsube50, dmax AS DIAmax, fall AS DIAbaja50, bu AS base_up, bd AS base_dn FROM met0)"""


def with_cte(cte: str, select: str) -> str:
    return oracle("WITH " + cte + " " + select)


def curve(spark, sf_dir):
    return C.curve_metrics(observations(spark, sf_dir), STEP)


# ------------------------------------------------------------------ masks and reflectance
@query("clear_mask", oracle("""
SELECT sensor, mask, CAST(CASE WHEN sensor = 'S2' THEN mask IN (4, 5, 6, 7) ELSE (mask & 63) = 0 END AS INT) AS screen,
  CAST(CASE WHEN sensor = 'S2' THEN mask IN (4, 5) ELSE (mask & 63) = 0 AND mask <> 0 END AS INT) AS variables, count(*) AS n
FROM {obs_dn} o GROUP BY 1, 2, 3, 4"""))
def clear_mask(spark, sf_dir):
    s, m = F.col("sensor"), F.col("mask")
    return (view(spark, sf_dir, "obs_dn").groupBy("sensor", "mask").agg(F.count(F.lit(1)).alias("n"))
            .select("sensor", "mask", B.clear_for_screening(s, m).cast("int").alias("screen"),
                    B.clear_for_variables(s, m).cast("int").alias("variables"), "n"))


@query("valid_mask", oracle("""
SELECT sensor, px_id, count(*) FILTER (WHERE CASE WHEN sensor = 'S2' THEN mask <> 0 ELSE (mask & 1) = 0 END) AS n_valid,
  count(*) AS n FROM {obs_dn} o GROUP BY 1, 2"""))
def valid_mask(spark, sf_dir):
    return view(spark, sf_dir, "obs_dn").groupBy("sensor", "px_id").agg(
        F.count_if(B.has_data(F.col("sensor"), F.col("mask"))).alias("n_valid"), F.count(F.lit(1)).alias("n"))


@query("dn_to_reflectance", with_cte(CTE_CLEAR, "SELECT sensor, px_id, tile_ord, " + ", ".join(ROLES) + " FROM refl"))
def dn_to_reflectance(spark, sf_dir):
    return O.to_reflectance(view(spark, sf_dir, "obs_dn"), scale=SCALE).select("sensor", "px_id", "tile_ord", *ROLES)


@query("tile_first_valid", with_cte(CTE_OBS, "SELECT sensor, px_id, CAST(obs_date AS VARCHAR) AS obs_date, "
                                   + ", ".join(ROLES) + " FROM fv"))
def tile_first_valid(spark, sf_dir):
    return rounded(O.tile_first_valid(O.to_reflectance(view(spark, sf_dir, "obs_dn"), scale=SCALE)), (), 12)


@query("spectral_indices", with_cte(CTE_OBS, "SELECT sensor, px_id, day, " + ", ".join(
    f"round({i}, 9) + 0e0 AS {i}" for i in B.INDICES) + " FROM obs"))
def spectral_indices(spark, sf_dir):
    return rounded(observations(spark, sf_dir).select("sensor", "px_id", "day", *B.INDICES), (), 9)


@query("index_availability", oracle("""
WITH seen AS (SELECT sensor, """ + ", ".join(f"bool_or(dn_{r} IS NOT NULL) AS {r}" for r in ROLES) + """ FROM {obs_dn} o GROUP BY 1)
""" + " UNION ALL ".join(
    [f"SELECT sensor, CAST(nir AND red AS INT) AS curve_ready, '{r}' AS variable FROM seen WHERE {r}" for r in ROLES]
    + [f"SELECT sensor, CAST(nir AND red AS INT), '{i}' FROM seen WHERE {cond}" for i, cond in (
        ("NDVI", "nir AND red"), ("GCVI", "nir AND green"),
        ("NDMI", "nir AND swir1 AND (sensor <> 'S2' OR nir8a)"), ("NDTI", "swir1 AND swir2"),
        ("NDRE", "sensor = 'S2' AND nir8a AND re1"), ("CIre", "sensor = 'S2' AND re3 AND re1"))])))
def index_availability(spark, sf_dir):
    return O.available_variables(view(spark, sf_dir, "obs_dn"))


@query("mosaic", oracle("""
WITH t AS (SELECT *, CASE WHEN sensor = 'S2' THEN 10 ELSE 30 END AS res,
    CASE WHEN sensor = 'S2' AND day(obs_date) % 4 = 0 AND tile = 'T2' THEN '32615' ELSE '32614' END AS crs FROM {obs_dn} o),
g AS (SELECT sensor, obs_date, count(DISTINCT tile) AS n_tiles, count(DISTINCT crs) AS n_crs FROM t GROUP BY sensor, obs_date, res)
SELECT sensor, px_id, CAST(obs_date AS VARCHAR) AS obs_date,
  arg_max(mask, tile_ord) FILTER (WHERE mask <> CASE WHEN sensor = 'S2' THEN 0 ELSE 1 END) AS mask,
  arg_max(dn_nir, tile_ord) FILTER (WHERE dn_nir <> 0) AS dn_nir,
  arg_max(dn_swir2, tile_ord) FILTER (WHERE dn_swir2 <> 0) AS dn_swir2
FROM t JOIN g USING (sensor, obs_date) WHERE n_tiles >= 2 AND n_crs = 1 GROUP BY sensor, px_id, t.obs_date"""))
def mosaic(spark, sf_dir):
    tiles = view(spark, sf_dir, "obs_dn").withColumns({
        "res": F.when(B.is_s2(F.col("sensor")), 10).otherwise(30),
        "crs": F.when(B.is_s2(F.col("sensor")) & (F.day("obs_date") % 4 == 0) & (F.col("tile") == "T2"), "32615")
        .otherwise("32614")})
    return rounded(O.mosaic(tiles, ["mask", "dn_nir", "dn_swir2"]), (), 9)


# ------------------------------------------------------------------ scenes on their mask
CTE_STATS = """dn AS (SELECT sensor || '_' || CAST(obs_date AS STRING) || '_' || tile AS scene_id, sensor, mask FROM {obs_dn} o),
st AS (SELECT scene_id, sensor, count(*) AS n_px,
   count(*) FILTER (WHERE CASE WHEN sensor = 'S2' THEN mask <> 0 ELSE (mask & 1) = 0 END) AS n_data,
   count(*) FILTER (WHERE CASE WHEN sensor = 'S2' THEN mask IN (4, 5, 6, 7) ELSE (mask & 63) = 0 END) AS n_clear
  FROM dn GROUP BY 1, 2),
cc AS (SELECT *, least(n_data / greatest(90e0, n_px), 1e0) AS cover, coalesce(n_clear / nullif(CAST(n_data AS DOUBLE), 0), 0) AS clear FROM st)"""


def scene_masks(spark, sf_dir):
    return view(spark, sf_dir, "obs_dn").select(
        F.concat_ws("_", "sensor", F.col("obs_date").cast("string"), "tile").alias("scene_id"), "sensor", "px_id", "mask")


@query("scene_cover_clear", with_cte(CTE_STATS + """,
h AS (SELECT scene_id, string_agg(CAST(mask AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY mask) AS hist
  FROM (SELECT scene_id, mask, count(*) AS n FROM dn GROUP BY 1, 2) GROUP BY 1)""", """
SELECT scene_id, sensor, n_px, round(cover, 9) AS cover, round(clear, 9) AS clear, CASE WHEN sensor = 'S2' THEN hist
  ELSE 'data:' || n_data || ',clear:' || n_clear END AS mask_hist FROM cc JOIN h USING (scene_id)"""))
def scene_cover_clear(spark, sf_dir):
    stats = O.scene_cover_clear(scene_masks(spark, sf_dir), 90.0)
    text = F.array_join(F.transform(F.map_entries("mask_hist"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return rounded(stats.withColumn("mask_hist", text), (), 9)


@query("scene_screen", with_cte(CTE_STATS, """
SELECT scene_id, sensor, round_even(100 * cover, 2) AS cover_aoi_pct, round_even(100 * clear, 2) AS clear_aoi_pct,
  n_px AS aoi_px_mask, CASE WHEN cover < 0.6e0 THEN 'skipped_cover' WHEN clear < 0.55e0 THEN 'skipped_cloudy' ELSE 'ok' END AS status
FROM cc"""))
def scene_screen(spark, sf_dir):
    stats = O.scene_cover_clear(scene_masks(spark, sf_dir), 90.0)
    return O.scene_screen(stats, min_cover=0.6, min_clear=0.55).drop("mask_hist")


# ------------------------------------------------------------------ the curve
@query("curve_despike", with_cte(CTE_DESPIKE, "SELECT sensor, px_id, day, round(NDVI, 9) AS NDVI FROM clean"))
def curve_despike(spark, sf_dir):
    return rounded(C.despike(observations(spark, sf_dir)), (), 9)


@query("curve_gate", with_cte(CTE_GATE, "SELECT sensor, px_id, any_value(n_valid) AS n_valid, any_value(t0) AS t0, "
                             "any_value(t_end) AS t_end FROM kept GROUP BY 1, 2"))
def curve_gate(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return C.gate(C.despike(obs), C.season_axis(obs)).select("sensor", "px_id", "n_valid", "t0", "t_end").distinct()


def resampled(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return C.resample(C.gate(C.despike(obs), C.season_axis(obs)), STEP)


@query("curve_resample", with_cte(CTE_GRID, "SELECT sensor, px_id, day, round(g, 9) + 0e0 AS g FROM grid"))
def curve_resample(spark, sf_dir):
    return rounded(resampled(spark, sf_dir).select("sensor", "px_id", "day", "g"), (), 9)


@query("curve_smooth", with_cte(CTE_SMOOTH, "SELECT sensor, px_id, day, round(s, 9) + 0e0 AS s FROM curve"))
def curve_smooth(spark, sf_dir):
    return rounded(C.smooth(resampled(spark, sf_dir)).select("sensor", "px_id", "day", "s"), (), 9)


def _metric_query(name: str, columns: tuple[str, ...]) -> None:
    days = ("DIAsube50", "DIAmax", "DIAbaja50", "DUR50", "DIASsubemax")
    cols = ", ".join(f"CAST({c} AS INT) AS {c}" if c in days else f"round({c}, 9) + 0e0 AS {c}" for c in columns)

    @query(name, with_cte(CTE_METRICS, f"SELECT sensor, px_id, {cols} FROM met"))
    def run(spark, sf_dir):
        return rounded(curve(spark, sf_dir).select("sensor", "px_id", *columns), (), 9)


_metric_query("curve_metrics", C.SHAPE_METRICS + C.DATE_METRICS)
_metric_query("curve_peak", ("NDVImax", "DIAmax"))
_metric_query("curve_bases", ("base_up", "base_dn"))
_metric_query("curve_greenup", ("DIAsube50",))
_metric_query("curve_senescence", ("DIAbaja50",))
_metric_query("curve_slopes", ("VELsube", "VELbaja"))
_metric_query("curve_shape", ("AMPLITUD", "DUR50", "DIASsubemax", "NDVImedio"))


# ------------------------------------------------------------------ variables
def stored(spark, sf_dir, stage: bool = False):
    """The observations of all pixels, read and merged once."""
    return C.stored(staged(spark, sf_dir) if stage else observations(spark, sf_dir))


def relative(spark, sf_dir, variables=VARS):
    obs = stored(spark, sf_dir)
    return C.relative_medians(obs, C.curve_metrics(obs, STEP), variables, WINDOWS, LANDSAT_EXTRA)


CTE_REL = CTE_METRICS + """,
rw AS (SELECT o.*, w.name AS win, (o.day - CASE w.anchor WHEN 'u' THEN m.DIAsube50 WHEN 'p' THEN m.DIAmax ELSE m.DIAbaja50 END)
    BETWEEN w.a - CASE WHEN o.sensor = 'S2' THEN 0 ELSE 2 END AND w.b + CASE WHEN o.sensor = 'S2' THEN 0 ELSE 2 END AS ok
  FROM obs o LEFT JOIN met m ON o.sensor = m.sensor AND o.px_id = m.px_id CROSS JOIN (VALUES ('REL1_arranque', 'u', -3, 3),
    ('REL2_maximo', 'p', -3, 3), ('REL3_postmax', 'p', 4, 8), ('REL4_bajada', 'd', -3, 3)) AS w(name, anchor, a, b)),
rel AS (SELECT sensor, px_id, win, """ + ", ".join(f"median({v}) FILTER (WHERE ok) AS {v}" for v in VARS) + """,
  count(NDVI) FILTER (WHERE ok) AS nobs FROM rw GROUP BY 1, 2, 3)"""


@query("relative_window_median", with_cte(CTE_REL, "SELECT sensor, px_id, win AS \"window\", " + ", ".join(
    f"round({v}, 9) + 0e0 AS {v}" for v in VARS) + ", nobs FROM rel"))
def relative_window_median(spark, sf_dir):
    return rounded(relative(spark, sf_dir), (), 9)


STAGE_SQL = "CASE " + " ".join(
    f"WHEN obs_date BETWEEN DATE '2024-{a}' AND DATE '2024-{b}' THEN '{n}'" for n, a, b in STAGES["OI"]) + " ELSE 'fuera_de_etapa' END"


def staged(spark, sf_dir):
    windows = CAL.windows(CAL.calendar_table(spark, STAGES).withColumn("year", F.lit(2024)))
    return CAL.stage_assign(observations(spark, sf_dir), windows, "obs_date")


@query("fixed_stage_median", with_cte(CTE_OBS, f"SELECT sensor, px_id, {STAGE_SQL} AS stage, " + ", ".join(
    f"round(median({v}), 9) + 0e0 AS {v}" for v in VARS) + ", count(NDVI) AS nobs FROM obs WHERE " + STAGE_SQL
    + " <> 'fuera_de_etapa' GROUP BY 1, 2, 3"))
def fixed_stage_median(spark, sf_dir):
    return rounded(C.fixed_medians(staged(spark, sf_dir), VARS, [s[0] for s in STAGES["OI"]]), (), 9)


@query("nobs", with_cte(CTE_REL, "SELECT sensor, win AS \"window\", nobs, count(*) AS pixels FROM rel GROUP BY 1, 2, 3"))
def nobs(spark, sf_dir):
    return relative(spark, sf_dir, ("NDVI",)).groupBy("sensor", "window", "nobs").agg(F.count(F.lit(1)).alias("pixels"))


def coherence(spark, sf_dir):
    """Every pixel of the reference sensor, with or without a curve."""
    obs = observations(spark, sf_dir).filter(F.col("sensor") == B.S2)
    pixels = obs.select("sensor", "px_id").distinct()
    met = C.curve_metrics(obs, STEP).select("sensor", "px_id", "DIAsube50", "DIAmax")
    return pixels.join(met, ["sensor", "px_id"], "left").select(
        "px_id", C.coherence_code(F.col("DIAsube50"), F.col("DIAmax"), REFS).alias("code"))


CTE_CODE = CTE_METRICS + """,
px AS (SELECT DISTINCT px_id FROM obs WHERE sensor = 'S2'),
fit AS (SELECT px.px_id, DIAsube50 AS r, DIAmax AS p, coalesce(DIAsube50 BETWEEN 2 AND 9 AND DIAmax BETWEEN 11 AND 14, FALSE) AS m,
  coalesce(DIAmax BETWEEN 13 AND 17, FALSE) AS s FROM px LEFT JOIN met ON met.px_id = px.px_id AND met.sensor = 'S2'),
code AS (SELECT px_id, CASE WHEN p IS NULL THEN 0 WHEN m AND s THEN 3 WHEN m THEN 1 WHEN s THEN 2 WHEN r IS NULL THEN 5 ELSE 4 END AS code FROM fit)"""


@query("coherence_code", with_cte(CTE_CODE, "SELECT px_id, code FROM code"))
def coherence_code(spark, sf_dir):
    return coherence(spark, sf_dir)


@query("reference_histogram", with_cte(CTE_CODE, "SELECT code, count(*) AS pixels FROM code GROUP BY 1"))
def reference_histogram(spark, sf_dir):
    return coherence(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("pixels"))


def pixel_windows(spark, sf_dir, stages=()) -> DataFrame:
    """One row per pixel: metrics, relative windows and, asked for, calendar stages."""
    obs = stored(spark, sf_dir, bool(stages))
    return C.pixel_windows(obs, C.curve_metrics(obs, STEP), VARS, WINDOWS, LANDSAT_EXTRA, stages)


def all_features(spark, sf_dir) -> DataFrame:
    """The variables table (one row per pixel and variable) of the whole cycle."""
    return C.features_of_pixels(pixel_windows(spark, sf_dir), VARS)


BAND_OF = {("S2", "nir"): "B08", ("S2", "red"): "B04", ("LANDSAT", "nir"): "SR_B5", ("LANDSAT", "red"): "SR_B4"}


def band_names(sensor: str) -> list[tuple[str, str]]:
    return [(v, BAND_OF.get((sensor, v), v)) for v in VARS if sensor == "S2" or v not in ("NDRE", "CIre")]


CTE_LONG = CTE_REL + ", long AS (" + " UNION ALL ".join(
    [f"SELECT px_id, CASE sensor WHEN 'S2' THEN 'S2' ELSE 'LS' END || '_FEN_{m}' AS name, CAST({m} AS DOUBLE) AS value FROM met"
     for m in C.SHAPE_METRICS]
    + [f"SELECT px_id, '{'S2' if s == 'S2' else 'LS'}_' || win || '_{n}', {v} FROM rel WHERE sensor = '{s}'"
       for s in ("S2", "LANDSAT") for v, n in band_names(s)]) + ")"


@query("variable_name", with_cte(CTE_LONG, "SELECT name, count(*) AS pixels, count(value) AS present, "
                                "round(sum(value), 4) + 0e0 AS total FROM long GROUP BY 1"))
def variable_name(spark, sf_dir):
    return all_features(spark, sf_dir).groupBy("name").agg(
        F.count(F.lit(1)).alias("pixels"), F.count("value").alias("present"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))


PRESETS = {"indices": "_(NDVI|GCVI|NDMI|NDTI|NDRE|CIre)$", "phen": "_FEN_", "rel": "_REL", "s2": "^S2_"}


@query("variable_presets", with_cte(CTE_LONG, " UNION ALL ".join(
    f"SELECT DISTINCT '{k}' AS preset, name FROM long WHERE regexp_matches(name, '{p}')" for k, p in PRESETS.items())))
def variable_presets(spark, sf_dir):
    names = all_features(spark, sf_dir).select("name").distinct()
    hits = F.array_compact(F.array(*[F.when(F.col("name").rlike(p), F.lit(k)) for k, p in PRESETS.items()]))
    return names.select(F.explode(hits).alias("preset"), "name")


@query("features_wide", with_cte(CTE_LONG, "SELECT px_id, " + ", ".join(
    f"round(max(value) FILTER (WHERE name = '{n}'), 9) + 0e0 AS {n}" for n in (
        "S2_REL2_maximo_NDVI", "LS_REL2_maximo_NDVI", "S2_FEN_NDVImax")) + " FROM long GROUP BY 1"))
def features_wide(spark, sf_dir):
    names = ["S2_REL2_maximo_NDVI", "LS_REL2_maximo_NDVI", "S2_FEN_NDVImax"]
    return rounded(C.features_wide(all_features(spark, sf_dir), names), (), 9)
