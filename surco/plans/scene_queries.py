"""Queries over catalogue items, scenes and the scene log."""

from __future__ import annotations

from pyspark.sql import functions as F

from surco.functions import bands as B
from surco.operators import calendar as CAL
from surco.operators import scenes as S
from surco.plans.curve_queries import rounded, with_cte
from surco.plans.registry import query
from surco.session import scratch_path
from surco.sources import catalogue as CT
from surco.sources.adapters import VIEWS, oracle, table, view

AREA = ((-98.03, 25.03), (-97.83, 25.03), (-97.83, 25.23), (-98.03, 25.23))
AREA_BOX = (-98.03, 25.03, -97.83, 25.23)


def pages(spark, sf_dir):
    """Catalogue pages as JSON text: every item comes twice, as on overlapping pages."""
    # the driver's table is one small file; a catalogue comes as many pages, so spread the rows
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").repartition("o_orderkey")
    f = spark.sql(VIEWS["scene_facts"], orders=orders)
    when, c, lit = F.when, F.col, F.lit
    s2, l = c("sensor") == "S2", c("l")

    def on(cond, value):
        return when(cond, value)

    props = F.struct(
        F.concat("day", lit("T17:09:01Z")).alias("datetime"), c("cloud").alias("eo:cloud_cover"), c("platform").alias("platform"),
        on(s2 & (l == 0), c("square")).alias("s2:mgrs_tile"), on(s2 & (l == 1), lit("14")).alias("mgrs:utm_zone"),
        on(s2 & (l == 1), lit("R")).alias("mgrs:latitude_band"), on(s2 & (l == 1), F.substring("square", 4, 2)).alias("mgrs:grid_square"),
        on(s2 & (l == 2), F.concat(lit("MGRS-"), "square")).alias("grid:code"),
        on(s2 & (l == 0), F.concat(lit("GS2A_"), "ymd", lit("_"), (c("k") % 5).cast("string"))).alias("s2:datatake_id"),
        on(s2, when(l == 0, "05.11").when(l == 4, "abc")).alias("s2:processing_baseline"),
        on(s2 & (l == 1), lit("03.01")).alias("processing:version"),
        on(~s2 & (l % 2 == 0) & (l < 4), c("path")).alias("landsat:wrs_path"), on(~s2 & (l % 2 == 0) & (l < 4), lit("42")).alias("landsat:wrs_row"),
        on(~s2 & (l != 1), lit("T1")).alias("landsat:collection_category"))

    def asset(key, band=None):
        base = F.concat(when(c("k") % 3 == 0, "s3://b/").otherwise("https://h/"), c("k").cast("string"), lit("/" + key))
        href = lambda p: F.struct(F.concat(lit(p), c("k").cast("string"), lit("/" + key)).alias("href"))
        scaled = F.array(F.struct(lit(2e-4).alias("scale"), when(c("k") % 2 == 0, lit(-0.05)).alias("offset")))
        declared = F.array(F.struct(lit(band).alias("name"))) if band else lit(None).cast("array<struct<name:string>>")
        return F.struct(base.alias("href"), when(l == 1, scaled).alias("raster:bands"),
                        F.struct(when(c("k") % 2 == 0, href("s3://alt/")).alias("s3"), when(c("k") % 5 < 2, href("https://alt/")).alias("https")).alias("alternate"),
                        declared.alias("eo:bands"))

    def assets(entries):
        return F.create_map(*[x for key, band in entries for x in (lit(key), asset(key, band))])

    maps = (when(~s2, assets([("red", None), ("nir08", None), ("qa_pixel", None)]))
            .when(l.isin(0, 2), assets([("red", None), ("nir", None), ("nir08", None), ("scl", None)]))
            .when(l.isin(1, 3), assets([("B04", None), ("B08_10m", None), ("SCL", None)]))
            .otherwise(assets([("a_jp2", "B4"), ("data1", "B4"), ("nir", None)])))
    x1, y1 = c("x0") + 1.0, c("y0") + 1.0
    ring = F.array(F.array("x0", "y0"), F.array(x1, c("y0")), F.array(x1, y1), F.array(c("x0"), y1), F.array("x0", "y0"))
    geometry = when(c("k") % 10 != 9, F.struct(lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    item = F.struct("id", when(l != 4, lit("coll")).alias("collection"), geometry.alias("geometry"), maps.alias("assets"), props.alias("properties"))
    texts = f.select(c("k").alias("page"), "source", F.to_json(item).alias("item"))  # made once, written twice
    return texts.select("page", "source", F.concat(lit('{"features":['), "item", lit(","), "item", lit("]}")).alias("value"))


def scenes(spark, sf_dir):
    """Typed scenes, each id once."""
    return CT.scenes(S.dedupe(CT.parse_pages(pages(spark, sf_dir), once=True)))


CTE = """f AS (SELECT *, sensor = 'S2' AS s2 FROM {scene_facts} f),
sc AS (SELECT *, CASE WHEN s2 THEN square WHEN l = 4 THEN '?' ELSE path || '042' END AS tile,
  CASE WHEN s2 THEN CASE l WHEN 0 THEN '05.11' WHEN 1 THEN '03.01' WHEN 2 THEN '' WHEN 3 THEN '05.11' ELSE 'abc' END
   WHEN l = 1 THEN '' ELSE 'T1' END AS baseline FROM f),
dt AS (SELECT *, CASE WHEN s2 THEN CASE WHEN l = 0 THEN 'GS2A_' || ymd || '_' || k % 5 WHEN l = 4 THEN platform || '_' || day
    ELSE 'S2A_' || ymd || 'T170901' END ELSE platform || '_' || day || '_' || left(tile, 3) END AS datatake,
  CASE WHEN l <> 4 THEN 'coll' ELSE CASE source WHEN 'es-s2' THEN 'sentinel-2-c1-l2a' WHEN 'pc-s2' THEN 'sentinel-2-l2a' ELSE 'landsat-c2-l2' END END AS collection,
  CASE WHEN s2 THEN 'S2' || upper(right(platform, 1)) ELSE 'L' || right(platform, 1) END AS short FROM sc)"""


@query("src_scene_items", with_cte(CTE, """
SELECT id, source, sensor, collection, day AS date, tile, platform, baseline, cloud AS cloud_tile, datatake FROM dt UNION ALL
SELECT id, source, sensor, collection, day AS date, tile, platform, baseline, cloud, datatake FROM dt"""))
def src_scene_items(spark, sf_dir):
    """Pages written as text in the shared folder, read back and parsed."""
    path = scratch_path(spark, "catalogue")
    # a page holds every item twice, and items repeat their keys: compressed, the folder is a small part of the text
    pages(spark, sf_dir).write.partitionBy("source").json(path, compression="lz4")
    back = spark.read.schema("page bigint, value string, source string").json(path)
    return CT.scenes(CT.parse_pages(back)).select(
        "id", "source", "sensor", "collection", "date", "tile", "platform", "baseline", "cloud_tile", "datatake")


def _column_query(name, oracle_select, *columns):
    @query(name, with_cte(CTE, oracle_select))
    def run(spark, sf_dir):
        return scenes(spark, sf_dir).select("id", *columns)


_column_query("scene_dedupe", "SELECT id, source FROM dt", "source")
_column_query("scene_tile", "SELECT id, tile FROM dt", "tile")
_column_query("scene_baseline", "SELECT id, baseline FROM dt", "baseline")
_column_query("scene_datatake", "SELECT id, datatake FROM dt", "datatake")


@query("scene_platform_tag", with_cte(CTE, "SELECT id, short, CASE WHEN s2 THEN 'S2_' ELSE 'LS_' END || ymd || '_' || tile || '_' || short AS tag FROM dt"))
def scene_platform_tag(spark, sf_dir):
    return scenes(spark, sf_dir).select("id", CT.short_platform(F.col("platform")).alias("short"),
                                        CT.file_tag(F.col("sensor"), F.col("date"), F.col("tile"), F.col("platform")).alias("tag"))


CTE_BANDS = CTE + """,
b AS (SELECT *, unnest(CASE WHEN NOT s2 THEN ['SR_B4', 'SR_B5', 'QA_PIXEL'] WHEN l IN (0, 2) THEN ['B04', 'B08', 'B8A', 'SCL']
   WHEN l = 4 THEN ['B04', 'B08'] ELSE ['B04', 'B08', 'SCL'] END) AS band,
  unnest(CASE WHEN NOT s2 THEN ['red', 'nir08', 'qa_pixel'] WHEN l IN (0, 2) THEN ['red', 'nir', 'nir08', 'scl']
   WHEN l = 4 THEN ['data1', 'nir'] ELSE ['B04', 'B08_10m', 'SCL'] END) AS key FROM dt)"""


def bands(spark, sf_dir):
    return scenes(spark, sf_dir).select("id", F.inline_outer("bands")).filter(F.col("band").isNotNull())


@query("band_asset_resolve", with_cte(CTE_BANDS, """
SELECT id, band, key FROM b UNION ALL SELECT id, unnest(CASE WHEN NOT s2 THEN ['SR_B1', 'SR_B2', 'SR_B3', 'SR_B6', 'SR_B7']
 WHEN l IN (0, 2) THEN ['B02', 'B03', 'B05', 'B06', 'B07', 'B11', 'B12'] WHEN l = 4 THEN ['B02', 'B03', 'B05', 'B06', 'B07', 'B8A', 'B11', 'B12', 'SCL']
 ELSE ['B02', 'B03', 'B05', 'B06', 'B07', 'B8A', 'B11', 'B12'] END), NULL FROM dt"""))
def band_asset_resolve(spark, sf_dir):
    s = scenes(spark, sf_dir)
    found = F.transform("bands", lambda b: F.struct(b["band"].alias("band"), b["key"].alias("key")))
    absent = F.transform("missing", lambda m: F.struct(m.alias("band"), F.lit(None).cast("string").alias("key")))
    return s.select("id", F.inline_outer(F.concat(found, absent)))


@query("band_scale_offset", with_cte(CTE_BANDS, """
SELECT id, band, CASE WHEN band IN ('SCL', 'QA_PIXEL') THEN 1e0 WHEN l = 1 THEN 2e-4 WHEN NOT s2 THEN 2.75e-5 ELSE 1e-4 END AS scale,
 CASE WHEN band IN ('SCL', 'QA_PIXEL') THEN 0e0 WHEN l = 1 AND k % 2 = 0 THEN -0.05e0 WHEN l = 1 THEN 0e0 WHEN NOT s2 THEN -0.2e0
  WHEN l IN (0, 3) THEN -0.1e0 END AS offset_value FROM b"""))
def band_scale_offset(spark, sf_dir):
    return bands(spark, sf_dir).select("id", "band", "scale", F.col("offset").alias("offset_value"))


@query("asset_href", with_cte(CTE_BANDS, """
SELECT id, band, CASE WHEN source = 'es-ls' AND k % 3 <> 0 AND k % 2 = 0 THEN 's3://alt/' WHEN source <> 'es-ls' AND k % 3 = 0 AND k % 5 < 2 THEN 'https://alt/'
 WHEN k % 3 = 0 THEN 's3://b/' ELSE 'https://h/' END || k || '/' || key AS href FROM b"""))
def asset_href(spark, sf_dir):
    return bands(spark, sf_dir).select("id", "band", "href")


FILTER = """coalesce(cloud <= 60, TRUE) AND (s2 OR platform IN ('landsat-8', 'landsat-9')) AND day >= '1993-01-01' AND day <= '1997-12-31'
 AND (k % 10 = 9 OR x0 <= -97.83e0 AND x0 + 1 >= -98.03e0 AND y0 <= 25.23e0 AND y0 + 1 >= 25.03e0)"""


@query("scene_filter", with_cte(CTE, f"SELECT id, source, day AS date, cloud AS cloud_tile FROM dt WHERE {FILTER}"))
def scene_filter(spark, sf_dir):
    return S.search(scenes(spark, sf_dir), AREA_BOX, "1993-01-01", "1997-12-31").select("id", "source", "date", "cloud_tile")


@query("scene_sort", with_cte(CTE, "SELECT id, day || 'T17:09:01Z' AS datetime, tile FROM dt ORDER BY datetime, tile"))
def scene_sort(spark, sf_dir):
    return S.sort(scenes(spark, sf_dir)).select("id", "datetime", "tile")


@query("scene_duplicates", with_cte(CTE + """,
w AS (SELECT *, k % 10 <> 9 AND x0 <= -98.03e0 AND x0 + 1 > -97.83e0 AND y0 <= 25.03e0 AND y0 + 1 > 25.23e0 AS whole FROM dt),
g AS (SELECT sensor, datatake, count(*) AS n, min(tile || '|' || id) FILTER (WHERE whole) AS kp FROM w GROUP BY 1, 2)""", """
SELECT id, split_part(kp, '|', 1) AS kept_tile FROM w JOIN g USING (sensor, datatake) WHERE n >= 2 AND kp IS NOT NULL AND id <> split_part(kp, '|', 2)"""))
def scene_duplicates(spark, sf_dir):
    return S.duplicates(scenes(spark, sf_dir), AREA)


@query("download_size", with_cte(CTE, """
SELECT sensor, count(*) AS n_scenes, round(count(*) * CASE WHEN sensor = 'S2' THEN 36e6 / 100 * 2 * 4 + 36e6 / 400 * 2 * 6 + 36e6 / 400 * 2
 ELSE 36e6 / 900 * 2 * 7 + 36e6 / 900 * 2 END / 1e9, 6) AS gigabytes FROM dt GROUP BY 1"""))
def download_size(spark, sf_dir):
    return rounded(S.download_size(scenes(spark, sf_dir), 36e6), ())


# ------------------------------------------------------------------ windows and grid
@query("pixel_window", oracle("""
WITH t AS (SELECT k, sensor, CASE WHEN sensor = 'S2' THEN 10e0 ELSE 30e0 END AS res, CASE WHEN sensor = 'S2' THEN 20e0 ELSE 30e0 END AS sn,
   500000e0 + (k % 40) * 250 AS ox, 2700000e0 - (k % 31) * 170 AS oy, 503333e0 AS ax0, 505501e0 AS ax1, 2694111e0 AS ay0, 2697777e0 AS ay1,
   CASE WHEN sensor = 'S2' THEN 400 ELSE 150 END AS n FROM {scene_facts} f),
w AS (SELECT *, greatest(ox + floor((ax0 - 50 - ox) / sn) * sn, ox) AS x0, least(ox + ceil((ax1 + 50 - ox) / sn) * sn, ox + res * n) AS x1,
  greatest(oy - ceil((oy - (ay0 - 50)) / sn) * sn, oy - res * n) AS y0, least(oy - floor((oy - (ay1 + 50)) / sn) * sn, oy) AS y1 FROM t)
SELECT k, CAST(round_even((x0 - ox) / res, 0) AS INT) AS xoff, CAST(round_even((oy - y1) / res, 0) AS INT) AS yoff,
 CAST(round_even((x1 - x0) / res, 0) AS INT) AS xsize, CAST(round_even((y1 - y0) / res, 0) AS INT) AS ysize FROM w WHERE x0 < x1 AND y0 < y1"""))
def pixel_window(spark, sf_dir):
    f = view(spark, sf_dir, "scene_facts")
    s2 = F.col("sensor") == B.S2
    tiles = f.select("k", "sensor", F.when(s2, 10.0).otherwise(30.0).alias("res"), (500000.0 + (F.col("k") % 40) * 250).alias("ox"),
                     (2700000.0 - (F.col("k") % 31) * 170).alias("oy"), F.lit(503333.0).alias("minx"), F.lit(505501.0).alias("maxx"),
                     F.lit(2694111.0).alias("miny"), F.lit(2697777.0).alias("maxy"),
                     F.when(s2, 400).otherwise(150).alias("width"), F.when(s2, 400).otherwise(150).alias("height"))
    return S.pixel_window(tiles, 50.0).select("k", "xoff", "yoff", "xsize", "ysize")


@query("grid_define", oracle("""
WITH t AS (SELECT k, CASE WHEN k % 10 < 4 THEN '32614' WHEN k % 10 < 8 THEN '32615' ELSE '32613' END AS crs, 500000e0 + (k % 400) * 13 AS x0,
  2700000e0 + (k % 313) * 17 AS y0 FROM {scene_facts} f),
g AS (SELECT crs, count(*) AS n, min(k) AS o, min(x0) AS a, min(y0) AS b, max(x0 + 3333) AS c, max(y0 + 4444) AS d FROM t GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY n DESC, o) AS rn FROM g)
SELECT crs, 20e0 AS res, floor(a / 20) * 20 AS minx, ceil(d / 20) * 20 AS maxy, CAST((ceil(c / 20) * 20 - floor(a / 20) * 20) / 20 AS INT) AS w,
 CAST((ceil(d / 20) * 20 - floor(b / 20) * 20) / 20 AS INT) AS h, (SELECT string_agg(crs, ',' ORDER BY crs) FROM s WHERE rn > 1) AS other_crs FROM s WHERE rn = 1"""))
def grid_define(spark, sf_dir):
    k = F.col("k")
    tiles = view(spark, sf_dir, "scene_facts").select(
        k.alias("ord"), F.when(k % 10 < 4, "32614").when(k % 10 < 8, "32615").otherwise("32613").alias("crs"),
        (500000.0 + (k % 400) * 13).alias("minx"), (2700000.0 + (k % 313) * 17).alias("miny"))
    tiles = tiles.withColumns({"maxx": F.col("minx") + 3333, "maxy": F.col("miny") + 4444})
    return S.define_grid(tiles, 20.0).withColumn("other_crs", F.array_join("other_crs", ","))


# ------------------------------------------------------------------ the scene log
def staged_scenes(spark, sf_dir):
    """Scenes of both cycles with their stage in the starting calendar (year of their date)."""
    f = view(spark, sf_dir, "scene_facts").withColumns({
        "cycle": F.when(F.col("k") % 2 == 0, "OI").otherwise("PV"), "year": F.year("obs_date")})
    windows = CAL.windows(CAL.calendar_of_years(f.select("year").distinct()))
    return CAL.stage_assign(f, windows, "obs_date", ["cycle", "year"])


def stage_sql(cycle_expr, day_expr):
    return "CASE " + " ".join(
        f"WHEN {cycle_expr} = '{c}' AND strftime({day_expr}, '%m-%d') BETWEEN '{a}' AND '{b}' THEN '{n}'"
        for c, st in CAL.DEFAULT_CALENDAR.items() for n, a, b in st) + " ELSE 'fuera_de_etapa' END"


CTE_STAGED = CTE + ", st AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'OI' ELSE 'PV' END AS cycle, " + stage_sql(
    "(CASE WHEN k % 2 = 0 THEN 'OI' ELSE 'PV' END)", "obs_date") + " AS stage FROM dt)"


@query("stage_assign", with_cte(CTE_STAGED, "SELECT k, cycle, stage FROM st"))
def stage_assign(spark, sf_dir):
    return staged_scenes(spark, sf_dir).select("k", "cycle", "stage")


@query("scene_counts", with_cte(CTE_STAGED, """SELECT stage, count(*) FILTER (WHERE sensor = 'S2') AS S2,
 count(*) FILTER (WHERE sensor = 'LANDSAT') AS LANDSAT FROM st GROUP BY 1"""))
def scene_counts(spark, sf_dir):
    return S.counts(staged_scenes(spark, sf_dir))


def records(spark, sf_dir):
    """Log records: accepted, cloudy and partial scenes, two files each."""
    s = staged_scenes(spark, sf_dir)
    status = F.when(F.col("k") % 6 == 0, "skipped_cloudy").when(F.col("k") % 11 == 0, "skipped_cover").otherwise("ok")
    files = F.concat_ws(";", F.concat("id", F.lit("_10m.tif")), F.concat("id", F.lit("_20m.tif")))
    return s.select(
        F.col("id").alias("scene_id"), "sensor", "source", F.col("day").alias("date"), "stage", "k",
        status.alias("status"), F.when(status == "ok", files).alias("files"), F.col("cloud").alias("cloud_tile_pct"))


STATUS = "CASE WHEN k % 6 = 0 THEN 'skipped_cloudy' WHEN k % 11 = 0 THEN 'skipped_cover' ELSE 'ok' END"


@query("snk_manifest_append", with_cte(CTE_STAGED, f"SELECT id AS scene_id, stage, {STATUS} AS status, CAST(NULL AS VARCHAR) AS crs FROM st"))
def snk_manifest_append(spark, sf_dir):
    """Two appends to one log; columns the log does not have are dropped, missing ones stay empty."""
    path = scratch_path(spark, "log") + "/OI_2025"
    rec = records(spark, sf_dir)
    S.append_manifest(rec.filter("sensor = 'S2'"), path)
    S.append_manifest(rec.filter("sensor = 'LANDSAT'"), path)
    schema = ", ".join(f"`{c}` string" for c in S.MANIFEST)
    return spark.read.csv(path, header=True, schema=schema, escape='"').select("scene_id", "stage", "status", "crs")


@query("src_manifest", with_cte(CTE_STAGED, f"SELECT id AS scene_id, stage, day AS date, 'OI' AS cycle, 2025 AS year, "
                               f"id || '_10m.tif;' || id || '_20m.tif' AS files FROM st WHERE {STATUS} = 'ok'"))
def src_manifest(spark, sf_dir):
    path = scratch_path(spark, "log") + "/OI_2025"
    S.append_manifest(records(spark, sf_dir), path)
    return S.read_manifest(spark, path).select("scene_id", "stage", "date", "cycle", "year", "files")


NEW_CALENDAR = {"OI": [("00_siembra_emergencia", "01-15", "03-10"), ("01_vegetativo", "03-11", "04-10"),
                       ("02_floracion_espigamiento", "04-11", "05-15"), ("03_madurez_senescencia", "05-16", "06-30")],
                "PV": CAL.DEFAULT_CALENDAR["PV"]}
NEW_STAGE = "CASE " + " ".join(
    f"WHEN cycle = '{c}' AND strftime(obs_date, '%m-%d') BETWEEN '{a}' AND '{b}' THEN '{n}'"
    for c, st in NEW_CALENDAR.items() for n, a, b in st) + " ELSE 'fuera_de_etapa' END"


@query("restage_manifest", with_cte(CTE_STAGED + f""",
m AS (SELECT id, sensor, stage AS old_stage, {NEW_STAGE} AS new_stage, k FROM st WHERE {STATUS} = 'ok'),
r AS (SELECT *, CASE WHEN new_stage = old_stage THEN 'kept' WHEN k % 7 = 1 OR k % 9 = 2 THEN 'problem' ELSE 'moved' END AS result FROM m)""", """
SELECT id AS scene_id, old_stage, new_stage, result, CASE WHEN result = 'moved' THEN new_stage ELSE old_stage END AS stage,
 CASE WHEN result = 'problem' THEN CASE WHEN k % 7 = 1 THEN 'exists ' || id || '_10m.tif' ELSE 'missing ' || id || '_20m.tif' END END AS problem FROM r"""))
def restage_manifest(spark, sf_dir):
    s = staged_scenes(spark, sf_dir)
    rec = records(spark, sf_dir).filter("status = 'ok'").withColumns({
        "files": F.split("files", ";"), "obs_date": F.to_date("date"),
        "cycle": F.when(F.col("k") % 2 == 0, "OI").otherwise("PV")}).withColumn("year", F.year("obs_date"))
    windows = CAL.windows(CAL.calendar_of_years(s.select("year").distinct(), NEW_CALENDAR))
    # on disk: every file at its stage, but some second files lost, and some first files already at the target
    source = F.concat_ws("/", "stage", "sensor")
    here = rec.select(source.alias("folder"), "k", F.posexplode("files").alias("i", "file")).filter(~((F.col("i") == 1) & (F.col("k") % 9 == 2)))
    target = CAL.stage_assign(rec.withColumnRenamed("stage", "old"), windows, "obs_date", ["cycle", "year"])
    there = target.filter((F.col("k") % 7 == 1) & (F.col("stage") != F.col("old"))).select(F.concat_ws("/", "stage", "sensor").alias("folder"), F.col("files")[0].alias("file"))
    present = here.select("folder", "file").unionByName(there)
    return CAL.restage(rec.select("scene_id", "sensor", "stage", "status", "files", "obs_date", "cycle", "year"), present, windows, ["cycle", "year"]).drop("sensor")
