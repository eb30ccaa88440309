"""Scenes of the catalogue: search filters, repeats, windows, manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surco.functions import bands as B
from surco.session import written_once
from surco.sources.catalogue import LANDSAT_PLATFORMS

# Columns of the scene log.
MANIFEST = ("scene_id", "sensor", "source", "collection", "date", "datetime", "tile", "platform", "baseline", "stage",
            "cloud_tile_pct", "cover_aoi_pct", "clear_aoi_pct", "aoi_px_mask", "status", "reason", "crs", "bounds",
            "files", "scales", "mask_hist")


def search(scenes: DataFrame, bbox: Sequence[float] | None = None, date_from: str | None = None, date_to: str | None = None,
           max_cloud: float = 60, max_items: int | None = None) -> DataFrame:
    """Scenes in a box and period; an unknown cloud share or footprint passes; only current platforms of the second sensor."""
    keep = F.col("cloud_tile").isNull() | (F.col("cloud_tile") <= max_cloud)
    keep = keep & ((F.col("sensor") == B.S2) | F.col("platform").isin(*LANDSAT_PLATFORMS))
    if date_from:
        keep = keep & (F.col("date") >= date_from)
    if date_to:
        keep = keep & (F.col("date") <= date_to)
    if bbox:
        corners = F.flatten("footprint")
        x, y = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
        keep = keep & (F.col("footprint").isNull() | (
            (F.array_max(x) >= bbox[0]) & (F.array_min(x) <= bbox[2]) & (F.array_max(y) >= bbox[1]) & (F.array_min(y) <= bbox[3])))
    found = scenes.filter(keep)
    return sort(found).limit(max_items) if max_items else found


def dedupe(items: DataFrame) -> DataFrame:
    """The first item of each id, in page order.

    Spark cuts each task's rows to one per id before the shuffle (window group limit), so copies
    of a hot id never meet in one task; columns nobody reads later are pruned away.
    """
    first = Window.partitionBy("id").orderBy("page", "pos")
    return items.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") == 1).drop("copy")


def sort(scenes: DataFrame) -> DataFrame:
    return scenes.orderBy("datetime", "tile")


def _crosses(a: Column, b: Column, px: Column, py: Column) -> Column:
    spans = (a["y"] > py) != (b["y"] > py)
    return spans & (px < a["x"] + (py - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]))


def _edges(ring: Column) -> Column:
    """Edges of a ring of corners; the last corner closes on the first."""
    after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    return F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def holds_area(scenes: DataFrame, area: Sequence[tuple[float, float]]) -> DataFrame:
    """Add ``whole``: does the footprint hold the whole area (every corner inside, no edges crossing)?

    The footprint is a list of rings that do not overlap, one per polygon. Works on the few corners of one row; no join. The edge list is its own column so that it
    is built once per row.
    """
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in area])
    ring = F.col("footprint_edges")

    def inside(p: Column) -> Column:
        hits = F.filter(ring, lambda e: _crosses(e["a"], e["b"], p["x"], p["y"]))
        return F.size(hits) % 2 == 1

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def cut(e: Column, f: Column) -> Column:
        return (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (
            side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)

    sides = F.array(*[F.struct(F.get(corners, i).alias("a"), F.get(corners, (i + 1) % len(area)).alias("b")) for i in range(len(area))])
    crossing = F.exists(sides, lambda e: F.exists(ring, lambda f: cut(e, f)))
    # most footprints fail on their box alone
    xs, ys = [float(x) for x, _ in area], [float(y) for _, y in area]
    fx, fy = F.transform(ring, lambda e: e["a"]["x"]), F.transform(ring, lambda e: e["a"]["y"])
    boxed = (F.array_min(fx) <= min(xs)) & (F.array_max(fx) >= max(xs)) & (F.array_min(fy) <= min(ys)) & (F.array_max(fy) >= max(ys))
    whole = F.when(boxed, F.coalesce(F.forall(corners, inside) & ~crossing, F.lit(False))).otherwise(False)
    return scenes.withColumn("footprint_edges", F.flatten(F.transform("footprint", _edges))).withColumn("whole", whole).drop("footprint_edges")


def duplicates(scenes: DataFrame, area: Sequence[tuple[float, float]]) -> DataFrame:
    """Scenes of a pass that repeat a tile which alone holds the whole area: (id, kept_tile).

    The keeper is the first such tile in name order, found by an aggregate that combines on
    the map side; one keeper row per pass joins back, and a hot pass is split by AQE.
    """
    # parsed once, read for the keepers and for their repeats
    seen = holds_area(scenes.select("id", "sensor", "datatake", "tile", "footprint"), area)
    marked = written_once(seen.drop("footprint"))
    order = F.when(F.col("whole"), F.struct("tile", "id"))
    keepers = marked.groupBy("sensor", "datatake").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("keeper")).filter((F.col("n") >= 2) & F.col("keeper").isNotNull())
    return marked.join(keepers, ["sensor", "datatake"]).filter(F.col("id") != F.col("keeper.id")).select(
        "id", F.col("keeper.tile").alias("kept_tile"))


def pixel_window(df: DataFrame, buffer_m: float = 0.0) -> DataFrame:
    """Integer pixel window of a study area in each raster, snapped outward and clamped; no overlap, no row.

    Needs minx, maxx, miny, maxy (area), ox, oy (origin), res, width, height, sensor.
    """
    snap = F.when(F.col("sensor") == B.S2, B.SNAP_M[B.S2]).otherwise(B.SNAP_M[B.LANDSAT])
    ox, oy, res = F.col("ox"), F.col("oy"), F.col("res")
    left = ox + F.floor((F.col("minx") - buffer_m - ox) / snap) * snap
    right = ox + F.ceil((F.col("maxx") + buffer_m - ox) / snap) * snap
    top = oy - F.floor((oy - (F.col("maxy") + buffer_m)) / snap) * snap
    bottom = oy - F.ceil((oy - (F.col("miny") - buffer_m)) / snap) * snap
    w = df.withColumns({
        "wx0": F.greatest(left, ox), "wx1": F.least(right, ox + res * F.col("width")),
        "wy0": F.greatest(bottom, oy - res * F.col("height")), "wy1": F.least(top, oy)})
    w = w.filter((F.col("wx0") < F.col("wx1")) & (F.col("wy0") < F.col("wy1")))
    whole = lambda c: F.bround(c, 0).cast("int")
    return w.withColumns({
        "xoff": whole((F.col("wx0") - ox) / res), "yoff": whole((oy - F.col("wy1")) / res),
        "xsize": whole((F.col("wx1") - F.col("wx0")) / res), "ysize": whole((F.col("wy1") - F.col("wy0")) / res)})


def download_size(scenes: DataFrame, area_m2: float, bands: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Uncompressed bound per sensor: two bytes per pixel of every wanted band and of the mask."""

    def per_scene(sensor: str) -> float:
        wanted = (bands or {}).get(sensor) or [b for s, b, role, _, _ in B.BANDS if s == sensor and role != "mask"]
        res = {b: r for s, b, _, r, _ in B.BANDS if s == sensor}
        mask = {B.S2: 20, B.LANDSAT: 30}[sensor]
        return sum(area_m2 / res[b] ** 2 * 2 for b in wanted) + area_m2 / mask ** 2 * 2

    bytes_ = F.when(F.col("sensor") == B.S2, F.lit(per_scene(B.S2))).otherwise(F.lit(per_scene(B.LANDSAT)))
    return scenes.groupBy("sensor").agg(F.count(F.lit(1)).alias("n_scenes")).select(
        "sensor", "n_scenes", (bytes_ * F.col("n_scenes") / 1e9).alias("gigabytes"))


def counts(scenes: DataFrame) -> DataFrame:
    """Scenes per stage and sensor."""
    return scenes.groupBy("stage").pivot("sensor", [B.S2, B.LANDSAT]).count().fillna(0, [B.S2, B.LANDSAT])


def append_manifest(records: DataFrame, path: str) -> None:
    """Add records to the log: fixed columns as text, absent ones empty, others ignored."""
    have = set(records.columns)
    cols = [(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in MANIFEST]
    records.select(*cols).write.mode("append").csv(path, header=True, escape='"')


def read_manifest(spark, path: str) -> DataFrame:
    """Accepted scenes of a log, with the cycle and year of its folder (``<cycle>_<year>``)."""
    schema = ", ".join(f"`{c}` string" for c in MANIFEST)
    rows = spark.read.csv(path, header=True, schema=schema, escape='"')
    folder = F.element_at(F.split(F.regexp_replace(F.lit(path), "/+$", ""), "/"), -1)
    return rows.filter(F.col("status") == "ok").withColumns({
        "cycle": F.regexp_extract(folder, r"^(.+)_(\d+)$", 1),
        "year": F.regexp_extract(folder, r"^(.+)_(\d+)$", 2).try_cast("int")})


def define_grid(tiles: DataFrame, res: float) -> DataFrame:
    """The common grid: the most frequent reference system (the first seen on a tie) and its extent.

    ``tiles``: ord, crs, minx, miny, maxx, maxy. There are as many systems as map zones, so the
    second step is tiny.
    """
    per = tiles.groupBy("crs").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.min("minx").alias("minx"),
                                   F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    best = F.max_by(F.struct("crs", "minx", "miny", "maxx", "maxy"), F.struct("n", -F.col("first_ord"))).alias("b")
    one = per.agg(best, F.sort_array(F.collect_list("crs")).alias("all_crs"))
    low = lambda c: F.floor(F.col(c) / res) * res
    high = lambda c: F.ceil(F.col(c) / res) * res
    x0, y0, x1, y1 = low("b.minx"), low("b.miny"), high("b.maxx"), high("b.maxy")
    return one.select(
        F.col("b.crs").alias("crs"), F.lit(float(res)).alias("res"), x0.cast("double").alias("minx"), y1.cast("double").alias("maxy"),
        F.bround((x1 - x0) / res, 0).cast("int").alias("w"), F.bround((y1 - y0) / res, 0).cast("int").alias("h"),
        F.array_remove("all_crs", F.col("b.crs")).alias("other_crs"))
