"""Polygons against the pixel grid, by scan lines.

A polygon meets the centre line of a grid row in a few crossings; sorted, they pair up into
spans of pixels that lie inside (the even-odd rule). Spans are cut at block borders and join
the pixels on (row, block), so no pixel is ever compared with a polygon it cannot touch and
no geometry library is needed. All coordinates share one projected reference system.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64  # columns per block


def edges(vertices: DataFrame, keys: Sequence[str] = ("zone_id",)) -> DataFrame:
    """Edge table from vertices in ring order; each ring closes on its first vertex."""
    ring = [*keys, "ring_id"]
    order = Window.partitionBy(*ring).orderBy("v_ord")
    nxt = {c: F.coalesce(F.lead(c).over(order), F.first(c).over(order)) for c in ("x", "y")}
    return vertices.select(*ring, F.col("x").alias("x1"), F.col("y").alias("y1"), nxt["x"].alias("x2"), nxt["y"].alias("y2"))


def spans(edge_rows: DataFrame, res: float, keys: Sequence[str] = ("zone_id",), x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Inside intervals [xa, xb) of each polygon on each grid row whose centre line it crosses.

    Row r has its centre at y0 + (r + 0.5) * res. An edge covers its lower end, not its upper
    one, so a vertex on a centre line counts once.
    """
    e = edge_rows.filter(F.col("y1") != F.col("y2")).withColumns({"lo": F.least("y1", "y2"), "hi": F.greatest("y1", "y2")})
    first = F.ceil((F.col("lo") - y0) / res - 0.5)
    last = F.ceil((F.col("hi") - y0) / res - 0.5) - 1
    rows = e.withColumns({"r0": first, "r1": last}).filter(F.col("r0") <= F.col("r1")).select(
        *keys, "x1", "y1", "x2", "y2", F.explode(F.sequence("r0", "r1")).alias("fila"))
    yc = F.lit(y0) + (F.col("fila") + 0.5) * res
    cross = F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    # crossings of one polygon with one row: as many as its outline folds there
    w = Window.partitionBy(*keys, "fila").orderBy("cx")
    pairs = rows.withColumn("cx", cross).withColumns({"i": F.row_number().over(w), "xb": F.lead("cx").over(w)})
    return pairs.filter((F.col("i") % 2 == 1) & F.col("xb").isNotNull()).select(*keys, "fila", F.col("cx").alias("xa"), "xb")


def cells(span_rows: DataFrame, res: float, keys: Sequence[str] = ("zone_id",), x0: float = 0.0) -> DataFrame:
    """Column ranges of the pixels whose centre lies in a span, cut at block borders."""
    first = F.ceil((F.col("xa") - x0) / res - 0.5)
    last = F.ceil((F.col("xb") - x0) / res - 0.5) - 1
    r = span_rows.withColumns({"c0": first, "c1": last}).filter(F.col("c0") <= F.col("c1"))
    blocks = F.sequence(F.floor(F.col("c0") / BLOCK), F.floor(F.col("c1") / BLOCK))
    return r.select(*keys, F.col("fila").cast("int").alias("fila"), "c0", "c1", F.explode(blocks).alias("block"))


def point_in_polygon(pixels: DataFrame, edge_rows: DataFrame, res: float, keys: Sequence[str] = ("zone_id",),
                     x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(pixel columns, keys) for every pixel whose centre a polygon holds. Pixels need fila and col."""
    c = cells(spans(edge_rows, res, keys, x0, y0), res, keys, x0)
    p = pixels.withColumn("block", F.floor(F.col("col") / BLOCK))
    return p.join(c, ["fila", "block"]).filter(F.col("col").between(F.col("c0"), F.col("c1"))).drop("block", "c0", "c1")


def burn(pixels: DataFrame, edge_rows: DataFrame, res: float, id_col: str = "zone_id", order_col: str | None = None,
         name: str = "zone") -> DataFrame:
    """The polygon of every pixel; a later one overwrites an earlier one; outside is 0."""
    keys = [id_col] if order_col in (None, id_col) else [id_col, order_col]
    hits = point_in_polygon(pixels.select("px_id", "fila", "col"), edge_rows, res, keys)
    best = hits.groupBy("px_id").agg(F.max_by(id_col, order_col or id_col).alias(name))
    return pixels.join(best, "px_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def district_codes(districts: DataFrame) -> DataFrame:
    """Codes 1..n in order of district id (a handful of districts)."""
    ids = districts.select("zone_id").distinct()
    everyone = ids.agg(F.sort_array(F.collect_list("zone_id")).alias("ids"))
    return ids.select("zone_id", F.array_position(everyone.scalar(), F.col("zone_id")).cast("int").alias("district"))


def pixel_zones(pixels: DataFrame, municipality_edges: DataFrame, district_edges: DataFrame, res: float) -> DataFrame:
    """Municipality and irrigation-district code of every pixel."""
    codes = district_codes(district_edges)
    coded = district_edges.join(codes, "zone_id").drop("zone_id").withColumnRenamed("district", "zone_id")
    return burn(burn(pixels, municipality_edges, res, name="mun"), coded, res, name="district")


def zone_counts(zoned: DataFrame) -> DataFrame:
    """Pixels per municipality and per district."""
    entries = F.array(F.struct(F.lit("municipio").alias("layer"), F.col("mun").alias("code")),
                      F.struct(F.lit("distrito").alias("layer"), F.col("district").alias("code")))
    return zoned.select(F.inline(entries)).filter(F.col("code") != 0).groupBy("layer", "code").agg(F.count(F.lit(1)).alias("pixels"))


def zone_shares(area_pixels: DataFrame, keys: Sequence[str] = ("area_id",)) -> DataFrame:
    """Shares of a study area: per municipality, in any district, outside every municipality.

    ``area_pixels``: keys, mun, district for each of its pixels (shares of pixel centres).
    """
    per = area_pixels.groupBy(*keys, "mun").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("district") > 0).alias("n_district"))
    whole = Window.partitionBy(*keys)  # as many rows as municipalities the area meets
    total = F.sum("n").over(whole)
    return per.select(
        *keys, "mun", (F.col("n") / total).alias("share"), (F.sum("n_district").over(whole) / total).alias("district_share"),
        (F.coalesce(F.sum(F.when(F.col("mun") == 0, F.col("n"))).over(whole), F.lit(0)) / total).alias("outside"),
    ).filter(F.col("mun") != 0)


def suggest_profile(area_pixels: DataFrame, profiles: DataFrame, names: DataFrame, keys: Sequence[str] = ("area_id",),
                    state: str = "Tamaulipas") -> DataFrame:
    """The official profile of each study area, its regime and warnings.

    The municipality with the largest share wins; irrigated when half of the area is in districts. ``names``
    (cvegeo, municipio) gives the municipality that a warning names.
    """
    shares = zone_shares(area_pixels, keys)
    areas = area_pixels.groupBy(*keys).agg((F.count_if(F.col("district") > 0) / F.count(F.lit(1))).alias("dr"),
                                           (F.count_if(F.col("mun") == 0) / F.count(F.lit(1))).alias("out"))
    best = shares.groupBy(*keys).agg(F.max_by("mun", F.struct("share", -F.col("mun"))).alias("mun"),
                                     F.count_if(F.col("share") >= 0.1).alias("large"))
    j = areas.join(best, list(keys), "left").withColumns({
        "modalidad": F.when(F.col("mun").isNotNull(), F.when(F.col("dr") >= 0.5, "riego").otherwise("temporal")),
        "cvegeo": F.lpad(F.col("mun").cast("string"), 5, "0")})
    # several profiles of one (municipality, regime): the first by name
    known = profiles.groupBy("cvegeo", "modalidad").agg(F.min("profile").alias("profile"))
    j = j.join(known, ["cvegeo", "modalidad"], "left").join(names.groupBy("cvegeo").agg(F.min("municipio").alias("mun_name")), "cvegeo", "left")
    pct = lambda c: F.bround(100 * c, 0).cast("int").cast("string")
    warnings = F.when(F.col("mun").isNull(), F.array(F.lit(f"fuera de {state}"))).otherwise(F.array_compact(F.array(
        F.when(F.col("large") > 1, "la zona pilla varios municipios"),
        F.when((F.col("dr") > 0.2) & (F.col("dr") < 0.8), F.concat(F.lit("la zona mezcla distrito de riego ("), pct(F.col("dr")), F.lit(" %) y fuera"))),
        F.when(F.col("out") > 0.05, F.concat(pct(F.col("out")), F.lit(f" % de la zona cae fuera de {state}"))),
        F.when(F.col("profile").isNull(), F.concat(F.lit("no hay perfil del SIAP para "), F.coalesce("mun_name", "cvegeo"), F.lit(" ("), "modalidad", F.lit(")"))))))
    return j.select(*keys, "cvegeo", "modalidad", "profile", F.col("dr").alias("district_share"), F.col("out").alias("outside"),
                    warnings.alias("warnings"))


def polygon_area(edge_rows: DataFrame, keys: Sequence[str] = ("zone_id",)) -> DataFrame:
    """Area of each polygon from its edges."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return edge_rows.groupBy(*keys).agg((F.abs(twice) / 2).alias("area_m2"))


def _distance(px: Column, py: Column) -> Column:
    """Distance from a point to the segment (x1, y1)-(x2, y2)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length2 = dx * dx + dy * dy
    t = F.coalesce(F.try_divide((px - F.col("x1")) * dx + (py - F.col("y1")) * dy, length2), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (F.col("x1") + t * dx), py - (F.col("y1") + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def near_edges(points: DataFrame, edge_rows: DataFrame, distance: float, key: str) -> DataFrame:
    """(key, px_id) of points closer than ``distance`` to an edge of their own polygon.

    Edges are cut into cells as wide as they need be checked, so only points of the same cell
    meet them; interior points meet none.
    """
    size = float(max(distance, 1.0)) * 4
    lo = lambda a, b: F.floor((F.least(a, b) - distance) / size)
    hi = lambda a, b: F.floor((F.greatest(a, b) + distance) / size)
    by_x = edge_rows.select("*", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2"))).alias("gx"))
    # along each column of cells, only the part of the edge inside it
    dx = F.col("x2") - F.col("x1")
    left, right = F.col("gx") * size - distance, (F.col("gx") + 1) * size + distance
    at = lambda x: F.col("y1") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - F.col("x1"), dx))) * (F.col("y2") - F.col("y1"))
    upright = dx == 0
    ya, yb = F.when(upright, F.col("y1")).otherwise(at(left)), F.when(upright, F.col("y2")).otherwise(at(right))
    boxed = by_x.select(key, "x1", "y1", "x2", "y2", "gx", F.explode(F.sequence(lo(ya, yb), hi(ya, yb))).alias("gy"))
    placed = points.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})
    return placed.join(boxed, [key, "gx", "gy"]).filter(_distance(F.col("x"), F.col("y")) < distance).select(key, "px_id").distinct()
