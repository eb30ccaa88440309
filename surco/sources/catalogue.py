"""Satellite catalogue items (JSON pages of features) to typed scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType

from surco.functions import bands as B

# Source key -> (sensor, collection, how files are read); platforms accepted.
SOURCES = {
    "es-s2": (B.S2, "sentinel-2-c1-l2a", None),
    "pc-s2": (B.S2, "sentinel-2-l2a", "pc"),
    "pc-ls": (B.LANDSAT, "landsat-c2-l2", "pc"),
    "es-ls": (B.LANDSAT, "landsat-c2-l2", "aws-rp"),
}
LANDSAT_PLATFORMS = ("landsat-8", "landsat-9")
def _struct(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


# The parts of a catalogue page that are read. Coordinates stay text: their depth depends on the type.
TEXT, NUMBER = StringType(), DoubleType()
HREF = _struct(href=TEXT)
ASSET = _struct(**{
    "href": TEXT, "raster:bands": ArrayType(_struct(scale=NUMBER, offset=NUMBER)), "alternate": _struct(s3=HREF, https=HREF),
    "eo:bands": ArrayType(_struct(name=TEXT))})
PROPERTIES = _struct(**{
    "datetime": TEXT, "eo:cloud_cover": NUMBER, "platform": TEXT, "s2:mgrs_tile": TEXT, "mgrs:utm_zone": TEXT, "mgrs:latitude_band": TEXT,
    "mgrs:grid_square": TEXT, "grid:code": TEXT, "s2:datatake_id": TEXT, "s2:processing_baseline": TEXT, "processing:version": TEXT,
    "landsat:wrs_path": TEXT, "landsat:wrs_row": TEXT, "landsat:collection_category": TEXT})
PAGE = _struct(features=ArrayType(_struct(
    id=TEXT, collection=TEXT, geometry=_struct(type=TEXT, coordinates=TEXT), assets=MapType(TEXT, ASSET), properties=PROPERTIES)))


def outer_rings() -> Column:
    """The corners of the outer ring of each polygon of a footprint; other kinds of geometry are unknown (null)."""
    text, kind = F.col("geometry.coordinates"), F.col("geometry.type")
    polygons = F.when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>")).when(
        kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>")))
    return F.transform(polygons, lambda p: F.transform(F.get(p, F.lit(0)), lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))


def parse_pages(pages: DataFrame, text: str = "value", once: bool = False) -> DataFrame:
    """Features of catalogue pages. ``pages``: page (order), source, value (JSON text). ``once``: of the items of one id on one page, only
    the first, so that the rest is neither sorted nor sent."""
    parsed = pages.select("page", "source", F.from_json(text, PAGE).alias("p"))
    features = F.col("p.features")
    if once:
        parsed = parsed.select("page", "source", features.alias("f"), F.col("p.features.id").alias("ids"))
        features = F.filter("f", lambda item, i: F.array_position("ids", item["id"]) == i + 1)
    # the outer form: for the inner one Spark would parse once more to skip pages without items
    rows = parsed.select("page", "source", F.posexplode_outer(features).alias("pos", "item"))
    return rows.filter(F.col("item.id").isNotNull()).select("page", "pos", "source", "item.*")


def _prop(name: str) -> Column:
    return F.col(f"properties.`{name}`")


def _blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _id_part(i: int) -> Column:
    return F.get(F.split("id", "_"), F.lit(i))


def s2_tile() -> Column:
    """Grid square of an optical scene, from the first of five places that has it."""
    zone = F.when(_prop("mgrs:utm_zone").isNotNull(), F.concat(
        _prop("mgrs:utm_zone"), F.coalesce(_prop("mgrs:latitude_band"), F.lit("")), F.coalesce(_prop("mgrs:grid_square"), F.lit(""))))
    code = F.when(_prop("grid:code").startswith("MGRS-"), F.regexp_replace(_prop("grid:code"), "^MGRS-", ""))
    return F.coalesce(_blank(_prop("s2:mgrs_tile")), zone, code,
                      _blank(F.regexp_extract("id", r"_T(\d{2}[A-Z]{3})(_|$)", 1)), _id_part(1), F.lit("?"))


def landsat_tile() -> Column:
    """Path and row, three digits each."""
    path, row = _prop("landsat:wrs_path").try_cast("int"), _prop("landsat:wrs_row").try_cast("int")
    pair = F.concat(F.lpad(path.cast("string"), 3, "0"), F.lpad(row.cast("string"), 3, "0"))
    return F.coalesce(pair, _blank(F.regexp_extract("id", r"_(\d{6})_\d{8}_", 1)), F.lit("?"))


def baseline() -> Column:
    """Processing baseline (optical) or collection category (the other sensor); empty when unknown."""
    listed = F.coalesce(_prop("s2:processing_baseline"), _prop("processing:version"), F.lit(""))
    pattern = r"_N(\d{2})(\d{2})_"
    from_id = F.when(F.col("id").rlike(pattern), F.concat_ws(".", F.regexp_extract("id", pattern, 1), F.regexp_extract("id", pattern, 2)))
    return F.when(F.col("sensor") == B.S2, F.coalesce(_blank(listed), from_id, F.lit(""))).otherwise(
        F.coalesce(_prop("landsat:collection_category"), F.lit("")))


def short_platform(platform: Column) -> Column:
    low = F.lower(platform)
    return (F.when(low.startswith("sentinel-2"), F.concat(F.lit("S2"), F.upper(F.right(low, F.lit(1)))))
            .when(low.startswith("landsat-"), F.concat(F.lit("L"), F.get(F.split(low, "-"), F.lit(1))))
            .when(low == "", "?").otherwise(low))


def file_tag(sensor: Column, date: Column, tile: Column, platform: Column) -> Column:
    return F.concat_ws("_", F.when(sensor == B.S2, "S2").otherwise("LS"), F.replace(date, F.lit("-"), F.lit("")), tile, short_platform(platform))


def datatake() -> Column:
    """The pass a scene belongs to."""
    third = _id_part(2)
    named = F.when(F.contains(third, F.lit("T")) & (F.length(third) == 15), F.concat_ws("_", _id_part(0), third))
    by_day = F.concat_ws("_", "platform", "date")
    return F.when(F.col("sensor") == B.S2, F.coalesce(_blank(_prop("s2:datatake_id")), named, by_day)).otherwise(
        F.concat_ws("_", by_day, F.left("tile", F.lit(3))))


def band_list(sensor: str) -> Column:
    """The bands of a sensor as a constant array: band, keys in order, declared names, is it a mask."""
    return F.array(*[F.struct(
        F.lit(b).alias("band"), F.array(*[F.lit(k) for k in keys]).alias("keys"),
        F.array(*[F.lit(n) for n in sorted({b, b.replace("B0", "B")})]).alias("names"), F.lit(role == "mask").alias("mask"),
    ) for s, b, role, _, keys in B.BANDS if s == sensor])


def asset_key(band: Column) -> Column:
    """The asset of a band: the first listed key present, else one whose declared band name fits."""
    listed = F.get(F.filter(band["keys"], lambda k: F.map_contains_key("assets", k)), 0)
    none = F.array().cast("array<struct<name:string>>")

    def fits(k: Column, v: Column) -> Column:
        return ~F.lower(k).contains("jp2") & F.exists(
            F.coalesce(v["eo:bands"], none), lambda b: F.array_contains(band["names"], F.upper(b["name"])))

    return F.coalesce(listed, F.get(F.map_keys(F.map_filter("assets", fits)), 0))


def scale_offset(found: Column) -> tuple[Column, Column]:
    """Reflectance = number * scale + offset; an unknown optical baseline leaves the offset missing."""
    rb = F.get(found["asset"]["raster:bands"], 0)
    declared = rb["scale"].isNotNull() | rb["offset"].isNotNull()
    s2 = F.col("sensor") == B.S2
    number = F.col("baseline").try_cast("double")
    s2_offset = F.when(number >= 4.0, F.lit(B.S2_OFFSET_SINCE_4)).when(number.isNotNull(), F.lit(0.0))
    return (F.when(found["mask"], F.lit(1.0)).when(declared, F.coalesce(rb["scale"], F.lit(1.0)))
            .otherwise(F.when(s2, F.lit(B.S2_SCALE)).otherwise(F.lit(B.LANDSAT_SCALE))),
            F.when(found["mask"], F.lit(0.0)).when(declared, F.coalesce(rb["offset"], F.lit(0.0)))
            .otherwise(F.when(s2, s2_offset).otherwise(F.lit(B.LANDSAT_OFFSET))))


def href(asset: Column, auth: Column) -> Column:
    """Requester-pays sources read the bucket address; the others prefer plain https over a bucket."""
    own, s3, https = asset["href"], asset["alternate"]["s3"]["href"], asset["alternate"]["https"]["href"]
    pays = F.when(own.startswith("s3://"), own).otherwise(F.coalesce(s3, own))
    plain = F.when(own.startswith("s3://") & https.isNotNull(), https).otherwise(own)
    return F.when(auth.eqNullSafe(F.lit("aws-rp")), pays).otherwise(plain)


def scenes(items: DataFrame) -> DataFrame:
    """Typed scenes: one row per item, bands resolved to assets, absent bands listed."""
    rows = items.withColumns({
        "sensor": _by_source(0), "auth": _by_source(2), "collection": F.coalesce("collection", _by_source(1)),
        "datetime": F.coalesce(_prop("datetime"), F.lit(""))})
    rows = rows.withColumns({
        "date": F.left("datetime", F.lit(10)), "platform": F.coalesce(_prop("platform"), F.lit("")),
        "tile": F.when(F.col("sensor") == B.S2, s2_tile()).otherwise(landsat_tile()), "baseline": baseline(),
        "cloud_tile": _prop("eo:cloud_cover")})
    rows = rows.withColumn("datatake", datatake())

    # each step looks at the result of the one before, so a key is searched once per band
    catalogue = F.when(F.col("sensor") == B.S2, band_list(B.S2)).otherwise(band_list(B.LANDSAT))
    keyed = F.transform(catalogue, lambda b: F.struct(b["band"].alias("band"), b["mask"].alias("mask"), asset_key(b).alias("key")))
    located = F.transform(keyed, lambda b: F.struct(
        b["band"].alias("band"), b["mask"].alias("mask"), b["key"].alias("key"), F.try_element_at("assets", b["key"]).alias("asset")))

    def finish(b: Column) -> Column:
        scale, offset = scale_offset(b)
        return F.struct(b["band"].alias("band"), b["key"].alias("key"), href(b["asset"], F.col("auth")).alias("href"),
                        scale.alias("scale"), offset.alias("offset"))

    return rows.select(
        "page", "pos", "source", "sensor", "auth", "collection", "id", "datetime", "date", "tile", "platform", "baseline",
        "cloud_tile", "datatake",
        outer_rings().alias("footprint"),
        F.transform(F.filter(located, lambda b: b["key"].isNotNull()), finish).alias("bands"),
        F.transform(F.filter(keyed, lambda b: b["key"].isNull()), lambda b: b["band"]).alias("missing"))


def _by_source(i: int) -> Column:
    out = F.lit(None).cast("string")
    for key, value in SOURCES.items():
        if value[i] is not None:
            out = F.when(F.col("source") == key, F.lit(value[i])).otherwise(out)
    return out
