"""Training samples: pixels under labelled polygons and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surco.functions.text import class_guess
from surco.operators import covering
from surco.operators import zones as Z
from surco.operators.raster import CLASSES
from surco.operators.ranks import first_n
from surco.session import written_once

HEADER = ("grupo", "clase", "fila", "col")


def class_mapping(labels: DataFrame, label: str = "etiqueta") -> DataFrame:
    """The distinct label values, each with its guessed class (the mapping table a user edits)."""
    return labels.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("value")).distinct().withColumn("clase", class_guess(F.col("value")))


def extract(pixels: DataFrame, vertices: DataFrame, mapping: DataFrame, res: float, inner_buffer: float = 10.0,
            point_radius: float = 0.0, max_per_group: int | None = None, seed: int = 0, far_borders: bool = False) -> DataFrame:
    """(px_id, fila, col, grupo, clase) of the pixels each labelled field takes.

    ``vertices``: field_ord, grupo, kind ('polygon' or 'point'), etiqueta, ring_id, v_ord, x, y.
    A polygon takes the pixels whose centre it holds at least ``inner_buffer`` from its outline; a
    point those within its radius. A field that takes none gets every cell that it, shrunk, touches and nobody
    else has (``far_borders``: as ``covering.touched_by_discs`` takes it). Later fields overwrite earlier ones.
    """
    grid = pixels.select("px_id", "fila", "col", "x", "y")
    known = _known(vertices, mapping)
    taken = _taken(grid, known, res, inner_buffer, point_radius)
    left = known.select("field_ord").distinct().join(taken.select("field_ord").distinct(), "field_ord", "left_anti")
    spare = grid.join(_touched(known.join(left, "field_ord", "left_semi"), res, inner_buffer, point_radius, far_borders), ["fila", "col"]).join(
        taken.select("px_id"), "px_id", "left_anti")
    extra = spare.groupBy("px_id").agg(F.max("field_ord").alias("field_ord"))
    info = known.groupBy("field_ord").agg(F.first("grupo").alias("grupo"), F.first("clase").alias("clase"))
    out = taken.unionByName(extra).join(info, "field_ord").join(grid.select("px_id", "fila", "col"), "px_id")
    out = out.select("px_id", "fila", "col", "grupo", "clase")
    return cap(out, ["grupo"], max_per_group, seed) if max_per_group else out


def _known(vertices: DataFrame, mapping: DataFrame) -> DataFrame:
    return vertices.join(mapping.select(F.col("value").alias("etiqueta"), "clase"), "etiqueta").filter(F.col("clase").isin(*CLASSES))


def _radius(res: float, point_radius: float) -> float:
    return max(point_radius, res * 0.01)


def _taken(grid: DataFrame, known: DataFrame, res: float, inner_buffer: float, point_radius: float) -> DataFrame:
    """(px_id, field_ord) of the pixels whose centre a field holds, written once."""
    outline = Z.edges(known.filter("kind = 'polygon'"), ("field_ord",))
    inside = Z.point_in_polygon(grid, outline, res, ("field_ord",)).select("field_ord", "px_id", "x", "y")
    if inner_buffer > 0:
        inside = written_once(inside)  # read by both sides of the buffer test
        inside = inside.join(Z.near_edges(inside, outline, inner_buffer, "field_ord"), ["field_ord", "px_id"], "left_anti")
    radius = _radius(res, point_radius)
    spots = known.filter("kind = 'point'").select("field_ord", "x", "y")
    under = grid.join(covering.touched_by_discs(spots, res, radius).join(spots.toDF("field_ord", "px", "py"), "field_ord"), ["fila", "col"])
    near = under.filter(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= radius)
    hits = inside.select("field_ord", "px_id").unionByName(near.select("field_ord", "px_id"))
    return written_once(hits.groupBy("px_id").agg(F.max("field_ord").alias("field_ord")))


def _touched(fields: DataFrame, res: float, inner_buffer: float, point_radius: float, far_borders: bool = False) -> DataFrame:
    outline = Z.edges(fields.filter("kind = 'polygon'"), ("field_ord",))
    spots = fields.filter("kind = 'point'").select("field_ord", "x", "y")
    return covering.touched_by_polygons(outline, res, inner_buffer).unionByName(covering.touched_by_discs(spots, res, _radius(res, point_radius), far_borders))


def extract_report(vertices: DataFrame, mapping: DataFrame, taken: DataFrame, res: float, inner_buffer: float = 10.0, point_radius: float = 0.0) -> DataFrame:
    """How many fields were given, ignored by class, shrank to nothing, or ended without a pixel (off the grid, or all taken by others).

    ``taken`` is what ``extract`` gave with the same settings, before any cap.
    """
    fields = vertices.select("field_ord", "grupo", "etiqueta").distinct().join(
        mapping.select(F.col("value").alias("etiqueta"), "clase"), "etiqueta", "left")
    got = taken.select("grupo").distinct().withColumn("hit", F.lit(1))
    known = F.coalesce(F.col("clase").isin(*CLASSES), F.lit(False))
    found = written_once(fields.join(got, "grupo", "left").select("field_ord", known.alias("known"), F.col("hit").isNotNull().alias("hit")))
    lone = _known(vertices, mapping).join(found.filter("known AND NOT hit"), "field_ord", "left_semi")
    something = _touched(lone, res, inner_buffer, point_radius).select("field_ord").distinct().withColumn("some", F.lit(1))
    lost = F.col("known") & ~F.col("hit")
    return found.join(something, "field_ord", "left").agg(
        F.count(F.lit(1)).alias("features"), F.count_if(~F.col("known")).alias("ignored_class"),
        F.count_if(lost & F.col("some").isNull()).alias("empty_after_buffer"), F.count_if(lost & F.col("some").isNotNull()).alias("outside"))


def cap(samples: DataFrame, keys: Sequence[str], n: int, seed: int = 0, id_col: str = "px_id") -> DataFrame:
    """At most ``n`` rows of each group, in the order of a seeded hash (this cap is the feature)."""
    return first_n(samples, keys, [F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), F.col(id_col)], n)


def summary(samples: DataFrame, few: int = 10) -> DataFrame:
    """Pixels and distinct fields per class; classes with few fields are flagged."""
    per_field = samples.groupBy("clase", "grupo").agg(F.count(F.lit(1)).alias("n"))
    return per_field.groupBy("clase").agg(F.sum("n").alias("pixels"), F.count(F.lit(1)).alias("fields")).withColumn(
        "few_fields", (F.col("fields") < few).cast("int"))


def save_csv(samples: DataFrame, names: Sequence[str], path: str) -> None:
    """Samples as text: six significant digits, blanks for missing."""
    def text(c: str):
        digits = F.lit(5) - F.floor(F.log10(F.abs(F.col(c)))).cast("int")
        scale = F.pow(F.lit(10.0), digits)
        return F.when(F.col(c) == 0, "0").otherwise((F.bround(F.col(c) * scale, 0) / scale).cast("string")).alias(c)

    samples.select(*HEADER, *[text(n) for n in names]).write.csv(path, header=True, escape='"')


def load_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Samples from text: blanks are missing, a missing row or column is -1."""
    schema = ", ".join([f"`{h}` string" for h in HEADER] + [f"`{n}` string" for n in names])
    raw = spark.read.csv(path, header=True, schema=schema, escape='"')
    place = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")).try_cast("int"), F.lit(-1)).alias(c)
    return raw.select("grupo", "clase", place("fila"), place("col"),
                      *[F.nullif(F.trim(n), F.lit("")).try_cast("double").alias(n) for n in names])
