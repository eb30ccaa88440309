"""Class maps on the pixel grid: majority filter, areas, change of resolution, rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("maiz", "sorgo", "otros")


def majority3x3(classes: DataFrame, nodata: int = 0) -> DataFrame:
    """3x3 majority of (fila, col, clase): no-data neither votes nor changes; a tie keeps the centre.

    Each pixel sends its vote to its nine neighbours and votes are counted per (cell, class),
    so there is one shuffle and no halo. Otherwise the smallest class among the most voted wins.
    """
    shifts = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    votes = classes.filter(F.col("clase") != nodata).select("fila", "col", "clase", F.inline(shifts)).select(
        (F.col("fila") + F.col("di")).alias("fila"), (F.col("col") + F.col("dj")).alias("col"), "clase",
        ((F.col("di") == 0) & (F.col("dj") == 0)).alias("centre"))
    counted = votes.groupBy("fila", "col", "clase").agg(F.count(F.lit(1)).alias("n"), F.max("centre").alias("own"))
    best = counted.groupBy("fila", "col").agg(
        F.max("own").alias("valid"), F.max_by("clase", F.struct("n", "own", -F.col("clase"))).alias("majority"))
    # a cell without its own vote is no-data or outside the map
    kept = classes.filter(F.col("clase") == nodata).select("fila", "col", "clase")
    return best.filter("valid").select("fila", "col", F.col("majority").alias("clase")).unionByName(kept)


def class_areas(classes: DataFrame, px_km2: float) -> DataFrame:
    """Pixels and square kilometres per class, and pixels without data."""
    label = F.coalesce(F.get(F.array(*[F.lit(c) for c in ("nodata", *CLASSES)]), F.col("clase")), F.lit("nodata"))
    return classes.groupBy(label.alias("clase")).agg(F.count(F.lit(1)).alias("pixels")).withColumn(
        "km2", F.when(F.col("clase") != "nodata", F.col("pixels") * px_km2))


def coarsen(values: DataFrame, factor: int, value: str = "valor", mask: str = "scl") -> DataFrame:
    """Finer to coarser: mean of the values present; most frequent mask code (smallest on a tie)."""
    cell = [F.floor(F.col("fila") / factor).cast("int").alias("fila"), F.floor(F.col("col") / factor).cast("int").alias("col")]
    codes = values.select(*cell, value, mask).groupBy("fila", "col", mask).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.count(value).alias("k"))
    return codes.groupBy("fila", "col").agg(
        F.try_divide(F.sum("s"), F.sum("k")).alias(value), F.max_by(mask, F.struct("n", -F.col(mask))).alias(mask))


def refine(values: DataFrame, factor: int, value: str = "valor", mask: str = "scl") -> DataFrame:
    """Coarser to finer: bilinear values, nearest mask code.

    Each coarse cell sends its weighted value to the fine cells within one coarse cell of it and
    the weights present are normalised, so there is one shuffle and no neighbour join.
    """
    reach = F.sequence(F.lit(-factor), F.lit(2 * factor - 1))
    fine = values.select("fila", "col", value, mask, F.explode(reach).alias("i")).select("*", F.explode(reach).alias("j"))
    fila, col = F.col("fila") * factor + F.col("i"), F.col("col") * factor + F.col("j")

    def weight(offset: str) -> Column:
        return 1 - F.abs((F.col(offset) + 0.5) / factor - 0.5)

    w = F.greatest(weight("i"), F.lit(0.0)) * F.greatest(weight("j"), F.lit(0.0))
    own = F.col("i").between(0, factor - 1) & F.col("j").between(0, factor - 1)
    sent = fine.select(fila.alias("fila"), col.alias("col"), w.alias("w"), F.col(value).alias("v"), F.when(own, F.col(mask)).alias("m"), own.alias("own"))
    sent = sent.filter((F.col("w") > 0) | F.col("own"))
    return sent.groupBy("fila", "col").agg(
        F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum(F.when(F.col("v").isNotNull(), F.col("w")))).alias(value),
        F.max("m").alias(mask), F.max("own").alias("inside")).filter("inside").drop("inside")


def resample(values: DataFrame, res_from: float, res_to: float, shift_x: float = 0.0, shift_y: float = 0.0, value: str = "valor",
             mask: str = "scl") -> DataFrame:
    """To a finer grid of any resolution and origin: bilinear values, nearest mask code.

    ``shift_x`` and ``shift_y``: how far the new grid begins to the right of and below the old one. Every cell sends its
    value to the new cells whose centre lies less than one old cell from its own, and its mask code to those whose centre it holds;
    the weights present are normalised. New cells outside the old grid are left out.
    """
    if res_to > res_from:
        raise ValueError("the new grid must be the finer one; coarsen takes the other way")

    def reached(index: str, shift: float) -> Column:
        first, last = ((F.col(index) + d) * res_from - shift for d in (-0.5, 1.5))
        return F.explode(F.sequence(F.ceil(first / res_to - 0.5).cast("int"), F.floor(last / res_to - 0.5).cast("int")))

    def centre(index: str, shift: float) -> Column:  # of the new cell, in old cells
        return ((F.col(index) + 0.5) * res_to + shift) / res_from

    spread = values.select("fila", "col", value, mask, reached("fila", shift_y).alias("f")).select("*", reached("col", shift_x).alias("c"))
    y, x = centre("f", shift_y), centre("c", shift_x)
    weight = F.greatest(1 - F.abs(y - 0.5 - F.col("fila")), F.lit(0.0)) * F.greatest(1 - F.abs(x - 0.5 - F.col("col")), F.lit(0.0))
    own = (F.floor(y) == F.col("fila")) & (F.floor(x) == F.col("col"))
    sent = spread.select(F.col("f").alias("fila"), F.col("c").alias("col"), weight.alias("w"), F.col(value).alias("v"), F.when(own, F.col(mask)).alias("m"), own.alias("own"))
    return sent.filter((F.col("w") > 0) | F.col("own")).groupBy("fila", "col").agg(
        F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum(F.when(F.col("v").isNotNull(), F.col("w")))).alias(value),
        F.max("m").alias(mask), F.max("own").alias("inside")).filter("inside").drop("inside")


def rule_map(features: DataFrame, variable: str, threshold: float, direction: str) -> DataFrame:
    """1 where the rule holds, 0 where not, missing without data."""
    hit = F.col(variable) > threshold if direction == ">" else F.col(variable) <= threshold
    return features.withColumn("rule", F.when(F.col(variable).isNotNull(), hit.cast("int")))


def rule_area(ruled: DataFrame, px_km2: float) -> DataFrame:
    return ruled.agg((F.count_if(F.col("rule") == 1) * px_km2).alias("km2"))


def mapped_areas(zoned: DataFrame, px_ha: float) -> DataFrame:
    """Hectares per (municipality, regime, class) and classified hectares per municipality.

    ``zoned``: mun, district, clase. The coverage counts any class and ignores the regime, so
    both come from one pass with grouping sets. Rows with regime NULL carry the coverage.
    """
    rows = zoned.filter((F.col("mun") > 0) & (F.col("clase") > 0)).select(
        F.lpad(F.col("mun").cast("string"), 5, "0").alias("cvegeo"),
        F.when(F.col("district") > 0, "riego").otherwise("temporal").alias("modalidad"), "clase")
    aggs = [(F.count_if(F.col("clase") == i) * px_ha).alias(f"{c}_ha") for i, c in enumerate(CLASSES, 1)]
    both = [[F.col("cvegeo"), F.col("modalidad")], [F.col("cvegeo")]]
    return rows.groupingSets(both, F.col("cvegeo"), F.col("modalidad")).agg(
        *aggs, (F.count(F.lit(1)) * px_ha).alias("covered_ha"), F.grouping("modalidad").cast("int").alias("is_total"))


def map_vs_official(areas: DataFrame, official: DataFrame, municipality_ha: DataFrame, cut: DataFrame,
                    crops: Sequence[tuple[str, str]] = (("maiz", "Maíz grano"), ("sorgo", "Sorgo grano")),
                    min_cover: float = 0.9) -> DataFrame:
    """Mapped and official hectares per municipality and regime; a ratio only where the map covers enough.

    ``areas``: from ``mapped_areas``; ``official``: cvegeo, modalidad, cultivo, sembrada;
    ``cut``: one row and column, the latest cut. Totals add the rounded parts.
    """
    mapped = areas.filter("is_total = 0").select("cvegeo", "modalidad", *[f"{c}_ha" for c, _ in crops])
    stated = official.filter(F.col("cultivo").isin(*[n for _, n in crops])).groupBy("cvegeo", "modalidad").agg(
        *[F.sum(F.when(F.col("cultivo") == n, F.col("sembrada"))).alias(f"o_{c}") for c, n in crops])
    cover = areas.filter("is_total = 1").select("cvegeo", "covered_ha")
    j = mapped.join(stated, ["cvegeo", "modalidad"], "full").join(cover, "cvegeo", "left").join(municipality_ha, "cvegeo", "left")
    one = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)), 1)
    j = j.withColumns({**{f"mapa_{c}_ha": one(f"{c}_ha") for c, _ in crops}, **{f"siap_{c}_ha": one(f"o_{c}") for c, _ in crops}})
    total = lambda side: F.bround(sum((F.col(f"{side}_{c}_ha") for c, _ in crops), F.lit(0.0)), 1)
    share = F.coalesce(F.try_divide("covered_ha", "area_ha"), F.lit(0.0))
    j = j.withColumns({"mapa_total_ha": total("mapa"), "siap_total_ha": total("siap"), "share": share})
    ratio = F.when((F.col("siap_total_ha") > 0) & (F.col("share") >= min_cover), F.bround(F.col("mapa_total_ha") / F.col("siap_total_ha"), 3))
    return j.withColumn("corte_siap", cut.scalar()).select(
        "cvegeo", "modalidad", "corte_siap", *[f"{s}_{c}_ha" for c, _ in crops for s in ("mapa", "siap")],
        "mapa_total_ha", "siap_total_ha", F.bround(100 * F.col("share"), 1).alias("cobertura_pct"), ratio.alias("cociente"))
