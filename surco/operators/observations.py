"""Pixel observations: masks, reflectance, tile merging, indices, scene screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surco.functions import bands as B

OBS_KEY = ("sensor", "px_id", "obs_date")


def to_reflectance(dn: DataFrame, roles: Sequence[str] = B.ROLES, scale: float | None = None, offset: float = 0.0,
                   scl=B.VARIABLE_SCL) -> DataFrame:
    """``dn_<role>`` columns to reflectance, missing where not clear or without data.

    A table that carries ``scale_<role>`` / ``offset_<role>`` columns is scaled by them; otherwise ``scale`` must be given.
    """
    unscaled = [r for r in roles if f"scale_{r}" not in dn.columns]
    if scale is None and unscaled:
        raise ValueError(f"no scale for {', '.join(unscaled)}")
    clear = B.clear_for_variables(F.col("sensor"), F.col("mask"), scl)

    def pick(kind: str, role: str, default: float) -> Column:
        return F.col(f"{kind}_{role}") if f"{kind}_{role}" in dn.columns else F.lit(default)

    kept = [c for c in dn.columns if not c.startswith(("dn_", "scale_", "offset_"))]
    return dn.select(
        *kept,
        *[B.reflectance(F.col(f"dn_{r}"), pick("scale", r, scale), pick("offset", r, offset), clear).alias(r)
          for r in roles],
    )


def tile_first_valid(tiles: DataFrame, roles: Sequence[str] = B.ROLES) -> DataFrame:
    """Merge the tiles of a (sensor, pixel, date): per band the first value present, by tile order.

    Plain aggregates, so each task merges its own tiles before the shuffle; afterwards a
    pixel holds at most one row per date however many tiles it had.
    """
    order = F.col("tile_ord")
    extra = [F.min_by("stage", order).alias("stage")] if "stage" in tiles.columns else []
    return tiles.groupBy(*OBS_KEY).agg(
        *extra, *[F.min_by(F.col(r), F.when(F.col(r).isNotNull(), order)).alias(r) for r in roles]
    )


def mosaic_groups(files: DataFrame) -> DataFrame:
    """Per (sensor, date, resolution): can its tiles be shown as one mosaic?"""
    return (
        files.groupBy("sensor", "obs_date", "res")
        .agg(F.countDistinct("tile").alias("n_tiles"), F.countDistinct("crs").alias("n_crs"))
        .filter(F.col("n_tiles") >= 2)
        .withColumn("status", F.when(F.col("n_crs") == 1, "mosaic").otherwise("several_crs"))
    )


def mosaic(tiles: DataFrame, values: Sequence[str]) -> DataFrame:
    """Mosaics of the (sensor, date) groups that allow one; needs tile, crs and res per row."""
    good = mosaic_groups(tiles).filter(F.col("status") == "mosaic").select("sensor", "obs_date", "res")
    # one row per sensor, date and resolution: the season's dates bound it
    return mosaic_pixels(tiles.join(F.broadcast(good), ["sensor", "obs_date", "res"], "left_semi"), values)


def mosaic_pixels(tiles: DataFrame, values: Sequence[str]) -> DataFrame:
    """Overlay tiles in order: the last tile with data shows (0 is no data; 1 for the bit mask)."""

    def present(name: str) -> Column:
        nodata = F.when((F.col("sensor") != B.S2) & (F.lit(name) == "mask"), F.lit(1)).otherwise(F.lit(0))
        return F.col(name) != nodata

    return tiles.groupBy(*OBS_KEY).agg(
        *[F.max_by(F.col(v), F.when(present(v), F.col("tile_ord"))).alias(v) for v in values]
    )


def add_indices(obs: DataFrame, names: Sequence[str] = B.INDICES) -> DataFrame:
    return obs.withColumns({n: B.index_column(n, F.col("sensor")) for n in names})


def available_variables(dn: DataFrame) -> DataFrame:
    """Per sensor, the bands and indices a run can emit (a role counts if any tile has it)."""
    roles = [c[3:] for c in dn.columns if c.startswith("dn_")]
    seen = dn.groupBy("sensor").agg(*[F.max(F.col(f"dn_{r}").isNotNull()).alias(r) for r in roles])

    def index_ok(name: str) -> Column:
        ok = F.lit(False)
        for sensor, need in B.INDEX_ROLES[name].items():
            if set(need) <= set(roles):
                every = F.lit(True)
                for r in need:
                    every = every & F.col(r)
                ok = ok | ((F.col("sensor") == sensor) & every)
        return ok

    entries = [F.when(F.col(r), F.lit(r)) for r in roles] + [F.when(index_ok(n), F.lit(n)) for n in B.INDICES]
    usable = (F.col("nir") & F.col("red")).cast("int").alias("curve_ready")
    return seen.select("sensor", usable, F.explode(F.array_compact(F.array(*entries))).alias("variable"))


def scene_cover_clear(mask_rows: DataFrame, polygon_px: float | None = None) -> DataFrame:
    """Cover and clear share per scene from its mask pixels inside the study area.

    ``mask_rows``: scene_id, sensor, mask. Counting per (scene, code) first leaves at most a
    few codes per scene, whatever the number of pixels.
    """
    sensor, mask = F.col("sensor"), F.col("mask")
    data = B.has_data(sensor, mask)
    clear = B.clear_for_screening(sensor, mask) & data
    codes = mask_rows.groupBy("scene_id", "sensor", "mask").agg(F.count(F.lit(1)).alias("n"))
    stats = codes.groupBy("scene_id", "sensor").agg(
        F.sum("n").alias("n_px"),
        F.sum(F.when(data, F.col("n")).otherwise(0)).alias("n_data"),
        F.sum(F.when(clear, F.col("n")).otherwise(0)).alias("n_clear"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("mask", "n")))).alias("codes"),
    )
    size = F.greatest(F.lit(polygon_px or 0.0), F.col("n_px").cast("double"))
    two = F.create_map(F.lit("data"), F.col("n_data"), F.lit("clear"), F.col("n_clear"))
    return stats.select(
        "scene_id", "sensor", "n_px",
        F.least(F.col("n_data") / size, F.lit(1.0)).alias("cover"),
        F.coalesce(F.try_divide(F.col("n_clear"), F.col("n_data")), F.lit(0.0)).alias("clear"),
        F.when(B.is_s2(sensor), F.transform_keys("codes", lambda k, _: k.cast("string"))).otherwise(two).alias("mask_hist"),
    )


def scene_screen(stats: DataFrame, min_cover: float = 0.1, min_clear: float = 0.6) -> DataFrame:
    """Accept or skip each scene; cover is checked first."""
    return stats.select(
        "scene_id", "sensor",
        F.bround(100 * F.col("cover"), 2).alias("cover_aoi_pct"),
        F.bround(100 * F.col("clear"), 2).alias("clear_aoi_pct"),
        F.col("n_px").alias("aoi_px_mask"), "mask_hist",
        F.when(F.col("cover") < min_cover, "skipped_cover")
        .when(F.col("clear") < min_clear, "skipped_cloudy").otherwise("ok").alias("status"),
    )


def keep_accepted(pixels: DataFrame, screened: DataFrame) -> DataFrame:
    """Only the pixels of accepted scenes go further."""
    return pixels.join(screened.filter(F.col("status") == "ok").select("scene_id"), "scene_id", "left_semi")
