"""Sensor facts: bands, asset keys, masks, scaling, index formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

S2 = "S2"
LANDSAT = "LANDSAT"
PREFIX = {S2: "S2", LANDSAT: "LS"}

# Fixed values: (sensor, band, role, native metres, asset keys in order of preference).
BANDS = [
    (S2, "B02", "blue", 10, ["blue", "B02", "B02_10m"]),
    (S2, "B03", "green", 10, ["green", "B03", "B03_10m"]),
    (S2, "B04", "red", 10, ["red", "B04", "B04_10m"]),
    (S2, "B08", "nir", 10, ["nir", "B08", "B08_10m"]),
    (S2, "B05", "re1", 20, ["rededge1", "B05", "B05_20m"]),
    (S2, "B06", "re2", 20, ["rededge2", "B06", "B06_20m"]),
    (S2, "B07", "re3", 20, ["rededge3", "B07", "B07_20m"]),
    (S2, "B8A", "nir8a", 20, ["nir08", "B8A", "B8A_20m"]),
    (S2, "B11", "swir1", 20, ["swir16", "B11", "B11_20m"]),
    (S2, "B12", "swir2", 20, ["swir22", "B12", "B12_20m"]),
    (S2, "SCL", "mask", 20, ["scl", "SCL", "SCL_20m"]),
    (LANDSAT, "SR_B1", "coastal", 30, ["coastal", "SR_B1"]),
    (LANDSAT, "SR_B2", "blue", 30, ["blue", "SR_B2"]),
    (LANDSAT, "SR_B3", "green", 30, ["green", "SR_B3"]),
    (LANDSAT, "SR_B4", "red", 30, ["red", "SR_B4"]),
    (LANDSAT, "SR_B5", "nir", 30, ["nir08", "SR_B5"]),
    (LANDSAT, "SR_B6", "swir1", 30, ["swir16", "SR_B6"]),
    (LANDSAT, "SR_B7", "swir2", 30, ["swir22", "SR_B7"]),
    (LANDSAT, "QA_PIXEL", "mask", 30, ["qa_pixel", "QA_PIXEL"]),
]
# Clear classes and bits, window snapping, fallback scaling.
SCREEN_SCL = (4, 5, 6, 7)
VARIABLE_SCL = (4, 5)
QA_BAD_BITS = 63
QA_FILL_BIT = 1
SNAP_M = {S2: 20.0, LANDSAT: 30.0}
LANDSAT_SCALE, LANDSAT_OFFSET = 2.75e-5, -0.2
S2_SCALE, S2_OFFSET_SINCE_4 = 1e-4, -0.1

ROLES = ("nir", "red", "green", "swir1", "swir2", "nir8a", "re1", "re3")
INDICES = ("NDVI", "GCVI", "NDMI", "NDTI", "NDRE", "CIre")
# Roles each index needs, per sensor; absent sensor = index not defined there.
INDEX_ROLES = {
    "NDVI": {S2: ("nir", "red"), LANDSAT: ("nir", "red")},
    "GCVI": {S2: ("nir", "green"), LANDSAT: ("nir", "green")},
    "NDMI": {S2: ("nir", "nir8a", "swir1"), LANDSAT: ("nir", "swir1")},
    "NDTI": {S2: ("swir1", "swir2"), LANDSAT: ("swir1", "swir2")},
    "NDRE": {S2: ("nir8a", "re1")},
    "CIre": {S2: ("re3", "re1")},
}


def is_s2(sensor: Column) -> Column:
    return sensor == S2


def clear_for_screening(sensor: Column, mask: Column, scl=SCREEN_SCL) -> Column:
    """Clear sky as counted when a whole scene is accepted or skipped."""
    return F.when(is_s2(sensor), mask.isin(*scl)).otherwise(mask.bitwiseAND(QA_BAD_BITS) == 0)


def clear_for_variables(sensor: Column, mask: Column, scl=VARIABLE_SCL) -> Column:
    """Clear sky as required of a pixel that enters a variable (stricter)."""
    return F.when(is_s2(sensor), mask.isin(*scl)).otherwise((mask.bitwiseAND(QA_BAD_BITS) == 0) & (mask != 0))


def has_data(sensor: Column, mask: Column) -> Column:
    return F.when(is_s2(sensor), mask != 0).otherwise(mask.bitwiseAND(QA_FILL_BIT) == 0)


def reflectance(dn: Column, scale: Column, offset: Column, clear: Column) -> Column:
    return F.when((dn != 0) & clear, dn * scale + offset)


def normalized(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def index_column(name: str, sensor: Column) -> Column:
    """An index over role columns; missing where a role is missing or the ratio undefined."""
    c = F.col
    if name == "NDVI":
        return normalized(c("nir"), c("red"))
    if name == "GCVI":
        return F.try_divide(c("nir"), c("green")) - 1
    if name == "NDMI":
        return normalized(F.when(is_s2(sensor), c("nir8a")).otherwise(c("nir")), c("swir1"))
    if name == "NDTI":
        return normalized(c("swir1"), c("swir2"))
    if name == "NDRE":
        return F.when(is_s2(sensor), normalized(c("nir8a"), c("re1")))
    if name == "CIre":
        return F.when(is_s2(sensor), F.try_divide(c("re3"), c("re1")) - 1)
    raise ValueError(f"unknown index {name!r}")


def variable_name(sensor: Column, window: Column, variable: Column) -> Column:
    """``<S2|LS>_<window>_<band or index>``."""
    return F.concat_ws("_", F.when(is_s2(sensor), PREFIX[S2]).otherwise(PREFIX[LANDSAT]), window, variable)
