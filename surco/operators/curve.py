"""The vegetation curve of each pixel and the variables taken relative to it.

Every step is a window or an aggregate on (sensor, px_id). Tiles are merged before, so a
pixel holds at most one row per date of the season and a window partition stays small.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surco.functions import bands as B
from surco.session import scratch_path

PIXEL = ("sensor", "px_id")
# Fixed values.
SPIKE_DROP = 0.10
STEP_DAYS = 5
MIN_OBS = 4
MIN_DATES = 3
MIN_AMPLITUDE = 0.1
LANDSAT_EXTRA_DAYS = 8
RELATIVE_WINDOWS = (
    ("REL1_arranque", "DIAsube50", -10, 10),
    ("REL2_maximo", "DIAmax", -10, 10),
    ("REL3_postmax", "DIAmax", 20, 40),
    ("REL4_bajada", "DIAbaja50", -10, 10),
)
SHAPE_METRICS = ("NDVImax", "AMPLITUD", "VELsube", "VELbaja", "DIASsubemax", "DUR50", "NDVImedio")
DATE_METRICS = ("DIAsube50", "DIAmax", "DIAbaja50")
COHERENCE_LABELS = {0: "sin curva", 1: "encaja con maiz", 2: "encaja con sorgo", 3: "encaja con los dos",
                    4: "no encaja con ninguno", 5: "curva incompleta"}


def by_day():
    return Window.partitionBy(*PIXEL).orderBy("day")


def whole():
    return Window.partitionBy(*PIXEL)


def with_day(obs: DataFrame, day0: Column) -> DataFrame:
    """Days from the cycle start."""
    return obs.withColumn("day", F.datediff(F.col("obs_date"), day0))


def stored(obs: DataFrame, name: str | None = None) -> DataFrame:
    """Observations as a table bucketed by sensor and pixel, in the shared folder; ``name`` keeps it for later sessions of the same catalogue.

    The source is read once. Every window, join and aggregate on a pixel that follows finds its rows in their bucket, whatever columns
    it takes, so it needs no shuffle.
    """
    spark = obs.sparkSession
    name = name or f"observations_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    obs.repartition(buckets, *PIXEL).write.bucketBy(buckets, *PIXEL).sortBy(*PIXEL, "day").option("path", scratch_path(spark, "observations")).saveAsTable(name)
    return spark.table(name)


def season_axis(obs: DataFrame) -> DataFrame:
    """First and last date and number of dates of each sensor; one row per sensor (two), from at most a season's dates each."""
    return obs.groupBy("sensor").agg(F.min("day").alias("t0"), F.max("day").alias("t_end"), F.size(F.collect_set("day")).cast("bigint").alias("n_dates"))


def despike(obs: DataFrame, drop: float = SPIKE_DROP) -> DataFrame:
    """Drop observations far below both valid neighbours; all drops are decided at once."""
    near = obs.filter(F.col("NDVI").isNotNull()).select(
        *PIXEL, "day", "NDVI", F.lag("NDVI").over(by_day()).alias("prev"), F.lead("NDVI").over(by_day()).alias("next")
    )
    spike = F.col("prev").isNotNull() & F.col("next").isNotNull() & (
        F.col("NDVI") < F.least("prev", "next") - F.lit(drop))
    return near.filter(~spike).select(*PIXEL, "day", "NDVI")


def gate(clean: DataFrame, axis: DataFrame, min_obs: int = MIN_OBS) -> DataFrame:
    """Keep pixels with enough observations, of sensors with enough dates; adds the axis."""
    counted = clean.withColumn("n_valid", F.count(F.lit(1)).over(whole())).filter(F.col("n_valid") >= min_obs)
    # the axis has one row per sensor, so two at most
    return counted.join(F.broadcast(axis.filter(F.col("n_dates") >= MIN_DATES)), "sensor")


def resample(kept: DataFrame, step: int = STEP_DAYS) -> DataFrame:
    """Linear interpolation on the sensor's regular grid, only between valid observations."""
    seg = kept.select(
        *PIXEL, "t0", "t_end", "day", "NDVI",
        F.lead("day").over(by_day()).alias("next_day"), F.lead("NDVI").over(by_day()).alias("next_ndvi"),
    )
    k_from = F.ceil((F.col("day") - F.col("t0")) / step)
    k_to = F.when(F.col("next_day").isNull(), F.floor((F.col("day") - F.col("t0")) / step)).otherwise(
        F.ceil((F.col("next_day") - F.col("t0")) / step) - 1)
    points = seg.withColumns({"k_from": k_from, "k_to": k_to}).filter(F.col("k_from") <= F.col("k_to")).select(
        *PIXEL, "t0", "t_end", "day", "NDVI", "next_day", "next_ndvi",
        F.explode(F.sequence("k_from", "k_to")).alias("k"))
    t = F.col("t0") + F.col("k") * step
    share = (t - F.col("day")) / (F.col("next_day") - F.col("day"))
    value = F.when(F.col("next_day").isNull(), F.col("NDVI")).otherwise(
        F.col("NDVI") + (F.col("next_ndvi") - F.col("NDVI")) * share)
    last_k = F.floor((F.col("t_end") - F.col("t0")) / step)
    return points.select(*PIXEL, "k", t.cast("int").alias("day"), value.alias("g"), last_k.alias("last_k"))


def smooth(grid: DataFrame) -> DataFrame:
    """Mean of the neighbours present; the first and last grid rows of the season stay as they are."""
    before = F.when(F.lag("k").over(by_day()) == F.col("k") - 1, F.lag("g").over(by_day()))
    after = F.when(F.lead("k").over(by_day()) == F.col("k") + 1, F.lead("g").over(by_day()))
    near = grid.withColumns({"before": before, "after": after})
    n = 1 + F.col("before").isNotNull().cast("int") + F.col("after").isNotNull().cast("int")
    mean = (F.coalesce("before", F.lit(0.0)) + F.col("g") + F.coalesce("after", F.lit(0.0))) / n
    edge = (F.col("k") == 0) | (F.col("k") == F.col("last_k"))
    return near.select(*PIXEL, "k", "day", F.when(edge, F.col("g")).otherwise(mean).alias("s"))


def metrics(curve: DataFrame, step: int = STEP_DAYS) -> DataFrame:
    """Curve metrics, one row per pixel: three passes over the same partitioning, no new shuffle."""
    k, s = F.col("k"), F.col("s")
    peak = curve.withColumns({
        "vmax": F.max("s").over(whole()),
        "next_s": F.when(F.lead("k").over(by_day()) == k + 1, F.lead("s").over(by_day())),
    }).withColumn("kmax", F.min(F.when(s == F.col("vmax"), k)).over(whole()))
    kmax, vmax = F.col("kmax"), F.col("vmax")
    based = peak.withColumns({
        "base_up": F.min(F.when(k <= kmax, s)).over(whole()),
        "base_dn": F.min(F.when(k >= kmax, s)).over(whole()),
    })
    up = F.col("base_up") + 0.5 * (vmax - F.col("base_up"))
    down = F.col("base_dn") + 0.5 * (vmax - F.col("base_dn"))
    slope = (F.col("next_s") - s) / step
    raw = based.groupBy(*PIXEL).agg(
        F.first("vmax").alias("NDVImax"),
        F.min(F.when(k == kmax, F.col("day"))).alias("DIAmax"),
        F.first("base_up").alias("base_up"), F.first("base_dn").alias("base_dn"),
        F.min(F.when((k <= kmax) & (s >= up), F.col("day"))).alias("rise_day"),
        F.min(F.when((k > kmax) & (s < down), F.col("day"))).alias("fall_day"),
        F.max(F.when(k < kmax, slope)).alias("VELsube"),
        (-F.min(F.when(k >= kmax, slope))).alias("VELbaja"),
        F.avg("s").alias("NDVImedio"),
    )
    rise = F.when(F.col("NDVImax") - F.col("base_up") >= MIN_AMPLITUDE, F.col("rise_day"))
    fall = F.when(F.col("NDVImax") - F.col("base_dn") >= MIN_AMPLITUDE, F.col("fall_day"))
    return raw.select(
        *PIXEL, "NDVImax", (F.col("NDVImax") - F.col("base_up")).alias("AMPLITUD"), "VELsube", "VELbaja",
        (F.col("DIAmax") - rise).alias("DIASsubemax"), (fall - rise).alias("DUR50"), "NDVImedio",
        rise.alias("DIAsube50"), "DIAmax", fall.alias("DIAbaja50"), "base_up", "base_dn",
    )


def curve_metrics(obs: DataFrame, step: int = STEP_DAYS, drop: float = SPIKE_DROP, min_obs: int = MIN_OBS) -> DataFrame:
    """Observations (sensor, px_id, day, NDVI) to one row of metrics per pixel with a curve."""
    return metrics(smooth(resample(gate(despike(obs, drop), season_axis(obs), min_obs), step)), step)


def pixel_windows(obs: DataFrame, met: DataFrame, variables: Sequence[str], windows=RELATIVE_WINDOWS,
                  landsat_extra: int = LANDSAT_EXTRA_DAYS, stages: Sequence[str] = ()) -> DataFrame:
    """One row per pixel: its metrics, and ``windows``, an array of (window, variables..., nobs).

    Medians of the raw observations, in windows around the pixel's own curve dates and, with ``stages``, in calendar stages (column
    ``stage``). Every window is a condition on one and the same row, so an observation is read once. No anchor or no observation
    gives missing and 0; a stage without any row of the pixel is left out.
    """
    own = [c for c in met.columns if c not in PIXEL]
    joined = obs.join(met, list(PIXEL), "left")
    extra = F.when(F.col("sensor") == B.LANDSAT, landsat_extra).otherwise(0)
    inside = {name: (F.col("day") - F.col(anchor)).between(F.lit(a) - extra, F.lit(b) + extra) for name, anchor, a, b in windows}
    inside |= {name: F.col("stage") == name for name in stages}
    aggs = [F.first(c).alias(c) for c in own]
    for i, hit in enumerate(inside.values()):
        aggs += [F.median(F.when(hit, F.col(v))).alias(f"_{i}_{v}") for v in variables]
        aggs += [F.count(F.when(hit, F.col("NDVI"))).alias(f"_{i}_nobs"), F.count_if(hit).alias(f"_{i}_rows")]
    entry = [F.struct(F.lit(name).alias("window"), *[F.col(f"_{i}_{v}").alias(v) for v in (*variables, "nobs")]) for i, name in enumerate(inside)]
    kept = [e if name not in stages else F.when(F.col(f"_{i}_rows") > 0, e) for i, (name, e) in enumerate(zip(inside, entry))]
    return joined.groupBy(*PIXEL).agg(*aggs).select(*PIXEL, *own, F.array_compact(F.array(*kept)).alias("windows"))


def relative_medians(obs: DataFrame, met: DataFrame, variables: Sequence[str],
                     windows=RELATIVE_WINDOWS, landsat_extra: int = LANDSAT_EXTRA_DAYS) -> DataFrame:
    """Medians of the raw observations in windows around each pixel's own curve dates, one row per pixel and window."""
    anchors = sorted({w[1] for w in windows})
    return pixel_windows(obs, met.select(*PIXEL, *anchors), variables, windows, landsat_extra).select(*PIXEL, F.inline("windows"))


def fixed_medians(obs: DataFrame, variables: Sequence[str], stages: Sequence[str] | None = None) -> DataFrame:
    """Medians per calendar stage; only stages that hold at least one date exist."""
    rows = obs.filter(F.col("stage").isin(*stages)) if stages else obs
    return rows.groupBy(*PIXEL, "stage").agg(
        *[F.median(v).alias(v) for v in variables], F.count("NDVI").alias("nobs"))


def coherence_code(rise: Column, peak: Column, refs: dict) -> Column:
    """Does the curve fit the expected windows of maize (1), sorghum (2), both (3), none (4)?

    ``refs``: crop -> {"arranque": (d0, d1) or None, "maximo": (d0, d1) or None}. 0 no curve,
    5 green-up missing although a green-up window exists and nothing fits.
    """
    has = peak.isNotNull()
    fits, unsure = {}, F.lit(False)
    for crop in ("maiz", "sorgo"):
        spec = refs.get(crop)
        if not spec:
            fits[crop] = F.lit(False)
            continue
        ok = has
        if spec.get("arranque"):
            unsure = F.lit(True)
            ok = ok & F.coalesce(rise.between(*spec["arranque"]), F.lit(False))
        if spec.get("maximo"):
            ok = ok & F.coalesce(peak.between(*spec["maximo"]), F.lit(False))
        fits[crop] = ok
    m, s = fits["maiz"], fits["sorgo"]
    return (
        F.when(~has, 0).when(m & s, 3).when(m, 1).when(s, 2)
        .when(unsure & rise.isNull(), 5).otherwise(4)
    )


def features_long(met: DataFrame, relative: DataFrame | None, fixed: DataFrame | None,
                  variables: Sequence[str], dates_as_variables: bool = False) -> DataFrame:
    """All variables as rows (px_id, name, value) under their catalogue names.

    Bands are named by the sensor's own band id; an index a sensor lacks gives no variable.
    """
    wanted = SHAPE_METRICS + (DATE_METRICS if dates_as_variables else ())

    def melt(df: DataFrame, window: Column, names: Sequence[str]) -> DataFrame:
        return _named(df.select("sensor", "px_id", F.inline(_entries(window, {n: F.col(n) for n in names}))))

    parts = [melt(met, F.lit("FEN"), wanted)]
    if relative is not None:
        parts.append(melt(relative, F.col("window"), variables))
    if fixed is not None:
        parts.append(melt(fixed, F.col("stage"), variables))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def features_of_pixels(pixels: DataFrame, variables: Sequence[str], dates_as_variables: bool = False) -> DataFrame:
    """The same rows from ``pixel_windows``, all of a pixel's from its one row; a pixel without a curve has no FEN variables."""
    wanted = SHAPE_METRICS + (DATE_METRICS if dates_as_variables else ())
    shape = F.when(F.col("NDVImax").isNotNull(), _entries(F.lit("FEN"), {n: F.col(n) for n in wanted}))
    every = F.flatten(F.transform("windows", lambda w: _entries(w["window"], {n: w[n] for n in variables})))
    return _named(pixels.select("sensor", "px_id", F.inline(F.concat(F.coalesce(shape, F.array().cast(_ENTRIES)), every))))


_ENTRIES = "array<struct<window:string,variable:string,value:double>>"


def _entries(window: Column, values: dict[str, Column]) -> Column:
    own = {(sensor, role): band for sensor, band, role, _, _ in B.BANDS}

    def name_on(sensor: str, v: str) -> Column:
        if v in B.INDICES:
            return F.lit(v if sensor in B.INDEX_ROLES[v] else None)
        return F.lit(own.get((sensor, v)) if v in B.ROLES else v)

    return F.array(*[F.struct(
        window.alias("window"), F.when(B.is_s2(F.col("sensor")), name_on(B.S2, n)).otherwise(name_on(B.LANDSAT, n)).cast("string").alias("variable"),
        value.cast("double").alias("value")) for n, value in values.items()]).cast(_ENTRIES)


def _named(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("variable").isNotNull()).withColumn("name", B.variable_name(F.col("sensor"), F.col("window"), F.col("variable")))


def features_wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per pixel with an explicit list of variables (no discovery pass, one shuffle)."""
    return long.groupBy("px_id").agg(
        *[F.first(F.when(F.col("name") == n, F.col("value")), ignorenulls=True).alias(n) for n in names])
