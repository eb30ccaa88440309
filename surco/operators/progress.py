"""Cumulative crop-progress series: quantile dates, curves, summaries and crop calendars.

Two families differ on purpose. The *profile* series adds zeros only before a series' first
row and is normalised by its maximum; the *map* series has a zero at every cut without a row
and is normalised by its last value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surco.functions.text import slug, whole_percent
from surco.session import written_once

# Fixed values.
CROPS_DEFAULT = ("Maíz grano", "Sorgo grano")
MIN_HA = 500.0
EMERGENCE_DAYS = 10
MATURITY_DAYS = 30
JUMP_SHARE = 0.5
MIN_CYCLE_DAYS = 90
CYCLE_NAMES = {"OI": "Otoño-Invierno", "PV": "Primavera-Verano"}
STAGE_NAMES = ("00_siembra_emergencia", "01_vegetativo", "02_floracion_espigamiento", "03_madurez_senescencia")
MAP_VARIABLES = ("sembrada", "cosechada", "siniestrada", "produccion")
QUANTILES = {"S10": ("s", 0.1), "S50": ("s", 0.5), "S90": ("s", 0.9), "H50": ("c", 0.5), "H90": ("c", 0.9)}
SERIES = ("cvegeo", "modalidad", "ciclo", "anio")


def _is_oi() -> Column:
    return F.col("ciclo") == "OI"


def start_covered(first_cut: Column) -> Column:
    """Does the export reach back to the start of the cycle?"""
    return F.when(_is_oi(), first_cut <= F.make_date(F.col("anio") - 1, F.lit(10), F.lit(31))).otherwise(
        first_cut <= F.make_date(F.col("anio"), F.lit(5), F.lit(31)))


def series_profile(rows: DataFrame, crops: Sequence[str] = CROPS_DEFAULT, keys: Sequence[str] = SERIES) -> DataFrame:
    """Sown and harvested area per series and cut, crops added up, with the zeros that anchor its start.

    The cuts of a (cycle, year) are monthly, so they travel as one short array and each series
    explodes only the cuts before its own first row.
    """
    cuts = rows.groupBy("ciclo", "anio").agg(F.sort_array(F.collect_set("fecha")).alias("cuts"))
    added = rows.filter(F.col("cultivo").isin(*crops)).groupBy(*keys, "fecha").agg(
        F.sum("sembrada").alias("sembrada"), F.sum("cosechada").alias("cosechada"))
    firsts = added.groupBy(*keys).agg(F.min("fecha").alias("first_row"))
    first_cut = F.col("cuts")[0]
    anchor = F.when(start_covered(first_cut), F.array(F.date_sub(F.trunc(first_cut, "month"), 1))).otherwise(
        F.array().cast("array<date>"))
    earlier = F.filter("cuts", lambda c: c < F.col("first_row"))
    # two rows a year at most, hence the broadcast
    zeros = firsts.join(F.broadcast(cuts), ["ciclo", "anio"]).select(
        *keys, F.explode(F.concat(anchor, earlier)).alias("fecha"), F.lit(0.0).alias("sembrada"), F.lit(0.0).alias("cosechada"))
    return added.unionByName(zeros)


def _crossing(p: float, now: str, before: str, first: str) -> Column:
    w = (F.lit(p) - F.col(before)) / (F.col(now) - F.col(before))
    date = F.date_add(F.col("prev_fecha"), F.bround(w * F.datediff("fecha", "prev_fecha"), 0).cast("int"))
    return F.when((F.col(first) < p) & (F.col(before) < p) & (F.col(now) >= p), date)


def cycle_dates(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Quantile dates of each series and its warnings, one row per series."""
    order, whole = Window.partitionBy(*keys).orderBy("fecha"), Window.partitionBy(*keys)
    s = series.withColumns({"total_s": F.max("sembrada").over(whole), "total_c": F.max("cosechada").over(whole)})
    s = s.withColumns({"fs": F.when(F.col("total_s") > 0, F.col("sembrada") / F.col("total_s")),
                       "fc": F.when((F.col("total_s") > 0) & (F.col("total_c") > 0), F.col("cosechada") / F.col("total_c"))})
    s = s.withColumns({
        "prev_fecha": F.lag("fecha").over(order), "fs_prev": F.lag("fs").over(order), "fc_prev": F.lag("fc").over(order),
        "fs_first": F.first("fs").over(order), "fc_first": F.first("fc").over(order)})
    names = {"s": ("fs", "fs_prev", "fs_first"), "c": ("fc", "fc_prev", "fc_first")}
    s = s.withColumns({q: _crossing(p, *names[kind]) for q, (kind, p) in QUANTILES.items()})
    jump = F.when((F.col("fs") - F.col("fs_prev") > JUMP_SHARE) & (F.col("fs") >= 0.999), F.concat(
        whole_percent(F.col("fs") - F.col("fs_prev")), F.lit(" % de la siembra en el corte que cierra la serie ("),
        F.col("fecha").cast("string"), F.lit("); puede ser un cierre administrativo")))
    # a series has one row per monthly cut, so the sorted jumps are a short array
    out = s.withColumn("jump", jump).groupBy(*keys).agg(
        F.max("total_s").alias("sembrada"), F.max("total_c").alias("cosechada"),
        *[F.min_by(q, F.when(F.col(q).isNotNull(), F.col("fecha"))).alias(q) for q in QUANTILES],
        F.min("fecha").alias("first_cut"), F.min("fs_first").alias("first_share"),
        F.max_by("fc", "fecha").alias("last_harvest"),
        F.sort_array(F.collect_list(F.when(F.col("jump").isNotNull(), F.struct("fecha", "jump")))).alias("jumps"))
    start = F.when(F.col("first_share") > 0.1, F.concat(
        F.lit("sin datos del arranque (primer corte "), F.col("first_cut").cast("string"), F.lit(" ya al "),
        whole_percent(F.col("first_share")), F.lit(" %)")))
    harvest = F.when(F.col("cosechada") <= 0, "sin cosecha registrada").when(
        F.col("last_harvest") < 0.9, "cosecha sin terminar en el último corte")
    warnings = F.when(F.col("sembrada") <= 0, F.array(F.lit("sin siembra"))).otherwise(F.array_compact(
        F.concat(F.array(start), F.transform("jumps", lambda j: j["jump"]), F.array(harvest))))
    return out.select(*keys, "sembrada", "cosechada", *QUANTILES, warnings.alias("warnings"))


def _reference_origin(year: Column) -> Column:
    """Origin for averaging dates of different years."""
    return F.when(_is_oi(), F.make_date(year - 1, F.lit(8), F.lit(1))).otherwise(F.make_date(year, F.lit(1), F.lit(1)))


def median_dates(dates: DataFrame, keys: Sequence[str] = ("cvegeo", "modalidad", "ciclo")) -> DataFrame:
    """Median date over the years of each quantile, in a reference year, with the years used."""
    entries = F.array(*[F.struct(F.lit(q).alias("key"), F.col(q).alias("date")) for q in QUANTILES])
    rows = dates.select(*keys, "anio", F.inline(entries)).filter(F.col("date").isNotNull())
    offset = F.datediff("date", _reference_origin(F.col("anio")))
    # one row per year and series: the median of a handful of years
    return rows.groupBy(*keys, "key").agg(
        F.median(offset).alias("offset"), F.sort_array(F.collect_set("anio")).alias("years")
    ).withColumn("date", F.date_add(_reference_origin(F.lit(2001)), F.bround("offset", 0).cast("int"))).drop("offset")


def medians_wide(medians: DataFrame, keys: Sequence[str] = ("cvegeo", "modalidad", "ciclo")) -> DataFrame:
    return medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("key") == q, F.col("date"))).alias(q) for q in QUANTILES],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("years")))).alias("years"),
        F.sort_array(F.collect_list(F.struct("key", "years"))).alias("key_years"))  # a handful of quantiles


def stage_origins(emergence: int, maturity: int) -> tuple[str, ...]:
    # The origins that a profile names.
    middle = "estimada: mitad entre emergencia y madurez"
    return f"siap: S10 .. S90 + {emergence} d", middle, middle, f"siap: H50 - {maturity} d .. H90"


def stages_from_dates(dates: DataFrame, emergence: int = EMERGENCE_DAYS, maturity: int = MATURITY_DAYS) -> DataFrame:
    """Four stages from S10, S90, H50, H90: adds ``stages`` (stage, from, to, origin) or ``stage_error``.

    ``origin`` tells what a stage's dates were taken from: official dates with the assumed days, or the middle between two stages.
    """
    half = lambda a, b: F.date_add(a, F.floor(F.datediff(b, a) / 2).cast("int"))
    e_raw, m_raw = F.date_add("S90", emergence), F.date_sub("H50", maturity)
    short = m_raw <= F.date_add(e_raw, 2)
    middle = half(e_raw, F.col("H50"))
    d = dates.withColumns({"e0": F.when(short, F.date_sub(middle, 1)).otherwise(e_raw),
                           "m0": F.when(short, F.date_add(middle, 1)).otherwise(m_raw)})
    d = d.withColumn("mid", half(F.col("e0"), F.col("m0")))
    bounds = [("S10", "e0", 0, 0), ("e0", "mid", 1, 0), ("mid", "m0", 1, -1), ("m0", "H90", 0, 0)]
    stages = F.array(*[F.struct(F.lit(n).alias("stage"), F.date_add(a, da).alias("from"), F.date_add(b, db).alias("to"), F.lit(o).alias("origin"))
                       for n, (a, b, da, db), o in zip(STAGE_NAMES, bounds, stage_origins(emergence, maturity))])
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in ("S10", "S90", "H50", "H90")]))
    error = F.when(F.size(missing) > 0, F.concat(F.lit("faltan "), F.array_join(missing, ","))).when(
        F.col("H90") <= F.col("m0"), "cosecha antes de la madurez")
    return d.withColumn("stage_error", error).withColumn("stages", F.when(error.isNull(), stages)).drop("e0", "m0", "mid")


def mmdd(date: Column) -> Column:
    return F.date_format(date, "MM-dd")


def cycle_profiles(rows: DataFrame, crops: Sequence[str] = CROPS_DEFAULT, min_ha: float = MIN_HA,
                   emergence: int = EMERGENCE_DAYS, maturity: int = MATURITY_DAYS) -> DataFrame:
    """One row per (municipality, regime, cycle): report line, stages, dates, dates per crop, warnings."""
    keys = ("cvegeo", "modalidad", "ciclo")
    dates = written_once(cycle_dates(series_profile(rows, crops)))  # one row per series, read twice
    areas = dates.groupBy(*keys).agg(
        F.median("sembrada").alias("area"),
        F.sort_array(F.collect_list(F.struct("anio", "warnings"))).alias("by_year"))
    med = medians_wide(median_dates(dates))
    base = stages_from_dates(areas.join(med, list(keys), "left"), emergence, maturity)
    crop_keys = (*keys, "cultivo")
    crop_dates = cycle_dates(series_profile(rows, crops, (*SERIES, "cultivo")), (*SERIES, "cultivo"))
    crop_med = medians_wide(median_dates(crop_dates, crop_keys), crop_keys)
    per_crop = crop_med.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "cultivo", *[mmdd(F.col(q)).alias(q) for q in QUANTILES], "years"))).alias("per_crop"))
    ha = F.bround("area", 0).cast("bigint").cast("string")
    report = F.when(F.col("area") < min_ha, F.concat(F.lit("omitido: "), ha, F.lit(f" ha < {min_ha:.0f}"))).when(
        F.col("stage_error").isNotNull(), F.concat(F.lit("omitido: "), "stage_error")).otherwise(
        F.concat(F.lit("ok: "), ha, F.lit(" ha")))
    yearly = F.flatten(F.transform("by_year", lambda y: F.transform(
        y["warnings"], lambda t: F.concat_ws(" ", F.col("ciclo"), F.concat(y["anio"].cast("string"), F.lit(":")), t))))
    length = F.datediff("H50", "S50")
    brief = F.when((F.col("area") >= min_ha) & (length < MIN_CYCLE_DAYS), F.array(F.concat(
        F.col("ciclo"), F.lit(": de siembra al 50 % a cosecha al 50 % solo "), length.cast("string"),
        F.lit(" días; no cuadra con maíz o sorgo de grano. Las fechas del Avance pueden reflejar cuándo se registró, "
              "no cuándo se sembró. REVISAR")))).otherwise(F.array().cast("array<string>"))
    label = F.concat(F.when(_is_oi(), CYCLE_NAMES["OI"]).otherwise(CYCLE_NAMES["PV"]), F.lit(" "), "modalidad",
                     F.lit(", SIAP "), F.array_join(F.col("years").cast("array<string>"), ","))
    return base.join(per_crop, list(keys), "left").withColumns({
        "report": report, "label": label, "warnings": F.concat(yearly, brief)}).drop("by_year", "stage_error")


def build_profiles(cycles: DataFrame, names: DataFrame, crops: Sequence[str] = CROPS_DEFAULT,
                   emergence: int = EMERGENCE_DAYS, maturity: int = MATURITY_DAYS) -> DataFrame:
    """Nested profiles, one per (municipality, regime) with at least one usable cycle (two at most).

    Each carries its note, the assumptions, the origin of every stage and the years that every date was taken from.
    """
    usable = F.col("report").startswith("ok")
    entry = F.struct("ciclo", "label", "stages", F.bround("area", 1).alias("sembrada_mediana_ha"), "per_crop",
                     F.struct(*[mmdd(F.col(q)).alias(q) for q in QUANTILES]).alias("fechas"), F.col("key_years").alias("anios"))
    docs = cycles.groupBy("cvegeo", "modalidad").agg(
        F.sort_array(F.collect_list(F.when(usable, F.struct("ciclo", entry.alias("body"))))).alias("cycles"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ciclo", "warnings"))), lambda w: w["warnings"])).alias("warnings"),
    ).filter(F.size("cycles") > 0)
    named = docs.join(names.select("cvegeo", "municipio"), "cvegeo", "left")
    name = F.concat_ws("_", F.lit("siap"), "cvegeo", slug(F.col("municipio")), "modalidad")
    note = F.concat(F.lit("SIAP Avance de Siembras y Cosechas, "), F.coalesce("municipio", "cvegeo"), F.lit(", "), "modalidad",
                    F.lit(f"; cultivos: {' + '.join(crops)}; emergencia +{emergence} d y madurez -{maturity} d SUPUESTOS"))
    assumed = F.struct(F.lit(emergence).alias("emergencia_dias"), F.lit(maturity).alias("madurez_dias"),
                       F.lit("constante dentro de cada mes (interpolación lineal)").alias("ritmo"))
    return named.select(
        name.alias("profile"), "cvegeo", F.coalesce("municipio", F.lit("")).alias("municipio"), "modalidad", note.alias("note"),
        F.transform("cycles", lambda c: c["body"]).alias("cycles"), "warnings",
        F.array(*[F.lit(c) for c in crops]).alias("cultivos"), assumed.alias("supuestos"))


def profile_calendars(profiles: DataFrame) -> DataFrame:
    """``profile, cycle, stage_ord, stage, start_mmdd, end_mmdd, origin`` of built profiles: what ``calendar.mark_manual`` takes."""
    cycles = profiles.select("profile", F.explode("cycles").alias("c"))
    return cycles.select("profile", F.col("c.ciclo").alias("cycle"), F.posexplode("c.stages").alias("stage_ord", "s")).select(
        "profile", "cycle", "stage_ord", F.col("s.stage").alias("stage"), mmdd(F.col("s.from")).alias("start_mmdd"), mmdd(F.col("s.to")).alias("end_mmdd"), F.col("s.origin").alias("origin"))


# ---------------------------------------------------------------- the map family
def select_rows(rows: DataFrame, regimes: Sequence[str], crops: Sequence[str]) -> DataFrame:
    return rows.filter(F.col("modalidad").isin(*regimes) & F.col("cultivo").isin(*crops))


def series_map(selected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums per (cycle, year, *keys) at every cut anyone reports; no row counts as zero, also at the end."""
    group = ("ciclo", "anio", *keys)
    sums = selected.groupBy(*group, "fecha").agg(*[F.sum(v).alias(v) for v in MAP_VARIABLES])
    if not keys:
        return sums
    cuts = selected.groupBy("ciclo", "anio").agg(F.collect_set("fecha").alias("cuts"))
    # two rows a year at most, hence the broadcast
    spine = sums.select(*group).distinct().join(F.broadcast(cuts), ["ciclo", "anio"]).select(*group, F.explode("cuts").alias("fecha"))
    return spine.join(sums, [*group, "fecha"], "left").fillna(0.0, list(MAP_VARIABLES))


def closing(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values at the last cut of each series."""
    last = F.max_by(F.struct("fecha", *MAP_VARIABLES), "fecha").alias("last")
    return series.groupBy(*keys).agg(last).select(*keys, "last.*")


def value_at(series: DataFrame, keys: Sequence[str], variable: str, cut: Column | None = None) -> DataFrame:
    """The value at exactly one cut, or at the closing when no cut is given."""
    if cut is None:
        return closing(series, keys).select(*keys, F.col(variable).alias("value"))
    return series.filter(F.col("fecha") == cut).select(*keys, F.col(variable).alias("value"))


def cutoffs(rows: DataFrame) -> DataFrame:
    return rows.select("ciclo", "anio", "fecha").distinct()


def years(rows: DataFrame) -> DataFrame:
    return rows.select("ciclo", "anio").distinct()


def cycle_state(rows: DataFrame) -> DataFrame:
    """Were the queries that hold the start and the end of each cycle made? (two existence joins)"""
    asked = rows.filter(F.col("anio_consulta").isNotNull()).select("anio_consulta").distinct()
    cyc = years(rows)
    need = cyc.withColumn("start_year", F.when(_is_oi(), F.col("anio") - 1).otherwise(F.col("anio"))).withColumn(
        "end_year", F.col("start_year") + 1)
    start = asked.select(F.col("anio_consulta").alias("start_year"), F.lit(True).alias("start_ok"))
    end = asked.select(F.col("anio_consulta").alias("end_year"), F.lit(True).alias("end_ok"))
    return need.join(start, "start_year", "left").join(end, "end_year", "left").select(
        "ciclo", "anio", F.coalesce("start_ok", F.lit(False)).alias("start_ok"), F.coalesce("end_ok", F.lit(False)).alias("end_ok"))


def complete_years(state: DataFrame) -> DataFrame:
    return state.filter(F.col("start_ok") & F.col("end_ok")).select("ciclo", "anio")


def cycle_warning(state: DataFrame) -> DataFrame:
    return state.select("ciclo", "anio", F.array_compact(F.array(
        F.when(~F.col("start_ok"), "start"), F.when(~F.col("end_ok"), "end"))).alias("warnings"))


def cycle_anchor() -> Column:
    """Day 0: 30 September before an OI year, 31 March of a PV year."""
    return F.when(_is_oi(), F.make_date(F.col("anio") - 1, F.lit(9), F.lit(30))).otherwise(
        F.make_date(F.col("anio"), F.lit(3), F.lit(31)))


def fraction_curve(series: DataFrame, variable: str, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Monotone share of the closing value by day from the anchor; starts at (0, 0) if the start was queried."""
    order, whole = Window.partitionBy(*keys).orderBy("fecha"), Window.partitionBy(*keys)
    total = F.last(variable).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.least(F.lit(1.0), F.col(variable) / F.col("total"))
    pts = series.withColumn("total", total).filter(F.col("total") > 0).select(
        *keys, F.datediff("fecha", cycle_anchor()).alias("day"), share.alias("share"))
    covered = F.broadcast(state.filter("start_ok").select("ciclo", "anio"))  # two rows a year at most
    starts = pts.select(*keys).distinct().join(covered, ["ciclo", "anio"]).select(
        *keys, F.lit(0).alias("day"), F.lit(0.0).alias("share"))
    by_day = Window.partitionBy(*keys).orderBy("day", "share").rowsBetween(Window.unboundedPreceding, 0)
    return pts.unionByName(starts).withColumn("share", F.max("share").over(by_day))


def curve_day(curve: DataFrame, p: float, keys: Sequence[str]) -> DataFrame:
    """First day at which each curve reaches ``p``; missing if it starts at or above it after day 0."""
    order = Window.partitionBy(*keys).orderBy("day", "share")
    c = curve.withColumns({"day0": F.lag("day").over(order), "share0": F.lag("share").over(order),
                           "first_day": F.first("day").over(order), "first_share": F.first("share").over(order)})
    step = F.when(F.col("share") == F.col("share0"), F.lit(0.0)).otherwise(
        (F.lit(p) - F.col("share0")) / (F.col("share") - F.col("share0")) * (F.col("day") - F.col("day0")))
    late = (F.col("first_share") >= p) & (F.col("first_day") > 0)
    reached = F.when(F.col("day0").isNotNull() & ~late & (F.col("share") >= p), F.col("day0") + step)
    # the first segment that reaches p, in curve order
    return c.withColumn("reached", reached).groupBy(*keys).agg(
        F.min_by("reached", F.when(F.col("reached").isNotNull(), F.struct("day", "share"))).alias("day"))


def p50_date(curve: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return curve_day(curve, 0.5, keys).select(
        *keys, F.date_add(cycle_anchor(), F.bround("day", 0).cast("int")).alias(name))


def progress_summary(rows: DataFrame, regimes: Sequence[str], crops: Sequence[str], cut: Column | None = None) -> DataFrame:
    """Per municipality, cycle and year: amounts at the (last) cut, yield, lost share, dates of 50 %."""
    keys = ("ciclo", "anio", "cvegeo")
    series = series_map(select_rows(rows, regimes, crops), ("cvegeo",))
    if cut is not None:
        series = series.filter(F.col("fecha") <= cut)
    # monthly sums per municipality: small, and read by the closing and both curves
    series, state = written_once(series), cycle_state(rows)
    last = closing(series, keys)
    out = last.select(
        *keys, "fecha", *MAP_VARIABLES,
        F.when(F.col("cosechada") > 0, F.col("produccion") / F.col("cosechada")).alias("rendimiento"),
        F.when(F.col("sembrada") > 0, 100 * F.col("siniestrada") / F.col("sembrada")).alias("pct_siniestrada"))
    for variable, name in (("sembrada", "p50_siembra"), ("cosechada", "p50_cosecha")):
        out = out.join(p50_date(fraction_curve(series, variable, state, keys), keys, name), list(keys), "left")
    return out


def official_sown(rows: DataFrame) -> DataFrame:
    """Sown area per (cycle, year, municipality, regime, crop) at the last cut."""
    return rows.groupBy("ciclo", "anio", "cvegeo", "modalidad", "cultivo").agg(
        F.max_by("sembrada", "fecha").alias("sembrada"), F.max("fecha").alias("fecha"))
