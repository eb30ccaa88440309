"""Crop calendars: stages as date windows of a cycle year, and what hangs on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surco.session import written_once

OUT_OF_STAGE = "fuera_de_etapa"
NAME_PATTERN = "^[A-Za-z0-9_-]+$"
# The starting calendar.
DEFAULT_CALENDAR = {
    "OI": [("00_siembra_emergencia", "01-15", "02-28"), ("01_vegetativo", "03-01", "04-10"),
           ("02_floracion_espigamiento", "04-11", "05-15"), ("03_madurez_senescencia", "05-16", "07-15")],
    "PV": [("00_siembra_emergencia", "06-15", "07-31"), ("01_vegetativo", "08-01", "09-10"),
           ("02_floracion_espigamiento", "09-11", "10-15"), ("03_madurez_senescencia", "10-16", "12-15")],
}
CROPS = ("maiz", "sorgo")
REFERENCE_KINDS = ("arranque", "maximo")
CROP_NAMES = {"maiz": "Maíz grano", "sorgo": "Sorgo grano"}


def calendar_table(spark: SparkSession, cycles: dict = DEFAULT_CALENDAR) -> DataFrame:
    """(cycle, stage_ord, stage, start_mmdd, end_mmdd) rows as an inline relation."""
    rows = ", ".join(f"('{c}', {i}, '{n}', '{a}', '{b}')" for c, st in cycles.items() for i, (n, a, b) in enumerate(st))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(cycle, stage_ord, stage, start_mmdd, end_mmdd)")


def calendar_of_years(years: DataFrame, cycles: dict = DEFAULT_CALENDAR) -> DataFrame:
    """The calendar once for every row of ``years``: a literal array that each row explodes, no join."""
    rows = [F.struct(F.lit(c).alias("cycle"), F.lit(i).alias("stage_ord"), F.lit(n).alias("stage"), F.lit(a).alias("start_mmdd"), F.lit(b).alias("end_mmdd"))
            for c, stages in cycles.items() for i, (n, a, b) in enumerate(stages)]
    return years.select("*", F.explode(F.array(*rows)).alias("entry")).select(*years.columns, "entry.*")


def mmdd_date(year: Column, mmdd: Column) -> Column:
    """The date of a MM-DD text in ``year``; NULL for an impossible day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), mmdd), "yyyy-MM-dd")


def valid_mmdd(mmdd: Column) -> Column:
    """A real day of a common year (so 29 February is refused)."""
    return mmdd.rlike("^[0-9]{2}-[0-9]{2}$") & mmdd_date(F.lit(2001), mmdd).isNotNull()


def windows(calendar: DataFrame, keys: Sequence[str] = ("cycle",)) -> DataFrame:
    """Dates of every stage in the cycle year ``year``.

    A MM-DD before the first stage's start falls in the next year; an end that would come
    before its start moves one more year.
    """
    order = Window.partitionBy(*keys, "year").orderBy("stage_ord")
    first = F.first("start_mmdd").over(order)
    year_of = lambda mmdd: F.col("year") + (mmdd < F.col("first_mmdd")).cast("int")
    dated = calendar.withColumn("first_mmdd", first).withColumns({
        "start_date": mmdd_date(year_of(F.col("start_mmdd")), F.col("start_mmdd")),
        "end_once": mmdd_date(year_of(F.col("end_mmdd")), F.col("end_mmdd")),
        "end_next": mmdd_date(year_of(F.col("end_mmdd")) + 1, F.col("end_mmdd")),
    })
    end = F.when(F.col("end_once") < F.col("start_date"), F.col("end_next")).otherwise(F.col("end_once"))
    return dated.withColumn("end_date", end).drop("first_mmdd", "end_once", "end_next")


def pack(stage_windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per calendar with its windows as an array; a cycle's stages do not overlap, so few."""
    entry = F.struct("stage_ord", "stage", "start_date", "end_date")
    return stage_windows.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("stages"))


def stage_assign(df: DataFrame, stage_windows: DataFrame, date_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``stage``: the first window that holds the date (both ends count), else out of stage.

    The windows of a calendar travel as one array, so a range join never multiplies rows.
    With no ``keys`` there is one calendar, read as a scalar; keyed by cycle and year there are
    two rows a year, which is a bound that allows a broadcast. Per-profile calendars are many
    and join as Spark sees fit.
    """
    packed = pack(stage_windows, keys)
    if not keys:
        joined = df.withColumn("stages", packed.scalar())
    else:
        joined = df.join(F.broadcast(packed) if set(keys) <= {"cycle", "year"} else packed, list(keys), "left")
    day = F.col(date_col)
    hit = F.filter("stages", lambda s: (s["start_date"] <= day) & (day <= s["end_date"]))
    return joined.withColumn("stage", F.coalesce(F.try_element_at(hit, F.lit(1))["stage"], F.lit(OUT_OF_STAGE))).drop("stages")


def violations(calendar: DataFrame, keys: Sequence[str] = ("cycle",)) -> DataFrame:
    """Why a calendar is invalid: one row per defect, none when it is fine."""
    ids = [*keys, "stage_ord", "stage"]
    checked = calendar.withColumn("year", F.lit(2001)).withColumn(
        "dates_ok", valid_mmdd(F.col("start_mmdd")) & valid_mmdd(F.col("end_mmdd")))
    bad_name = ~F.col("stage").rlike(NAME_PATTERN) | (F.col("stage") == OUT_OF_STAGE)
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, "stage")) > 1
    whole = Window.partitionBy(*keys)
    marked = windows(checked, keys).withColumn("all_dates_ok", F.min("dates_ok").over(whole))
    order = Window.partitionBy(*keys).orderBy("stage_ord")
    span = F.datediff(F.max_by("end_date", "stage_ord").over(whole), F.min_by("start_date", "stage_ord").over(whole))
    # overlap and length are only defined once every date of the calendar is a date
    problems = F.array_compact(F.array(
        F.when(~F.col("cycle").rlike(NAME_PATTERN), "cycle name"),
        F.when(bad_name, "stage name"),
        F.when(same, "repeated stage name"),
        F.when(~F.col("dates_ok"), "bad date"),
        F.when(F.col("all_dates_ok") & (F.col("start_date") <= F.lag("end_date").over(order)), "overlap"),
        F.when(F.col("all_dates_ok") & (span > 366) & (F.col("stage_ord") == F.min("stage_ord").over(whole)), "longer than one year"),
    ))
    return marked.withColumn("problems", problems).select(*ids, F.explode("problems").alias("problem"))


def span(stage_windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First day of the first stage and last day of the last one."""
    return stage_windows.groupBy(*keys).agg(
        F.min_by("start_date", "stage_ord").alias("first_day"), F.max_by("end_date", "stage_ord").alias("last_day"))


def official_year(spans: DataFrame) -> DataFrame:
    """Year of the official figures: OI takes the year it ends in, the others the year they start in."""
    return spans.withColumn("official_year", F.when(F.col("cycle") == "OI", F.year("last_day")).otherwise(F.year("first_day")))


def cycle_year(calendar: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("cycle",)) -> DataFrame:
    """Inverse of ``official_year``: the cycle year whose official year is ``official``.

    Only the year before and the year itself can match; the earlier is tried first.
    """
    tries = wanted.select(*keys, "official", F.explode(F.array(F.col("official") - 1, F.col("official"))).alias("year"))
    dated = windows(calendar.join(tries.select(*keys, "year").distinct(), list(keys)), keys)
    years = official_year(span(dated, [*keys, "year"]))
    hits = years.select(*keys, "year", "official_year")
    found = tries.join(hits, [*keys, "year"]).filter(F.col("official_year") == F.col("official"))
    best = found.groupBy(*keys, "official").agg(F.min("year").alias("cycle_year"))
    return wanted.join(best, [*keys, "official"], "left").withColumn("cycle_year", F.coalesce("cycle_year", "official"))


def restage(manifest: DataFrame, files_present: DataFrame, stage_windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What happens to each accepted scene after a calendar change.

    ``files_present``: (folder, file) that exist, folder = stage/sensor. Nothing is overwritten:
    a scene moves only if all its files are at the source and none at the destination.
    """
    rows = manifest.filter((F.col("status") == "ok") & (F.size("files") > 0)).withColumnRenamed("stage", "old_stage")
    # one row per scene, read by the clash, the loss and the final report
    staged = written_once(stage_assign(rows, stage_windows, "obs_date", keys).withColumnRenamed("stage", "new_stage"))
    listed = staged.filter(F.col("new_stage") != F.col("old_stage")).select(
        "scene_id", F.concat_ws("/", "old_stage", "sensor").alias("source"),
        F.concat_ws("/", "new_stage", "sensor").alias("target"), F.explode("files").alias("file"))
    here = files_present.select("folder", "file").distinct()
    clash = listed.join(here.withColumnRenamed("folder", "target"), ["target", "file"], "left_semi")
    gone = listed.join(here.withColumnRenamed("folder", "source"), ["source", "file"], "left_anti")
    problems = clash.select("scene_id", F.lit("exists").alias("what"), "file").unionByName(
        gone.select("scene_id", F.lit("missing").alias("what"), "file"))
    # a scene lists a handful of files (one per resolution), so its list stays short
    report = problems.groupBy("scene_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("what") == "exists", F.col("file")))), ",").alias("clash"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("what") == "missing", F.col("file")))), ",").alias("gone"))
    joined = staged.join(report, "scene_id", "left")
    problem = F.when(F.col("clash") != "", F.concat(F.lit("exists "), "clash")).when(
        F.col("gone") != "", F.concat(F.lit("missing "), "gone"))
    result = F.when(F.col("new_stage") == F.col("old_stage"), "kept").when(problem.isNotNull(), "problem").otherwise("moved")
    return joined.select("scene_id", "sensor", "old_stage", "new_stage", result.alias("result"), problem.alias("problem"),
                         F.when(result == "moved", F.col("new_stage")).otherwise(F.col("old_stage")).alias("stage"))


def reference_days(refs: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reference windows (crop, kind, from_mmdd, to_mmdd) as days from the cycle start.

    ``starts``: keys, year, first_mmdd, first_day. A date before the first stage is next year's;
    an end before its beginning is a year later. Empty windows are left out.
    """
    j = refs.filter(F.col("from_mmdd") != "").join(starts, list(keys))

    def day(mmdd: str) -> Column:
        year = F.col("year") + (F.col(mmdd) < F.col("first_mmdd")).cast("int")
        return F.datediff(mmdd_date(year, F.col(mmdd)), F.col("first_day"))

    d0, d1 = day("from_mmdd"), day("to_mmdd")
    return j.select(*keys, "crop", "kind", d0.alias("d0"), F.when(d1 < d0, d1 + 365).otherwise(d1).alias("d1"))


def references_for_cycle(flat: DataFrame, per_cycle: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reference windows of each (profile, cycle): a flat set serves every cycle, else the cycle's own.

    ``flat``: profile, crop, kind, from_mmdd, to_mmdd for profiles with one set; ``per_cycle`` adds cycle.
    """
    cycles = F.explode(F.array(*[F.lit(c) for c in DEFAULT_CALENDAR])).alias("cycle")
    everywhere = flat.select("*", cycles)
    own = per_cycle.join(flat.select(*keys).distinct(), list(keys), "left_anti")
    return everywhere.unionByName(own)


def references_from_sowing(sowing: DataFrame, offsets: DataFrame) -> DataFrame:
    """Crop windows from the sowing dates: [S10 + min, S90 + max] per crop and kind.

    ``sowing``: profile, cycle, crop, s10, s90 (MM-DD or NULL); ``offsets``: cycle, crop, kind,
    days_min, days_max. Missing parts stay empty and are noted.
    """
    kinds = F.explode(F.array(*[F.lit(k) for k in REFERENCE_KINDS])).alias("kind")
    rows = sowing.select("*", kinds).join(offsets, ["cycle", "crop", "kind"], "left")
    start = mmdd_date(F.lit(2001), F.col("s10"))
    same = mmdd_date(F.lit(2001), F.col("s90"))
    end = F.when(same < start, mmdd_date(F.lit(2002), F.col("s90"))).otherwise(same)
    known = F.col("s10").isNotNull() & F.col("s90").isNotNull()
    have = known & F.col("days_min").isNotNull() & F.col("days_max").isNotNull()
    note = F.when(~known, F.concat(F.col("crop"), F.lit(": sin ventana de siembra"))).when(
        ~have, F.concat_ws(" ", "crop", F.concat(F.col("kind"), F.lit(": sin desfase"))))
    return rows.select(
        "profile", "cycle", "crop", "kind",
        F.when(have, F.date_format(F.date_add(start, F.col("days_min")), "MM-dd")).otherwise("").alias("from_mmdd"),
        F.when(have, F.date_format(F.date_add(end, F.col("days_max")), "MM-dd")).otherwise("").alias("to_mmdd"),
        note.alias("note"))


def profile_violations(refs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Defects of a profile's crop windows and offsets, one row each."""

    def common() -> list[Column]:
        return [F.when(~F.col("crop").isin(*CROPS), "unknown crop"), F.when(~F.col("kind").isin(*REFERENCE_KINDS), "unknown kind")]

    a, b = F.col("from_mmdd"), F.col("to_mmdd")
    of_refs = F.array_compact(F.array(
        *common(), F.when((a != "") != (b != ""), "give both dates or none"),
        F.when((a != "") & (b != "") & ~(valid_mmdd(a) & valid_mmdd(b)), "bad date")))
    lo, hi = F.col("days_min"), F.col("days_max")
    of_offsets = F.array_compact(F.array(
        *common(), F.when(lo.isNull() != hi.isNull(), "give both offsets or none"), F.when(hi < lo, "max < min")))
    ids = ["profile", "cycle", "crop", "kind"]
    return refs.select(*ids, F.lit("reference").alias("part"), F.explode(of_refs).alias("problem")).unionByName(
        offsets.select(*ids, F.lit("offset").alias("part"), F.explode(of_offsets).alias("problem")))


def mark_manual(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Origins after an edit: unchanged stages keep theirs, the others become ``manual``.

    Where the old cycle had no origins at all, the new stages get none.
    """
    known = old.groupBy(*keys).agg(F.max(F.col("origin").isNotNull()).alias("had_origin"))
    before = old.select(*keys, "stage_ord", F.col("stage").alias("o_stage"), F.col("start_mmdd").alias("o_start"),
                        F.col("end_mmdd").alias("o_end"), F.col("origin").alias("o_origin"))
    same = (F.col("stage").eqNullSafe(F.col("o_stage")) & F.col("start_mmdd").eqNullSafe(F.col("o_start"))
            & F.col("end_mmdd").eqNullSafe(F.col("o_end")) & F.col("o_origin").isNotNull())
    return (new.join(before, [*keys, "stage_ord"], "left").join(known, list(keys), "left")
            .withColumn("origin", F.when(F.coalesce("had_origin", F.lit(False)), F.when(same, F.col("o_origin")).otherwise("manual")))
            .drop("o_stage", "o_start", "o_end", "o_origin", "had_origin"))


def replace_profiles(stored: DataFrame, imported: DataFrame, default: DataFrame, prefix: str = "siap_") -> DataFrame:
    """Imported official profiles replace all stored ones of their kind; the default returns if none remain."""
    kept = stored.filter(~F.col("profile").startswith(prefix))
    restored = default.filter(kept.agg(F.count(F.lit(1))).scalar() == 0)
    clean = kept.join(imported.select("profile").distinct(), "profile", "left_anti")
    return clean.unionByName(restored).unionByName(imported)
