"""Origins of built profiles, and what an edit leaves of them."""

from datetime import date

from pyspark.sql import functions as F

from surco.operators import calendar as CAL
from surco.operators import progress as P


def test_origins_follow_the_stages_and_survive_where_nothing_changed(spark):
    dates = spark.createDataFrame([("m", date(2001, 1, 1), date(2001, 2, 1), date(2001, 6, 1), date(2001, 7, 1)), ("gap", None, None, date(2001, 6, 1), date(2001, 7, 1))],
                                  "profile string, S10 date, S90 date, H50 date, H90 date")
    rows = {r["profile"]: r for r in P.stages_from_dates(dates, 12, 25).collect()}
    assert rows["gap"]["stages"] is None and rows["gap"]["stage_error"] == "faltan S10,S90"
    stages = rows["m"]["stages"]
    # emergence ends 12 days after S90, maturity begins 25 days before H50, the stages between meet in the middle: 83 days apart, so 41 days on
    assert [(s["from"], s["to"]) for s in stages] == [
        (date(2001, 1, 1), date(2001, 2, 13)), (date(2001, 2, 14), date(2001, 3, 26)), (date(2001, 3, 27), date(2001, 5, 6)), (date(2001, 5, 7), date(2001, 7, 1))]
    assert [s["origin"] for s in stages] == list(P.stage_origins(12, 25)) and stages[0]["origin"].endswith("12 d")
    built = P.stages_from_dates(dates, 12, 25).filter("profile = 'm'").select("profile", F.array(F.struct(F.lit("OI").alias("ciclo"), "stages")).alias("cycles"))
    old = P.profile_calendars(built)
    assert [r["origin"] for r in old.orderBy("stage_ord").collect()] == list(P.stage_origins(12, 25))
    edited = old.drop("origin").withColumn("end_mmdd", F.when(F.col("stage_ord") == 1, "03-20").otherwise(F.col("end_mmdd")))
    after = {r["stage_ord"]: r["origin"] for r in CAL.mark_manual(old, edited, ["profile", "cycle"]).collect()}
    assert after == {k: "manual" if k == 1 else o for k, o in enumerate(P.stage_origins(12, 25))}
