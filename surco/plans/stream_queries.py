"""Streaming queries, run to completion over files made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from surco.operators import calendar as CAL
from surco.plans.curve_queries import rounded, with_cte
from surco.plans.registry import query
from surco.plans.scene_queries import CTE_STAGED
from surco.session import scratch_path
from surco.sources.adapters import oracle, view
from surco.sources.progress import KEY
from surco.streaming import jobs as J


@query("stream_progress_upsert", oracle("""
SELECT cvegeo, anio, ciclo, modalidad, cultivo, CAST(fecha AS VARCHAR) AS fecha,
  CASE WHEN month(fecha) = 3 AND modalidad = 'riego' THEN -2e0 WHEN month(fecha) = 3 THEN -1e0 ELSE sembrada END AS sembrada FROM {crop_progress} p"""))
def stream_progress_upsert(spark, sf_dir):
    """Three loads arrive one file set after the other; later ones replace equal cuts."""
    base = view(spark, sf_dir, "crop_progress").select(*KEY, "sembrada")
    march = base.filter(F.month("fecha") == 3)
    loads = [base.withColumn("load_ord", F.lit(0)), march.withColumns({"sembrada": F.lit(-1.0), "load_ord": F.lit(1)}),
             march.filter("modalidad = 'riego'").withColumns({"sembrada": F.lit(-2.0), "load_ord": F.lit(2)})]
    inbox, table, log = (scratch_path(spark, n) for n in ("inbox", "table", "log"))
    schema = loads[0].schema
    for load in loads:
        load.write.mode("append").parquet(inbox)
        source = spark.readStream.schema(schema).parquet(inbox)
        J.progress_upsert(source, table, log).awaitTermination()
    return rounded(J.current_cuts(spark, schema, table).drop("load_ord"), ())


@query("stream_manifest_stage", with_cte(CTE_STAGED, "SELECT id AS scene_id, cycle, stage FROM st"))
def stream_manifest_stage(spark, sf_dir):
    """Scene records arrive twice, the older ones in a later batch; each is staged and kept once."""
    f = view(spark, sf_dir, "scene_facts")
    rec = f.select(F.col("id").alias("scene_id"), F.col("obs_date").cast("timestamp").alias("obs_time"), "obs_date",
                   F.when(F.col("k") % 2 == 0, "OI").otherwise("PV").alias("cycle"), F.year("obs_date").alias("year"))
    inbox, sink, log = (scratch_path(spark, n) for n in ("inbox", "staged", "log"))
    windows = CAL.windows(CAL.calendar_of_years(rec.select("year").distinct()))
    for part in (rec.filter(F.month("obs_date") > 6), rec):
        part.write.mode("append").parquet(inbox)
        J.manifest_stage(spark.readStream.schema(rec.schema).parquet(inbox), windows, sink, log).awaitTermination()
    return J.staged_scenes(spark, J.staged_schema(rec), sink).select("scene_id", "cycle", "stage")
