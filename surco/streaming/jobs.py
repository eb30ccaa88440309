"""Incremental versions of two batch behaviours: upserting cuts and staging new scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from surco.operators.calendar import stage_assign
from surco.sources.progress import KEY
from surco.streaming.commits import CommitLog, run_of

PARTITIONS = ("ciclo", "anio")
#: Folders of a table from which a batch merges them into one.
COMPACT_FOLDERS = 32
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, equal places settled by the rows' values."""
    others = [c for c in rows.columns if c not in (*KEY, *order)]
    best = rows.groupBy(*KEY).agg(F.max(F.struct(*order, *others)).alias("row"))
    return best.select(*KEY, *[F.col("row")[c].alias(c) for c in rows.columns if c not in KEY])


def upsert_batch(batch: DataFrame, batch_id: int, table: str, run: str, order_col: str = "load_ord") -> None:
    """Add the cuts of one batch to the table at ``table``, one row per key; a replayed batch changes nothing.

    The batch costs what its own rows cost, but that every ``COMPACT_FOLDERS`` batches the stored ones are merged.
    """
    log = CommitLog(batch.sparkSession, table)
    if not batch.isEmpty():
        log.add(last_rows(batch, [order_col]), run, batch_id, PARTITIONS)
    if len(log.state()["folders"]) > COMPACT_FOLDERS:
        compact_cuts(batch.sparkSession, batch.schema, table, order_col)


def compact_cuts(spark: SparkSession, schema: StructType, table: str, order_col: str = "load_ord") -> None:
    """Merge the stored batches into one folder with one row per key."""
    CommitLog(spark, table).compact(schema, lambda rows: last_rows(rows, [order_col, "load_seq"]), PARTITIONS)


def current_cuts(spark: SparkSession, schema: StructType, table: str, order_col: str = "load_ord") -> DataFrame:
    """The table as it stands: of each key the row with the larger ``order_col``, then of the later batch."""
    return last_rows(CommitLog(spark, table).read(schema), [order_col, "load_seq"]).drop("load_seq")


def progress_upsert(source: DataFrame, table: str, checkpoint: str, available_now: bool = True):
    """Start the upsert of a stream of typed progress rows (with ``load_ord``) into ``table``."""
    writer = (source.writeStream.foreachBatch(lambda batch, batch_id: upsert_batch(batch, batch_id, table, run_of(batch.sparkSession, checkpoint)))
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def stage_batch(batch: DataFrame, batch_id: int, stage_windows: DataFrame, sink: str, run: str, keys=("cycle", "year")) -> None:
    """Stage the records of one batch and store them; a replayed batch changes nothing."""
    log = CommitLog(batch.sparkSession, sink)
    if not batch.isEmpty():
        staged = stage_assign(batch, stage_windows, "obs_date", list(keys))
        log.add(staged, run, batch_id)
        if len(log.state()["folders"]) > COMPACT_FOLDERS:
            log.compact(staged.schema, first_records)


def first_records(rows: DataFrame) -> DataFrame:
    """Of each scene the record stored first, of those of one batch the least by its values."""
    others = [c for c in rows.columns if c not in ("scene_id", "load_seq")]
    best = rows.groupBy("scene_id").agg(F.min(F.struct("load_seq", *others)).alias("r"))
    return best.select("scene_id", "r.*")


def staged_scenes(spark: SparkSession, schema: StructType, sink: str) -> DataFrame:
    """The staged scenes as they stand, one row each: the record that came first, whatever the checkpoint it came by."""
    return first_records(CommitLog(spark, sink).read(schema)).drop("load_seq")


def staged_schema(log: DataFrame) -> StructType:
    """Columns of a staged record: those of the log and the stage."""
    return StructType(log.schema.fields).add("stage", "string")


def manifest_stage(log: DataFrame, stage_windows: DataFrame, sink: str, checkpoint: str, keys=("cycle", "year")):
    """Add staged records of new scenes (scene_id, obs_date and the calendar keys) to ``sink``.

    Which records were seen is state of the stream, kept by scene in its store (on disk, with RocksDB), so a batch costs
    what its own rows cost, however much is stored. Equal records pass once; of several records of one scene
    ``staged_scenes`` takes the first. A new checkpoint begins with an empty state: it may store a scene again, and never loses one.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (log.dropDuplicates(["scene_id", *[c for c in log.columns if c != "scene_id"]]).writeStream
            .foreachBatch(lambda batch, batch_id: stage_batch(batch, batch_id, stage_windows, sink, run_of(batch.sparkSession, checkpoint), keys))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
