"""A table of batch folders with a list of those that count, switched in one step after a batch is written.

``data/load=<run>-<batch>`` holds the rows of one micro-batch; the run is the id that Spark gives a checkpoint. ``versions/<n>`` lists the folders
of the table after n changes, with the order in which they were added and the last batch of each run. A version is written to a file of its own
and renamed, which fails where another writer was first (HDFS and the like; on a file system whose rename replaces, two writers must not switch in the
same instant). So a crash before the switch leaves a folder that nobody
reads, a replay after it changes nothing, and a new checkpoint, whose batches count from 0 again, adds to what is stored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

EMPTY = {"folders": {}, "next": 0, "runs": {}}


class CommitLog:
    """The versions of one table; paths may lie in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.table}/versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def state(self, version: int | None = None) -> dict:
        known = self.versions() if version is None else [version]
        if not known:
            return EMPTY
        stream = self._fs.open(self._path(f"{self.table}/versions/{known[-1]}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": known[-1]}
        finally:
            stream.close()

    def change(self, how: Callable[[dict], dict | None]) -> bool:
        """Switch to ``how(state)``; None leaves the table alone. Another writer's switch in between makes it try again."""
        while True:
            state = self.state()
            new = how(state)
            if new is None:
                return False
            version = state.get("version", -1) + 1
            draft = self._path(f"{self.table}/versions/.{uuid.uuid4().hex}")
            out = self._fs.create(draft, False)
            out.write(bytearray(json.dumps({k: new[k] for k in EMPTY}).encode()))
            out.close()
            target = self._path(f"{self.table}/versions/{version}")
            if not self._fs.exists(target) and self._fs.rename(draft, target):
                return True
            self._fs.delete(draft, False)

    def add(self, rows: DataFrame, run: str, batch: int, partitions: tuple[str, ...] = ()) -> bool:
        """Store the rows of one batch, once however often it is replayed."""
        if self.state()["runs"].get(run, -1) >= batch:
            return False
        name = f"{run}-{batch}"
        writer = rows.write.mode("overwrite")  # what a crash left of the same batch goes
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{self.table}/data/load={name}")

        def with_batch(state: dict) -> dict | None:
            if state["runs"].get(run, -1) >= batch:
                return None
            return {"folders": state["folders"] | {name: state["next"]}, "next": state["next"] + 1, "runs": state["runs"] | {run: batch}}

        return self.change(with_batch)

    def read(self, schema: StructType, order: str = "load_seq", state: dict | None = None) -> DataFrame:
        """All rows of the folders that count, with ``order``: the place of their folder among the additions."""
        folders = (state or self.state())["folders"]
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn(order, F.lit(0).cast("long"))
        whole = StructType([*schema.fields, StructField("load", StringType())])
        rows = self.spark.read.schema(whole).option("basePath", f"{self.table}/data").parquet(*[f"{self.table}/data/load={n}" for n in folders])
        place = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])  # bounded by compaction
        return rows.withColumn(order, place[F.col("load")].cast("long")).drop("load")

    def compact(self, schema: StructType, best: Callable[[DataFrame], DataFrame], partitions: tuple[str, ...] = (), keep: int = 2) -> None:
        """Replace the folders by one with ``best`` of their rows, and remove folders that none of the last ``keep`` versions lists.

        ``best`` gets the rows with ``load_seq``. Batches that arrive meanwhile keep their folders and their later place.
        """
        state = self.state()
        old = state["folders"]
        if len(old) > 1:
            name, last = f"compact-{uuid.uuid4().hex}", max(old.values())
            writer = best(self.read(schema, state=state)).select(*schema.fieldNames()).write
            (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{self.table}/data/load={name}")

            def replaced(now: dict) -> dict | None:
                if not set(old) <= set(now["folders"]):
                    return None  # another compaction was first
                return now | {"folders": {n: s for n, s in now["folders"].items() if n not in old} | {name: last}}

            self.change(replaced)
        versions = self.versions()
        listed = set().union(*[self.state(v)["folders"] for v in versions[-keep:]])
        for v in versions[:-keep]:
            for gone in set(self.state(v)["folders"]) - listed:
                self._fs.delete(self._path(f"{self.table}/data/load={gone}"), True)
            self._fs.delete(self._path(f"{self.table}/versions/{v}"), False)


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to: it outlives restarts, and a new checkpoint has another."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
