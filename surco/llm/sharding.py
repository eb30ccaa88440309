"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surco.llm.common import positions, text_of
from surco.session import written_once

SHARDS = 40
ROW_BYTES = 16
#: Groups above 1/HEAVY of all bytes are scheduled by themselves (fewer than HEAVY of them can exist); the others
#: travel in BUNDLES bundles, so the heap never meets more than HEAVY + BUNDLES jobs, whatever the corpus.
HEAVY, BUNDLES = 16_384, 65_536


def longest_first(jobs: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """``{job: shard}``: jobs ``(job, size)`` by descending size (ties by number), each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for job, size in sorted(jobs, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[job] = shard
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shard sizes come near each other. Documents of equal text (a null text counts as the
    empty one) stay together, so a shard can only exceed the others by a group that is larger than a shard.
    Slots count a shard's rows gapless from 0; repeated rows have slots of their own.
    """
    spark = docs.sparkSession
    raw = text_of().cast("binary")
    base = written_once(docs.select(
        "doc_id", (F.octet_length(raw) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.unhex(F.md5(raw)).alias("text_key")))
    grouped = written_once(base.groupBy("text_key").agg(F.sum("size").alias("bytes")))
    total = grouped.agg(F.sum("bytes")).first()[0] or 0
    heavy = F.col("bytes") * HEAVY > F.lit(total)
    bundle = F.pmod(F.xxhash64("text_key"), F.lit(BUNDLES)).cast("bigint")
    alone = [(bytes(r["text_key"]), r["bytes"]) for r in grouped.filter(heavy).orderBy("text_key").collect()]
    light = grouped.filter(~heavy).groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes")).collect()
    jobs = [(r["b"], r["bytes"]) for r in light] + [(BUNDLES + k, size) for k, (_, size) in enumerate(alone)]
    chosen = longest_first(jobs, shards)
    own = spark.createDataFrame([(bytearray(key), chosen[BUNDLES + k]) for k, (key, _) in enumerate(alone)], "text_key binary, own_shard int")
    rest = spark.createDataFrame([(r["b"], chosen[r["b"]]) for r in light], "bundle bigint, bundle_shard int")
    placed = written_once(
        base.withColumn("bundle", bundle).join(F.broadcast(own), "text_key", "left").join(F.broadcast(rest), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "bundle_shard").alias("shard")))
    return positions(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
