"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A folder holds ``ranks`` (the ids in order of frequency) and ``blocks``. A block has the ids of whole documents in
ascending ``doc_id`` order: each id's rank takes one to four bytes in ``data``, and two bits in ``control`` say how
many. Both are binary columns of Parquet files, so any store that Spark writes to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surco.llm.tokens import codec, encoded
from surco.session import scratch_path

END = 0
#: Ids of a shard (one file and one task) and of a block, about.
SHARD_IDS, BLOCK_IDS = 4_000_000, 500_000
#: How many bytes each of the four ids of a control byte takes.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def pack_ids(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    wide = 2 if ranks.max(initial=0) <= 0xFFFF else 4  # bytes that any of the numbers takes
    values = np.ascontiguousarray(ranks, f"<u{wide}")
    extra = sum((values > limit).astype(np.uint8) for limit in (0xFF, 0xFFFF, 0xFFFFFF)[:wide - 1])
    data = values.view(np.uint8).reshape(-1, wide)[np.arange(wide, dtype=np.uint8) <= extra[:, None]]
    quads = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    quads[:len(values)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), data.tobytes()


def unpack_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers: control bytes look up the sizes, sizes give the places of the bytes."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    out = raw[at].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        longer = np.flatnonzero(sizes > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n, crc, ids``: compressed ids with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if codec(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch, ids, sizes in encoded(batches, path):
            at, n, crc, packed = 0, [], [], []
            for k in sizes.tolist():
                own = np.append(ids[at:at + k], np.uint32(END)).astype("<u4")
                at += k
                n.append(k + 1)
                crc.append(zlib.crc32(own.tobytes()))
                packed.append(pa.compress(own.astype(kind).tobytes(), codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(packed, pa.binary()), pa.array([int(kind[2])] * len(n), pa.int32())],
                ["doc_id", "n", "crc", "ids", "width"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, crc bigint, ids binary, width int")


def _ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for n, ids, width in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "width"))):
        yield np.frombuffer(pa.decompress(ids, decompressed_size=n * width, codec="zstd", asbytes=True), f"<u{width}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        held = list(_ids(batch))
        for k in range(0, len(held), 256):  # a count is as long as the vocabulary, so it pays for many texts
            seen = np.bincount(np.concatenate(held[k:k + 256]))
            if len(seen) > len(total):
                total = np.concatenate((total, np.zeros(len(seen) - len(total), np.int64)))
            total[:len(seen)] += seen
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


def write(docs: DataFrame, path: str, folder: str) -> None:
    """Tokenize every whole text (null: empty), append the end id, and write the token files to ``folder``.

    Null ids come first; documents of one id follow each other by number of ids and crc. Only the count of each
    vocabulary entry passes the driver.
    """
    spark = docs.sparkSession
    _tokenized(docs, path).write.option("compression", "none").parquet(f"{folder}/tokenized")
    kept = spark.read.parquet(f"{folder}/tokenized")
    counts = kept.select("n", "ids", "width").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]  # at most one row per vocabulary entry
    order = np.array(ranked, np.int64)
    rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(bytearray(order.astype("<u4").tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, full, names, sizes, held = TaskContext.get().partitionId(), 0, 0, [], [], []

        def block() -> pa.RecordBatch:
            nonlocal start, names, sizes, held
            control, data = pack_ids(rank_of[np.concatenate(held)])
            out = pa.RecordBatch.from_pylist([{"shard": shard, "start": start, "doc_ids": names, "sizes": sizes, "control": control, "data": data}], schema=_BLOCK)
            start, names, sizes, held = start + sum(sizes), [], [], []
            return out

        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), _ids(batch)):
                names.append(name)
                sizes.append(len(ids))
                held.append(ids)
                full += len(ids)
                if full >= BLOCK_IDS:
                    full = 0
                    yield block()
        if held:
            yield block()

    total = kept.agg(F.sum("n")).first()[0] or 0
    placed = kept.repartitionByRange(max(1, -(-total // SHARD_IDS)), "doc_id").sortWithinPartitions("doc_id", "n", "crc")
    placed.select("doc_id", "n", "ids", "width").mapInArrow(
        blocks, "shard int, start bigint, doc_ids array<bigint>, sizes array<bigint>, control binary, data binary"
    ).write.parquet(f"{folder}/blocks")


_BLOCK = pa.schema([("shard", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    order = np.frombuffer(bytes((spark.read.parquet(f"{folder}/ranks").first() or [b""])[0]), "<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                sizes = np.array(b["sizes"], np.int64)
                ids = order[unpack_ids(b["control"], b["data"], int(sizes.sum()))].astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array([b["shard"]] * len(crc), pa.int32()), pa.array(b["start"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(f"{folder}/blocks")
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    first = blocks.select("shard", size.alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = blocks.mapInArrow(decode, "doc_id bigint, shard int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(first, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, folder)
    return read(docs.sparkSession, folder)
