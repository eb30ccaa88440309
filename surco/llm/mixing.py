"""Mixing sources to target weights by blocks of words.

The words of a source form one stream, cut into blocks of fixed length. Every output shard draws the source of
each of its slots at random in proportion to the targets: a multinomial draw of its counts. A source that was
drawn more often than its target hands the surplus slots to those that were drawn too seldom, so totals are
exact and no block is taken more than twice. The slots of a source, numbered over all shards, go through a
pseudorandom permutation of its block numbers, one per pass over the source, and meet the blocks by number.
Only built-in functions are used; all randomness is hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surco.llm.common import BUCKET_ROWS, WORD, fresh, positions, text_of
from surco.session import scratch_path, written_once

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 128
SHARD_SLOTS = 1024
SHARE, MOST = 1.5, 2
#: Tickets or blocks that are looked up in one row of a range table.
CHUNK = 1024
SEED = 20


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, source, size`` (words of the text, null: 0), a hash of the text for ties, and ``more`` columns."""
    return docs.select(
        "doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(F.col("text")).alias("tie"), *more)


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: ``sid, source, source_size, target, n_blocks, quota``.

    Sources in code point order, null last, weigh ``WEIGHTS`` in turn. The level of the shares is found from running
    sums over the sources by the level at which each reaches its limit.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("sid") % len(WEIGHTS)) + 1).cast("int"))
    weighed = sums.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    full = MOST * F.col("source_size")
    order = Window.orderBy("full_at", "sid")
    whole = Window.partitionBy()
    level = (
        weighed.withColumn("full_at", full / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (SHARE * F.sum("source_size").over(whole) - F.col("capped")) / F.col("open"))
        .withColumn("found", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "sid", "level"))).over(whole)["level"])
    )
    aimed = level.withColumn("target", F.least(full.cast("double"), F.coalesce("found", F.lit(float("inf"))) * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    passes = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return aimed.select(
        "sid", "source", "source_size", "target", blocks.alias("n_blocks"),
        F.least(F.round(passes * blocks).cast("bigint"), MOST * blocks).alias("quota"))


def _running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of its keys that come before, in an order fixed by the rows.
    Rows are dealt over buckets by hash, as in ``positions``; ``df`` is a written table."""
    buckets = max(1, df.count() // BUCKET_ROWS)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(buckets)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum")).select(
        *keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return dealt.join(sums, [*keys, "_bucket"]).withColumn(
        name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bucket", "_before")


def _owners(sources: DataFrame, size: str, keep: list[str]) -> DataFrame:
    """Sources own intervals of numbers of this size, in turn; one row per interval and chunk of numbers that it meets."""
    upto = F.sum(size).over(Window.orderBy("sid"))  # one row per source
    spans = sources.withColumn("own_to", upto).withColumn("own_from", F.col("own_to") - F.col(size)).filter(F.col(size) > 0)
    chunks = F.sequence(F.floor(F.col("own_from") / CHUNK), F.floor((F.col("own_to") - 1) / CHUNK))
    return spans.select("sid", "own_from", "own_to", *keep, F.explode(chunks).alias("chunk"))


def _lookup(numbers: DataFrame, number: str, owners: DataFrame) -> DataFrame:
    chunked = numbers.withColumn("chunk", F.floor(F.col(number) / CHUNK))
    return chunked.join(owners, "chunk").filter((F.col(number) >= F.col("own_from")) & (F.col(number) < F.col("own_to"))).drop("chunk")


def draw(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """``shard, slot, sid, epoch, block`` for every slot of the output. ``sources`` is a written table."""
    quota = sources.agg(F.sum("quota")).first()[0] or 0
    slots = spark.range(quota).select(
        F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), (F.col("id") % SHARD_SLOTS).alias("slot"),
        F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(quota, 1))).alias("ticket"))
    drawn = written_once(_lookup(slots, "ticket", _owners(sources, "quota", [])).select("shard", "slot", "sid"))
    counts = written_once(drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n")))
    base = _running(counts, ["sid"], ["shard"], "n", "base")
    nth = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    numbered = drawn.join(base.select("shard", "sid", "base"), ["shard", "sid"]).withColumn("o", F.col("base") + nth)
    limits = sources.select("sid", "quota", "n_blocks")
    asked = written_once(numbered.join(limits, "sid").select("shard", "slot", "sid", "o", "quota", "n_blocks"))
    kept = asked.filter("o < quota").select("shard", "slot", "sid", "o", "n_blocks")
    surplus = positions(written_once(asked.filter("o >= quota").select("shard", "slot", F.lit(0).alias("all"))), ["all"], ["shard", "slot"], "i")
    had = sources.join(counts.groupBy("sid").agg(F.sum("n").alias("had")), "sid", "left").select(
        "sid", "n_blocks", F.coalesce("had", F.lit(0)).alias("had"), F.greatest(F.col("quota") - F.coalesce("had", F.lit(0)), F.lit(0)).alias("lacks"))
    moved = _lookup(surplus, "i", _owners(had, "lacks", ["n_blocks", "had"])).select(
        "shard", "slot", "sid", (F.col("had") + F.col("i") - F.col("own_from")).alias("o"), "n_blocks")
    steps = _strides(sources)
    return (
        kept.unionByName(moved).withColumn("epoch", F.floor(F.col("o") / F.col("n_blocks"))).join(steps, ["sid", "epoch"])
        .withColumn("block", F.pmod(F.col("stride") * (F.col("o") % F.col("n_blocks")) + F.col("shift"), F.col("n_blocks")))
        .select("shard", "slot", "sid", "epoch", "block"))


def _strides(sources: DataFrame) -> DataFrame:
    """A stride without common divisor with the number of blocks, and a shift, per source and pass."""
    first = (1 << 20) + F.pmod(F.xxhash64("sid", "epoch", F.lit(SEED + 1)), F.lit(1 << 20))

    def divisor(a: Column, b: Column) -> Column:  # Euclid; 64 steps are enough for numbers below 2^43
        pair = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(64)), pair,
            lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] % p["b"]).alias("b"))),
            lambda p: p["a"])

    epochs = sources.select("sid", "n_blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(MOST - 1).cast("bigint"))).alias("epoch")).filter("n_blocks > 0")
    tried = F.filter(F.sequence(first, first + 512), lambda c: divisor(F.col("n_blocks"), c) == 1)
    return epochs.select("sid", "epoch", F.get(tried, F.lit(0)).alias("stride"), F.pmod(F.xxhash64("sid", "epoch", F.lit(SEED + 2)), F.col("n_blocks")).alias("shift"))


def streams(rows: DataFrame, sources: DataFrame, *more: str) -> DataFrame:
    """The rows with words, with ``sid`` and ``start``: the words of the source's stream before theirs."""
    named = sources.select("sid", F.col("source").alias("name"))
    joined = rows.filter("size > 0").join(named, F.col("source").eqNullSafe(F.col("name")))
    return _running(written_once(joined.select("sid", "doc_id", "size", "tie", *more)), ["sid"], ["doc_id", "size", "tie", *more], "size", "start")


def segments(placed: DataFrame) -> DataFrame:
    """One row per row and block that it lies in: words ``lo`` to ``hi`` of the row are in ``block``."""
    at, to = F.col("start"), F.col("start") + F.col("size")
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(at / BLOCK_WORDS), F.floor((to - 1) / BLOCK_WORDS))))
    edge = F.col("block") * BLOCK_WORDS
    return cut.withColumns({"lo": F.greatest(edge, at) - at, "hi": F.least(edge + BLOCK_WORDS, to) - at})


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    A null or blank text has size 0 and nothing is taken of it; a null source is a source of its own. Repeated rows are
    documents of their own. An empty table gives no rows. Columns other than id, text and source are not read.
    """
    spark = docs.sparkSession
    rows = written_once(sized(docs))
    sources = written_once(targets(rows))
    cut = segments(streams(rows, sources))
    taken = cut.join(draw(spark, sources).select("sid", "block", "slot"), ["sid", "block"], "left").groupBy("sid", "start", "doc_id", "size").agg(
        F.sum(F.when(F.col("slot").isNotNull(), F.col("hi") - F.col("lo")).otherwise(0)).alias("taken"))
    aims = sources.select("sid", "source_size", "target")
    none = rows.filter("size = 0").join(sources.select(F.col("source").alias("name"), "source_size", "target"), F.col("source").eqNullSafe(F.col("name")))
    return taken.join(aims, "sid").select("doc_id", "size", "source_size", "target", "taken").unionByName(
        none.select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row per document and pass in which words of it are taken.

    All columns stay; ``text`` holds the taken words with the white space before them, ``n_chars`` (where there is
    one) follows. A document of which nothing is taken is left out.
    """
    spark = docs.sparkSession
    row, parts, epoch = fresh(docs, "row_id", "parts", "pass")
    path = scratch_path(spark, "mix")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    rows = written_once(sized(kept, F.col(row).alias("rid")))
    sources = written_once(targets(rows))
    cut = segments(streams(rows, sources, "rid"))
    spans = cut.join(draw(spark, sources), ["sid", "block"]).groupBy("rid", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    joined = kept.join(spans.select(F.col("rid").alias(row), F.col("spans").alias(parts), F.col("epoch").alias(epoch)), row)
    words = F.regexp_extract_all(text_of(), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        F.col(parts), lambda s: F.slice(w, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), "")), F.lit(0))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)
