"""SimHash near-duplicates found by meet-in-the-middle ball hashing."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from surco.llm.common import free_shuffles, fresh, give_back
from surco.llm.components import components
from surco.session import written_once

SHINGLE_WORDS = 3
MAX_BITS = 2
#: Of ``keep_one_alike``: words of a shingle, and the similarity (a share in whole numbers) from which two texts are near copies.
ALIKE_WORDS = 5
ALIKE = (4, 5)
#: Its fingerprints: words of a shingle, fingerprints of a text, and bits of the halves that the balls are on. A changed word changes fewer short shingles.
PRINT_WORDS, PRINTS, HALF = 2, 3, 32
#: Least hashes of a text: so many bands of so many. Texts of similarity 0.8 agree in no band once in 38 000 pairs.
BANDS, BAND_HASHES = 20, 4
#: Of nodes that leaders of the first comparison left apart: further leaders of a band, and the most texts of a rare shingle.
LEADERS, RARE = 4, 32
#: Fingerprints of texts of similarity 0.8 differ in 10 of 64 bits on average; more than this once in millions of pairs.
FAR_BITS = 26
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLOCK = 1 << 15  # hashes unpacked at once


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, repeats included; a shorter text is one run, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[size - 1:].tolist())), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes, as a signed number; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = np.ascontiguousarray(hashes[at:at + _BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def text_fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The SimHash of the word shingles of a text; 0 for a text without words."""
    return fingerprint(shingle_hashes(text, size))


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series([text_fingerprint(t) for t in texts], dtype="int64")


def _ball(radius: int, width: int = 64) -> list[int]:
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, max_bits: int = MAX_BITS, width: int = 64) -> DataFrame:
    """Verified links ``(a, b)`` that connect all fingerprints at most ``max_bits`` (even) apart.

    ``prints(fingerprint)`` is distinct. Each one emits every variant within half the radius. Two
    fingerprints in reach of each other meet in the variant halfway, and all that meet in one variant are
    in reach of each other. A variant has at most as many fingerprints as the ball has points (65 for 2
    bits), so no group grows with the data; each member links to the smallest, which connects
    the same documents as all pairs would. Only the lowest ``width`` bits may differ.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even: half of it is the radius of the ball")
    ball = F.array(*[F.lit(m).cast("bigint") for m in _ball(max_bits // 2, width)])
    variants = prints.select("fingerprint", F.explode(ball).alias("mask")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("a", F.min("fingerprint").over(Window.partitionBy("variant")))
    return (
        met.filter(F.col("a") != F.col("fingerprint")).select("a", F.col("fingerprint").alias("b")).distinct()
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fingerprint, first)`` in, ``(fingerprint, component)`` out: the least ``first`` of the component."""
    linked = components(links(prints.select("fingerprint"), max_bits))
    rooted = prints.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return rooted.select("fingerprint", "root").join(least, "root").select("fingerprint", "component")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``.

    Null, empty and blank texts have fingerprint zero and link like any other; a null id never names a
    component unless its component has no other. Repeated rows are kept as they are. Other columns of
    ``docs`` are not read.
    """
    base = written_once(docs.select("doc_id", fingerprint_of(F.col("text")).alias("fingerprint")))
    prints = written_once(base.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    named = groups(prints, max_bits)
    return base.join(named, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def _text_key(column: str = "text") -> Column:
    return F.xxhash64(F.col(column), F.lit(1))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one of each near-duplicate group: the least id, then the least text hash.

    All columns stay. Repeated rows of the document that stays count once; a null id comes last.
    """
    base = written_once(docs.select("doc_id", _text_key().alias("k"), fingerprint_of(F.col("text")).alias("fingerprint")))
    prints = written_once(base.groupBy("fingerprint").agg(F.min(_order()).alias("first")))
    return _those(docs, groups(prints, max_bits).select("component.doc_id", "component.k").distinct())


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")


def _with_key(docs: DataFrame, named: DataFrame, how: str, key: str) -> DataFrame:
    """``docs`` joined with ``named(doc_id, k, ...)`` by id and text hash, the latter kept as ``key``."""
    return docs.withColumn(key, _text_key()).alias("d").join(
        named.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.{key}") == F.col("s.k")), how)


def _those(docs: DataFrame, stay: DataFrame) -> DataFrame:
    key, = fresh(docs, "text_key")
    return _with_key(docs, stay, "left_semi", key).dropDuplicates(["doc_id", key]).select(*docs.columns)


# --- near copies by exact similarity ------------------------------------------------------


def print_halves(text: str | None) -> list[int]:
    """The halves of ``PRINTS`` fingerprints of a text, each with its place above its bits (none without words); the first two are of ``text_fingerprint``."""
    hashes = shingle_hashes(text, PRINT_WORDS)
    out: list[int] = []
    for _ in range(PRINTS if len(hashes) else 0):
        bits = fingerprint(hashes)
        out += [len(out) << HALF | bits & (1 << HALF) - 1, len(out) + 1 << HALF | bits >> HALF & (1 << HALF) - 1]
        hashes = (hashes ^ hashes >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ hashes >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(31)
    return out


_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * BAND_HASHES), np.uint64) * np.uint64(2) + np.uint64(1)


def text_facts(text: str | None) -> tuple[int, int, int, list[int]]:
    """Name and size of the set of shingles of a text, its fingerprint, and a key for each band of its least hashes (none without words)."""
    every = shingle_hashes(text, ALIKE_WORDS)
    hashes = np.unique(every)
    if not len(hashes):
        return 0, 0, 0, []
    least = np.full(BANDS * BAND_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at:at + 1024, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0), out=least)
    bands = [_signed(xxh64_intdigest(b.tobytes(), k)) for k, b in enumerate(least.astype("<u8").reshape(BANDS, -1))]
    return _signed(xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)), len(hashes), fingerprint(every), bands


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.StructType().add("node", T.LongType()).add("n", T.IntegerType()).add("print", T.LongType()).add("bands", T.ArrayType(T.LongType()))
              .add("halves", T.ArrayType(T.LongType())))
def facts_of(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([(*text_facts(t), print_halves(t)) for t in texts], columns=["node", "n", "print", "bands", "halves"]).astype({"node": "int64", "n": "int32", "print": "int64"})
    give_back()
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingles_of(texts: pd.Series) -> pd.Series:
    out = pd.Series([np.unique(shingle_hashes(t, ALIKE_WORDS)).view(np.int64) for t in texts], dtype=object)
    give_back()
    return out


def _near(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """``a, b, na, nb`` of the pairs whose sizes and fingerprints allow the similarity ``ALIKE``; a few bytes rule out most pairs far apart."""
    p, q = ALIKE
    low, high = F.least(f"{x}.node", f"{y}.node"), F.greatest(f"{x}.node", f"{y}.node")
    small, large = (f(f"{x}.n", f"{y}.n").cast("bigint") for f in (F.least, F.greatest))
    bits = F.bit_count(F.col(f"{x}.print").bitwiseXOR(F.col(f"{y}.print")))
    swapped = F.col(f"{x}.node") > F.col(f"{y}.node")
    near = pairs.filter((low != high) & (q * small >= p * large) & (bits <= FAR_BITS))
    return near.select(low.alias("a"), high.alias("b"), F.when(swapped, F.col(f"{y}.n")).otherwise(F.col(f"{x}.n")).alias("na"),
                       F.when(swapped, F.col(f"{x}.n")).otherwise(F.col(f"{y}.n")).alias("nb")).distinct()


def _alike(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``near(a, b, na, nb)`` whose sets of shingles have the similarity ``ALIKE``, by all shingles of both."""
    p, q = ALIKE
    both = near.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    return both.filter((p + q) * shared >= p * (F.col("na").cast("bigint") + F.col("nb"))).select("a", "b")


def _leaders(rows: DataFrame, orders: list[Column], *more: Column) -> DataFrame:
    """``key, leads``: the first of each key in each order."""
    firsts = [F.min(F.struct(o.alias("o"), "x"))["x"] for o in orders]
    return rows.groupBy("key").agg(F.array_distinct(F.array(*firsts)).alias("leads"), *more)


def _met_rare(members: DataFrame) -> DataFrame:
    """Pairs of ``members(x, shingles)`` of different roots that share a rare shingle and may be alike.

    A prefix filter. In one order of all shingles, those of one text first, then those of up to ``RARE`` texts, two sets of n and more shingles
    with the similarity ``ALIKE`` share one of the first n - ceil(0.8 n) + 1. Only rare ones of these are
    sent, and only where they reach texts of different roots, so no group is longer than ``RARE``.
    """
    p, q = ALIKE
    each = members.select("x", F.explode("shingles").alias("s"))
    used = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("x.root").alias("lo"), F.max("x.root").alias("hi")).filter(F.col("c") <= RARE)
    first = F.col("x.n") - F.ceil(F.col("x.n") * p / q) + 1
    rare = each.join(used, "s").groupBy("x").agg(
        F.count(F.when(F.col("c") == 1, 1)).alias("alone"),
        F.sort_array(F.collect_list(F.when(F.col("c") > 1, F.struct("s", (F.col("lo") != F.col("hi")).alias("wide"))))).alias("shared"))
    sent = rare.withColumn("left", (first - F.col("alone")).cast("int")).filter("left > 0").select(
        "x", F.explode(F.expr("filter(slice(shared, 1, left), y -> y.wide)")).alias("w"))
    met = sent.groupBy("w.s").agg(F.collect_list("x").alias("m")).filter(F.size("m") > 1)
    return met.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).filter(
        (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")))


def met_in_balls(nodes: DataFrame) -> DataFrame:
    """``a, b, na, nb`` of the nodes whose SimHash fingerprints have a half at most ``MAX_BITS`` bits apart and that may be alike.

    The ball hashing of ``links``, on halves, one fingerprint after the other: halves of different places never meet, and so the disk
    holds the balls of one. From ``nodes(node, n, print, halves)``.
    """
    met = []
    for place in range(0, 2 * PRINTS, 2):
        met.append(written_once(_met_in_balls(nodes.withColumn("halves", F.slice("halves", place + 1, 2)))))
        free_shuffles(nodes.sparkSession)  # the balls are the largest, and are read no more
    return reduce(DataFrame.unionByName, met).distinct()


def _met_in_balls(nodes: DataFrame) -> DataFrame:
    """Texts of one half link to the least of them, so a half emits its ball once, however many texts have it."""
    halves = nodes.select(F.explode("halves").alias("half"), F.struct("node", "n", "print").alias("x"))
    firsts = written_once(halves.groupBy("half").agg(F.min("x").alias("y")))
    apart = links(firsts.select(F.col("half").alias("fingerprint")), MAX_BITS, HALF)
    across = apart.join(firsts.select(F.col("half").alias("a"), F.col("y").alias("x")), "a").join(
        firsts.select(F.col("half").alias("b"), "y"), "b").select("x", "y")
    return _near(across.unionByName(halves.join(firsts, "half").select("x", "y")), "x", "y")


def alike_links(rows: DataFrame, sets: DataFrame, linked: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join the nodes of a similarity of 0.8 or more, from ``rows(key, x, leads)`` and ``sets(node, shingles)``.

    ``linked(a, b)``, a < b, are the links of SimHash; they stand, and what they leave apart is compared here. First every node of a key with its
    leaders. That joins copies of one text, however many; a node's root is the least of the leaders and the nodes of SimHash before it
    that it is linked to. Keys of a single root are done. In those that are left, nodes of different roots meet by their rare
    shingles, which misses no pair that shares one, and by further leaders, for texts of which all parts are frequent.
    """
    led = rows.select("x", F.explode("leads").alias("y"))
    apart = _near(led, "x", "y").join(linked, ["a", "b"], "left_anti")
    found = written_once(_alike(apart, sets).unionByName(linked))
    free_shuffles(rows.sparkSession)
    leads = rows.select(F.explode("leads.node").alias("lead")).unionByName(linked.select(F.col("a").alias("lead"))).distinct()
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = both.join(leads, both["b"] == leads["lead"], "left_semi").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    roots = written_once(roots.select("node", F.least("node", "root").alias("root")))
    # a leader is linked to leaders itself: one step further brings most of a group to one root
    roots = roots.join(roots.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select(
        "node", F.coalesce("further", "root").alias("root"))
    rooted = written_once(rows.select("key", F.col("x.node").alias("node"), "x").join(roots, "node", "left").select(
        "key", F.struct("x.*", F.coalesce("root", "node").alias("root")).alias("x")))
    mixed = _leaders(rooted, [F.xxhash64("x.node", F.lit(k)) for k in range(1, LEADERS + 1)], F.min("x.root").alias("lo"), F.max("x.root").alias("hi"))
    open_ = written_once(rooted.join(mixed.filter("lo <> hi").select("key", "leads"), "key"))
    free_shuffles(rows.sparkSession)  # all shingles follow
    members = open_.select("x").distinct().join(sets, F.col("x.node") == sets["node"]).select("x", "shingles")
    again = open_.select("x", F.explode("leads").alias("y")).filter("x.root <> y.root")
    return found.unionByName(_alike(_near(_met_rare(members).unionByName(again), "x", "y"), sets))


def keep_one_alike(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near copies: the least id, then the least text hash.

    Near copies have 5-word shingles of a similarity of 0.8 or more (exact, by all shingles), or are linked by such texts.
    Texts of the same shingles are one row from the start, so all texts without a word (null, empty, blank) are one group. The others are
    fingerprinted by SimHash and meet in the balls of their fingerprints' halves; links that all shingles confirm stand. An exact
    join follows for what fingerprints don't reach: texts not linked yet meet in bands of least hashes. All columns stay. Repeated rows of
    the document that stays count once; a null id comes last. An empty table gives no row; other columns are not read.
    """
    base = docs.select("doc_id", _text_key().alias("k"), facts_of(F.col("text")).alias("t")).select("doc_id", "k", "t.*")
    nodes = written_once(base.groupBy("node").agg(F.min(_order()).alias("first"), *[F.first(c).alias(c) for c in ("n", "print", "bands", "halves")]))
    met = written_once(met_in_balls(nodes))
    rows = nodes.select(F.struct("node", "n", "print").alias("x"), F.explode("bands").alias("key"))
    leads = _leaders(rows, [F.col("x.n").cast("bigint"), F.xxhash64("x.node", F.lit(0))], F.count(F.lit(1)).alias("c"))
    rows = written_once(rows.join(leads.filter("c > 1").drop("c"), "key"))
    free_shuffles(docs.sparkSession)  # the texts that are compared follow
    compared = rows.select("x.node").unionByName(met.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = nodes.join(compared, "node", "left_semi").select("first.doc_id", "first.k", "node")
    key, = fresh(docs, "text_key")
    texts = _with_key(docs.select("doc_id", "text"), wanted, "inner", key).select("s.node", "d.text").dropDuplicates(["node"])
    sets = written_once(texts.select("node", shingles_of(F.col("text")).alias("shingles")))
    free_shuffles(docs.sparkSession)
    linked = written_once(_alike(met, sets))
    free_shuffles(docs.sparkSession)
    roots = components(alike_links(rows, sets, linked))
    free_shuffles(docs.sparkSession)  # all texts follow
    rooted = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return _those(docs, rooted.select("first.doc_id", "first.k"))
