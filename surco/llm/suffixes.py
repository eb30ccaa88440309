"""Repeated passages by suffixes that are sorted deep and shallow.

Every text chooses anchors from its bytes alone: the grams whose hash is least in some window. A string of
``LENGTH`` bytes always holds an anchor, and equal strings hold it in the same place, so only suffixes at anchors whose
gram occurs twice can begin a repeat. These suffixes, with the bytes before them, meet by gram. There they are sorted: a multikey
quicksort to a shallow depth, then blind tries for the groups that still share a long prefix. The tries of what
follows and of what precedes an anchor tell, for every way to lay ``LENGTH`` bytes around it, which suffixes share them.

An anchor whose whole surroundings (all bytes that a window around it can reach) occur twice needs no sorting: every window
repeats. Hashes of gram and surroundings find these first, and only the other suffixes at repeated grams, with one of each
kind of surroundings that is met more often, carry their bytes to the sort.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surco.llm.common import free_shuffles, fresh
from surco.session import scratch_path, written_once

LENGTH, GRAM = 200, 80
_WINDOW = LENGTH - GRAM + 1
_HALF = (LENGTH - GRAM) // 2
SHALLOW = 16  # bytes that the quicksort looks at, after those known to be equal
#: Suffixes of one gram that one task sorts; those of grams with more are compared window by window instead.
MOST_OCCURRENCES = 100_000
#: Different texts that a task knows to have sent.
KNOWN_TEXTS = 200_000
_R = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for k, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _sliding(a: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over every ``w`` neighbours, from running results within blocks of ``w``."""
    n, k = len(a), -(-len(a) // w)
    m = np.full(k * w, fill, np.uint64)
    m[:n] = a
    m = m.reshape(k, w)
    back = op.accumulate(m[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n - w + 1], op.accumulate(m, axis=1).ravel()[w - 1:n])


def _sums(raw: bytes) -> np.ndarray:
    n = len(raw)
    _grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
    return sums


def window_hashes(raw: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` neighbouring bytes."""
    sums = _sums(raw)
    return _mix((sums[size:] - sums[:-size]) * _powers[1][:len(raw) - size + 1])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes and hashes of the surroundings of the anchors: grams that are the least of some window of
    grams, ties included."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = _sums(raw)
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * _powers[1][:n - GRAM + 1])
    least = _sliding(grams, _WINDOW, np.minimum, (1 << 64) - 1)
    pad = np.zeros(len(grams) + _WINDOW - 1, np.uint64)
    pad[_WINDOW - 1:_WINDOW - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(pad, _WINDOW, np.maximum, 0) == grams)
    start, end = np.maximum(at - (LENGTH - GRAM), 0), np.minimum(at + LENGTH, n)
    size = ((at - start) << 16 | end - at).astype(np.uint64)
    around = _mix((sums[end] - sums[start]) * _powers[1][start] + size * np.uint64(0xC2B2AE3D27D4EB4F))
    return at, grams[at].view(np.int64), around.view(np.int64)


# --- sorting ---------------------------------------------------------------------------


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, at least ``known``."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    lo, hi = known, most
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _blind_trie(strings: list[bytes], group: list[int], known: int) -> list[int]:
    """The group in order. Inner nodes hold the depth at which they branch and no text: a string walks down by single
    bytes to some leaf, one comparison with that leaf finds where it leaves the trie, and it is hung in there."""
    root: list | int = group[0]
    same: dict[int, list[int]] = {group[0]: []}
    byte = lambda s, d: s[d] if d < len(s) else -1
    for i in group[1:]:
        s, node = strings[i], root
        while isinstance(node, list):
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
            node = node[0]
        leaf = node
        t = strings[leaf]
        depth = _common(s, t, known)
        if depth == len(s) == len(t):
            same[leaf].append(i)
            continue
        same[i] = []
        above, node = None, root
        while isinstance(node, list) and node[0] < depth:
            above = node
            node = node[1][byte(s, node[0])][0]
        if isinstance(node, list) and node[0] == depth:
            node[1][byte(s, depth)] = (i,)
            continue
        inner = [depth, {byte(t, depth): (node,), byte(s, depth): (i,)}]
        if above is None:
            root = inner
        else:
            above[1][byte(s, above[0])] = (inner,)
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][b][0] for b in sorted(node[1], reverse=True)]
        else:
            out += [node, *same[node]]
    return out


def deep_shallow(strings: list[bytes], known: int = 0) -> tuple[list[int], list[int]]:
    """Sorted order of the strings, which share their first ``known`` bytes, and the common prefix of neighbours."""
    order: list[int] = []
    stack = [(list(range(len(strings))), known)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            order += group
        elif depth >= known + SHALLOW:
            order += _blind_trie(strings, group, known)
        else:  # multikey quicksort, eight bytes a step
            keys = [strings[i][depth:depth + 8] for i in group]
            pivot = keys[len(keys) // 2]
            low, same, high = [], [], []
            for i, key in zip(group, keys):
                (same if key == pivot else low if key < pivot else high).append(i)
            stack += [(part, d) for part, d in ((high, depth), (same, depth + 8 if len(pivot) == 8 else known + SHALLOW), (low, depth)) if part]
    return order, [_common(strings[a], strings[b], known) for a, b in zip(order, order[1:])]


def _paths(strings: list[bytes], known: int) -> list[list[tuple[int, int]]]:
    """For each string the classes it is in, as (common prefix of the class, class), from the narrowest to the widest."""
    order, common = deep_shallow(strings, known)
    parent: dict[int, int] = {}
    depth: dict[int, int] = {}
    stack: list[int] = []  # open classes, deeper and deeper
    number = len(strings)
    for k in range(len(order)):
        near = common[k] if k < len(common) else -1
        node = order[k]
        while stack and depth[stack[-1]] > near:
            above = stack.pop()
            parent[node] = above
            node = above
        if near >= 0:
            if not stack or depth[stack[-1]] < near:
                depth[number] = near
                stack.append(number)
                number += 1
            parent[node] = stack[-1]
    paths = []
    for i, s in enumerate(strings):
        path, node = [(len(s), i)], i
        while node in parent:
            node = parent[node]
            path.append((depth[node], node))
        paths.append(path)
    return paths


def _nearest(strings: list[bytes], known: int) -> list[int]:
    """The longest prefix that each string shares with any other: that of a neighbour in sorted order."""
    order, common = deep_shallow(strings, known)
    out = [0] * len(strings)
    for i, a, b in zip(order, [0, *common], [*common, 0]):
        out[i] = max(a, b)
    return out


def covered(before: list[bytes], after: list[bytes], weight: list[int]) -> list[tuple[int, int] | None]:
    """How far repeats reach around each anchor of one gram: bytes before and after it, or None.

    ``before`` is reversed and ends ``LENGTH - GRAM`` bytes away or at the text's start; ``after`` begins with the gram. ``weight`` is the number of
    occurrences with exactly these bytes. A window with ``o`` bytes before the anchor is shared by the strings in one class of
    depth ``o`` before and one of depth ``LENGTH - o`` after. Both classes change at few ``o``.
    """
    if len(before) == 2:  # two leaves: one branch before and one after
        b, a = _common(*before, 0), _common(*after, GRAM)
        return [(b, a) if a + b >= LENGTH else None] * 2
    # a shared window holds _HALF bytes before the anchor, or all but as many after it
    near, far = Counter(b[:_HALF] for b in before), Counter(a[:LENGTH - _HALF] for a in after)
    able = [near[b[:_HALF]] > 1 or far[a[:LENGTH - _HALF]] > 1 for b, a in zip(before, after)]
    if all(able):
        # nor can it be shared where not even the strings next to one in both orders have enough in common
        able = [b + a >= LENGTH for b, a in zip(_nearest(before, 0), _nearest(after, GRAM))]
    if not all(able):
        left = [x for x, y in enumerate(able) if y]
        found = iter(covered([before[x] for x in left], [after[x] for x in left], [weight[x] for x in left]) if left else ())
        return [next(found) if y else None for y in able]
    back, front = _paths(before, 0), _paths(after, GRAM)
    pieces: list[list[tuple[int, int, tuple[int, int]]]] = []
    shared: Counter = Counter()
    for x in range(len(before)):
        first, last = max(0, LENGTH - len(after[x])), min(LENGTH - GRAM, len(before[x]))
        steps = {first} | {LENGTH - d for d, _ in front[x]} | {d + 1 for d, _ in back[x]}
        steps = sorted(o for o in steps if first <= o <= last)
        own = []
        for o, following in zip(steps, [*steps[1:], last + 1]):
            key = (next(n for d, n in reversed(front[x]) if d >= LENGTH - o), -1 if o == 0 else next(n for d, n in reversed(back[x]) if d >= o))
            own.append((o, following - 1, key))
            shared[key, o] += weight[x]
        pieces.append(own)
    # a key's members break at the same o: their classes are the same from there on
    total: Counter = Counter()
    for (key, _), n in shared.items():
        total[key] += n
    out: list[tuple[int, int] | None] = []
    for own in pieces:
        hits = [(a, b) for a, b, key in own if total[key] > 1]
        out.append((max(b for _, b in hits), LENGTH - min(a for a, _ in hits)) if hits else None)
    return out


# --- tables ----------------------------------------------------------------------------


def _chosen(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The documents, written once: text packed, row number, size and digest under the given names."""
    keep = [c for c in docs.columns if c != "text"]
    fields = [docs.schema[c] for c in keep]
    added = [T.StructField(names[c], t) for c, t in (
        ("row", T.LongType()), ("packed", T.BinaryType()), ("bytes", T.LongType()), ("sha", T.StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, size, sha = [], [], []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                packed.append(zstandard.compress(raw, 1))
                size.append(len(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
            columns = [batch.column(c) for c in keep] + [
                batch.column(names["row"]), pa.array(packed, pa.binary()), pa.array(size, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *(f.name for f in added)])

    path = scratch_path(docs.sparkSession, "texts")
    numbered = docs.withColumn(names["row"], F.monotonically_increasing_id()).withColumn("text", F.col("text").cast("string"))
    numbered.mapInArrow(run, T.StructType(fields + added)).write.option("compression", "snappy").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of every text; those of a text that a task has sent twice already tell nothing more and stay."""
    seen: Counter = Counter()
    for batch in batches:
        grams, around, places, rows = ([np.zeros(0, np.int64)] for _ in range(4))
        for row, packed, sha in zip(*(batch.column(c).to_pylist() for c in ("row", "packed", "sha"))):
            seen[sha] += 1
            if seen[sha] > 2:
                continue
            raw = zstandard.decompress(packed)
            at, h, x = anchors(raw)
            grams.append(h)
            around.append(x)
            # place, and bytes that a window can reach after it
            places.append(at << 8 | np.minimum(len(raw) - at, LENGTH))
            rows.append(np.full(len(at), row, np.int64))
        if len(seen) > KNOWN_TEXTS:  # texts that are forgotten are sent again
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (grams, around, rows, places)], ["gram", "around", "row", "place"])


_AROUND = "gram bigint, row bigint, place bigint, copies bigint, before binary, after binary"


def _around(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["gram", "row", "place", "copies", "before", "after"]
    for batch in batches:
        rows = []
        for packed, row, at in zip(batch["packed"], batch["row"], batch["at"]):
            raw = zstandard.decompress(packed)
            for p in at:
                place = p["place"]
                rows.append((p["gram"], row, place, p["copies"], raw[max(0, place - LENGTH + GRAM):place][::-1], raw[place:place + LENGTH]))
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


def _reach(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by gram; each gram's suffixes are sorted together."""
    gram, held = None, []

    def sort() -> list[tuple[int, int, int]]:
        same: dict[tuple[bytes, bytes], list[tuple[int, int, int]]] = {}
        for row, place, copies, before, after in held:
            same.setdefault((before, after), []).append((row, place, copies))
        keys = list(same)
        found = covered([b for b, _ in keys], [a for _, a in keys], [sum(c for *_, c in same[k]) for k in keys])
        return [(row, place - f[0], place + f[1]) for k, f in zip(keys, found) if f for row, place, copies in same[k] if copies == 1]

    for batch in batches:
        out = []
        for g, row, place, copies, before, after in zip(*(batch[c] for c in ("gram", "row", "place", "copies", "before", "after"))):
            if g != gram:
                if len(held) > 1 or held and held[0][2] > 1:
                    out += sort()
                gram, held = g, []
            held.append((row, place, copies, before, after))
        yield pd.DataFrame(out, columns=["row", "from", "to"])
    if len(held) > 1:
        yield pd.DataFrame(sort(), columns=["row", "from", "to"])


def _windows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window around an anchor, by two hashes."""
    for batch in batches:
        out = []
        for row, place, copies, before, after in zip(*(batch[c] for c in ("row", "place", "copies", "before", "after"))):
            raw = before[::-1] + after
            if len(raw) >= LENGTH:
                one, two = window_hashes(raw, LENGTH).view(np.int64), [hashlib.blake2b(raw[k:k + LENGTH], digest_size=7).digest() for k in range(len(raw) - LENGTH + 1)]
                out += [(int(h), int.from_bytes(d, "big"), row, place - len(before) + k, copies) for k, (h, d) in enumerate(zip(one, two))]
        yield pd.DataFrame(out, columns=["h", "d", "row", "from", "copies"])


def repeats(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(spans, groups)`` of a table ``row, packed, bytes, sha`` that is written.

    ``groups`` has ``sha, first, copies`` of every text of ``LENGTH`` bytes or more; a text with copies is a repeat as a whole.
    ``spans`` has ``row, spans``: repeated stretches ``[from, to)`` of texts without copies, of which ``row`` is the only one.
    """
    spark = texts.sparkSession
    long = texts.filter(F.col("bytes") >= LENGTH)
    groups = written_once(long.groupBy("sha").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")))
    seen = long.select("row", "packed", "sha").mapInArrow(_occurrences, "gram bigint, around bigint, row bigint, place bigint")
    by_gram = Window.partitionBy("gram").orderBy("around", "row", "place")
    met = seen.select(
        "*", F.lag("around").over(by_gram).alias("prior"), F.lead("around").over(by_gram).alias("next"),
        F.first("around").over(by_gram.rowsBetween(Window.unboundedPreceding, 0)).alias("least"))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    twice = is_(F.col("prior") == F.col("around")) | is_(F.col("next") == F.col("around"))
    others = is_(F.col("next") != F.col("around")) | (F.col("least") != F.col("around"))
    last = F.col("next").isNull() | (F.col("next") != F.col("around"))
    # a suffix to sort, or the one that stands for several with the same surroundings
    carried = others & (last | ~twice)
    path = scratch_path(spark, "suffixes")
    met.select(
        F.when(carried, F.col("gram")).alias("gram"), "row", "place", twice.alias("whole"), carried.alias("carried"), F.when(twice, 2).otherwise(1).cast("bigint").alias("copies")
    ).filter("whole OR carried").write.option("compression", "snappy").parquet(path)
    sifted = spark.read.parquet(path)
    del seen, met
    free_shuffles(spark)  # those of all anchors are the largest, and are read no more
    spot = F.shiftright("place", 8)
    whole = sifted.filter("whole").select(
        "row", F.greatest(spot - (LENGTH - GRAM), F.lit(0)).alias("from"), (spot + F.col("place").bitwiseAND(F.lit(255))).alias("to"))
    often = sifted.filter("carried").groupBy("gram").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > MOST_OCCURRENCES)
    hot_grams = written_once(often.select("gram", F.lit(True).alias("hot")))
    places = written_once(
        sifted.filter("carried").join(hot_grams, "gram", "left").groupBy("row", F.coalesce("hot", F.lit(False)).alias("hot"))
        .agg(F.collect_list(F.struct("gram", spot.alias("place"), "copies")).alias("at")))
    packed = texts.select("row", "packed")

    def around(part: DataFrame) -> DataFrame:
        return packed.join(part.select("row", "at"), "row").select("row", "packed", "at").mapInPandas(_around, _AROUND)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = around(places.filter("NOT hot")).repartition(parts, "gram").sortWithinPartitions("gram")
    reach = sorted_.mapInPandas(_reach, "row bigint, from bigint, to bigint").unionByName(whole)
    if not places.filter("hot").isEmpty():
        windows = written_once(around(places.filter("hot")).mapInPandas(_windows, "h bigint, d bigint, row bigint, from bigint, copies bigint").distinct())
        again = windows.groupBy("h", "d").agg(F.sum("copies").alias("n")).filter("n > 1")
        reach = reach.unionByName(windows.filter("copies = 1").join(again, ["h", "d"]).select("row", "from", (F.col("from") + LENGTH).alias("to")))
    copied = texts.select("row", "sha").join(groups.filter("copies > 1").select("sha"), "sha").select("row")  # go as a whole
    spans = reach.join(copied, "row", "left_anti").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))
    return spans, groups


def _merged(spans: Iterable) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["from"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["to"])
        else:
            out.append([s["from"], s["to"]])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row, packed, spans in zip(batch["row"], batch["packed"], batch["spans"]):
            merged = _merged(spans)
            kept = _kept(zstandard.decompress(packed), merged)
            rows.append((row, sum(b - a for a, b in merged), len(merged), hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["cut_row", "removed", "n_spans", "kept"])


_NAMES = {c: c for c in ("row", "packed", "bytes", "sha")}


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    A byte goes if a string of ``LENGTH`` bytes covers it that also starts anywhere else, in the same document or another. A null text
    is empty. Texts below that length lose nothing. Repeated rows are documents of their own, so all of their bytes go. An empty table gives
    no rows. Columns other than id and text are not read.
    """
    texts = _chosen(docs.select("doc_id", "text"), _NAMES)
    spans, groups = repeats(texts)
    cuts = texts.select("row", "packed").join(spans, "row").mapInPandas(_cut, "cut_row bigint, removed bigint, n_spans bigint, kept string")
    joined = texts.select("row", "doc_id", "bytes", "sha").join(groups, "sha", "left").join(cuts, F.col("row") == F.col("cut_row"), "left")
    whole = F.coalesce(F.col("copies") > 1, F.lit(False))
    none = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id", F.col("bytes").alias("n_bytes"),
        F.when(whole, F.col("bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, none).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated bytes removed from ``text``; every document and column stays.

    A character that is cut in two goes as a whole. ``n_chars``, where there is one, follows.
    """
    names = dict(zip(_NAMES, fresh(docs, *_NAMES)))
    stored = _chosen(docs, names)
    spans, groups = repeats(stored.select(*[F.col(n).alias(c) for c, n in names.items()]))
    span, whole, row, text = fresh(stored, "spans", "whole", "row_of", "text_of")
    # what is known of a row is small: the texts themselves are joined once
    copied = stored.select(F.col(names["row"]).alias(row), F.col(names["sha"]).alias("sha")).join(groups.filter("copies > 1").select("sha"), "sha")
    facts = spans.select(F.col("row").alias(row), F.col("spans").alias(span), F.lit(False).alias(whole)).unionByName(
        copied.select(row, F.lit(None).cast(spans.schema["spans"].dataType).alias(span), F.lit(True).alias(whole)))
    joined = stored.join(facts, F.col(names["row"]) == F.col(row), "left")

    def rest(packed: pd.Series, spans: pd.Series, whole: pd.Series) -> pd.Series:
        out = []
        for p, s, w in zip(packed, spans, whole):
            raw = b"" if w is True or w == 1 else zstandard.decompress(p)
            out.append((raw if s is None or not raw else _kept(raw, _merged(s))).decode("utf-8", "ignore"))
        return pd.Series(out)

    cut = F.pandas_udf(rest, T.StringType())(F.col(names["packed"]), F.col(span), F.coalesce(F.col(whole), F.lit(False)))
    out = joined.withColumn(text, cut)
    chosen = [F.col(text).alias(c) if c == "text" else F.length(text).cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*chosen)
