"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the whole instance is a count per length, never longer than
the capacity whatever the corpus. Reduction and best fit work on these counts, many equal sequences at a
time, and the plan they give is a short list of ranges; pieces find their place in it by their position
among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surco.llm.common import give_back, positions
from surco.llm.tokens import encoded, forget
from surco.session import written_once

CAPACITY = 2048
END = 0
#: Bytes of text encoded at once; while a block is at work, its pieces take many times as much.
BLOCK_BYTES = 4 << 20


class _Stock:
    """Counts per length, with the sorted lengths that are left."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, w: int, m: int) -> None:
        self.n[w] -= m
        if not self.n[w]:
            del self.n[w]
            del self.sizes[bisect_left(self.sizes, w)]

    def most(self, limit: int, used: list[int]) -> int:
        """The largest length up to ``limit`` of which a copy is left besides ``used`` (0: none)."""
        at = bisect_right(self.sizes, limit) - 1
        while at >= 0 and self.n[self.sizes[at]] <= used.count(self.sizes[at]):
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def least(self, k: int, used: list[int]) -> list[int]:
        """The ``k`` smallest besides ``used``."""
        out: list[int] = []
        for w in self.sizes:
            out += [w] * min(k - len(out), self.n[w] - used.count(w))
            if len(out) == k:
                break
        return out


def _dominant(stock: _Stock, w: int, cap: int) -> list[int] | None:
    """A set with ``w`` that dominates every other feasible set with ``w``, if one of up to three is proven to."""
    rest = cap - w
    low = stock.least(3, [w])
    if not low or low[0] > rest:
        return [w]  # nothing else fits beside it
    p = stock.most(rest, [w])
    if p == rest or sum(low[:2]) > rest or len(low) < 2:
        return [w, p]  # a perfect pair, or no third fits: the largest partner covers any other
    if sum(low) <= rest and len(low) == 3:
        return None  # sets of four exist: left to best fit
    second = 0  # the most that the smaller of two partners can be
    at = bisect_right(stock.sizes, rest // 2) - 1
    while at >= 0 and not second:
        y = stock.sizes[at]
        if stock.most(rest - y, [w, y]) >= y:
            second = y
        at -= 1
    b = stock.most(rest - p, [w, p])
    if b and b >= second:
        return [w, p, b]
    return None


def plan(counts: dict[int, int], cap: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, from, to, sequence, per, offset)``: the pieces of this length at positions from <= o < to go,
    ``per`` to a sequence, into the sequences from ``sequence`` on, the first at ``offset``."""
    stock, groups = _Stock(counts), []
    for w in sorted(stock.n, reverse=True):
        while w in stock.n:
            chosen = _dominant(stock, w, cap)
            if chosen is None:
                break
            m = min(stock.n[x] // chosen.count(x) for x in chosen)
            for x in chosen:
                stock.take(x, m)
            groups.append((m, [(x, 1) for x in chosen]))
    groups += _best_fit(stock, cap)
    rows, taken, sequence = [], defaultdict(int), 0
    for m, content in groups:
        offset = 0
        for w, per in content:
            rows.append((w, taken[w], taken[w] + m * per, sequence, per, offset))
            taken[w] += m * per
            offset += w * per
        sequence += m
    return sorted(rows)


def _best_fit(stock: _Stock, cap: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing: each length goes to the open sequences with the least room that takes it."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)

    def put(room: int, m: int, content: list[tuple[int, int]]) -> None:
        if m:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((m, content))

    for w in sorted(stock.n, reverse=True):
        left = stock.n[w]
        while left:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                m, content = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, content = cap, []
                m = -(-left // (cap // w))
            per = room // w
            full = min(m, left // per)
            put(room - per * w, full, [*content, (w, per)])
            left -= full * per
            m -= full
            if m and left and left < per:
                put(room - left * w, 1, [*content, (w, left)])
                left, m = 0, m - 1
            if m and content:
                put(room, m, content)
    return [g for room in rooms for g in open_[room]]


def token_pieces(docs: DataFrame, path: str, cap: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids and its end id, cut from the end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, sizes in encoded(batches, path, block=BLOCK_BYTES):
            names, at = batch.column("doc_id").to_pylist(), 0
            rows: list[tuple] = []
            for name, n in zip(names, sizes.tolist()):
                own = np.append(ids[at:at + n], np.uint32(END)).astype("<u4")
                at += n
                edges = [0, *range((n + 1) % cap or cap, n + 2, cap)]
                rows += [(name, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
            give_back()
        forget(path)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, path: str, cap: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``.

    A null or empty text is its end id alone. Repeated rows and rows with a null id are packed like any other.
    An empty table gives no rows. Other columns than id and text are not read.
    """
    pieces = written_once(token_pieces(docs, path, cap))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = positions(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "place")
    ranges = np.array(plan(counts, cap), np.int64).reshape(-1, 6)
    keys = ranges[:, 0] << 48 | ranges[:, 1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place = (batch.column(c).to_numpy() for c in ("length", "place"))
            row = ranges[np.searchsorted(keys, length << 48 | place, side="right") - 1]
            nth = place - row[:, 1]
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)],
                [*names, "sequence_id", "offset"])

    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place").mapInArrow(
        find, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
