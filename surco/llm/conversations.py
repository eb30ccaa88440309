"""Repair of conversation structure: the cheapest edits that make roles alternate, found while the turns stream by.

Conversations are dealt out by their id and sorted by turn inside each partition; ``mapInPandas`` then carries one state
across Arrow batches: for each of the four places of the role pattern ``(s?(ua)+)?`` the least cost so far, and the order in which
the edit strings that reach them sort. No two of these strings begin alike to the end of one (each ends with the edit of the last
row), so their order is all that later ties can depend on. A row adds four bytes of backpointers. These and the texts are kept in
spooled files, in memory up to ``SPOOL_BYTES`` and from there in a nameless file of the task, so a conversation of any
length takes a fixed amount of memory.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
ROLES = {"u": "user", "a": "assistant"}
SPOOL_BYTES = 4 << 20
SPACE = "\t\n\u000b\u000c\r "
#: Places in the role pattern: before anything, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
_EDITS = KEEP + REROLE + DELETE
_FIRST = ((0, 0), None, None, None)


def _after_inserts(place: int, k: int) -> int:
    for _ in range(k):
        place = _NEXT[place][1]
    return place


@lru_cache(maxsize=1 << 16)
def _step(state: tuple, initial: str, must_go: bool, truncated: bool) -> tuple[tuple, int, int]:
    """The next state, the cost that all its places have in common, and the backpointers, one byte a place.

    A state has for each place the cost (the least is 0) and the rank of its edit string, or None.
    """
    best: list[tuple | None] = [None] * 4
    for place, known in enumerate(state):
        if known is None:
            continue
        cost, rank = known
        for k in range(3):  # more inserts come back to a place for more
            at = _after_inserts(place, k)
            ways = [(DELETE, at, 0)]
            if not must_go:
                role, to = _NEXT[at]
                extra = TRUNCATED if truncated else 0
                ways.append((REROLE, to, extra))
                if initial == role:
                    ways.append((KEEP, to, extra))
                elif initial == "s" and at == START:
                    ways.append((KEEP, SYSTEM, extra))
            for edit, to, extra in ways:
                found = (cost + k * COST[INSERT] + COST[edit] + extra, rank, INSERT * k + edit, place, k, edit)
                if best[to] is None or found[:3] < best[to][:3]:
                    best[to] = found
    order = sorted((found[1:3], to) for to, found in enumerate(best) if found)
    ranks = {to: r for r, (_, to) in enumerate(order)}
    least = min(found[0] for found in best if found)
    back = 0
    for to, found in enumerate(best):
        if found:
            back |= (found[3] | found[4] << 2 | _EDITS.index(found[5]) << 4) << 8 * to
    return tuple((found[0] - least, ranks[to]) if found else None for to, found in enumerate(best)), least, back


def _finish(state: tuple) -> tuple[int, int, int]:
    """The least further cost to an allowed end, the place it starts from and the number of inserts."""
    found = [
        (known[0] + k * COST[INSERT], known[1], k, place)
        for place, known in enumerate(state) if known for k in range(3) if _after_inserts(place, k) in (START, ASSISTANT)]
    cost, _, k, place = min(found)
    return cost, place, k


class _Conversation:
    """One conversation while its turns stream by."""

    def __init__(self):
        self.state, self.cost, self.rows = _FIRST, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last_initial: str | None = None
        self.turns = self.least_turn = self.most_turn = 0
        self.turn: int | None = None
        self.back = tempfile.SpooledTemporaryFile(SPOOL_BYTES)
        self.said = tempfile.SpooledTemporaryFile(SPOOL_BYTES)

    def add(self, turn: int | None, role: str, text: str, initial: str, fault: str) -> None:
        if turn is not None and turn != self.turn:
            self.least_turn = turn if not self.turns else self.least_turn
            self.most_turn, self.turn, self.turns = turn, turn, self.turns + 1
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        if fault == "blank":
            self.blank += 1
        elif fault == "duplicate":
            self.duplicate += 1
        elif fault == "truncated":
            self.truncated += 1
        self.state, cost, back = _step(self.state, initial if initial in "sua" else "", fault in ("blank", "duplicate"), fault == "truncated")
        self.cost += cost
        self.rows += 1
        self.back.write(struct.pack("<I", back))
        name, body = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        self.said.write(struct.pack("<qQQ", -1 if turn is None else turn, len(name), len(body) << 1 | (turn is None)) + name + body)

    @property
    def gaps(self) -> int:
        return self.most_turn - self.least_turn + 1 - self.turns if self.turns else 0

    def _chosen(self, place: int) -> Iterator[tuple[int, np.ndarray]]:
        """Chunks of the chosen edit of each row, the last chunk first: number of the first row, and inserts | edit << 2."""
        end = self.rows
        while end:
            begin = max(0, end - SPOOL_BYTES // 4)
            self.back.seek(4 * begin)
            back = np.frombuffer(self.back.read(4 * (end - begin)), "<u4").tolist()
            picked = bytearray(len(back))
            for i in range(len(back) - 1, -1, -1):
                byte = back[i] >> 8 * place & 0xFF
                place = byte & 3
                picked[i] = byte >> 2
            yield begin, picked
            end = begin

    def edits(self) -> Iterator[tuple[str, int | None, str, str]]:
        """``(edit, turn, role, text)`` in order: the row as it stays, a deleted one as it was, an insert with an empty text."""
        cost, place, k = _finish(self.state)
        self.cost += cost
        picked = tempfile.SpooledTemporaryFile(SPOOL_BYTES)
        for begin, part in self._chosen(place):
            picked.seek(begin)
            picked.write(part)
        picked.seek(0)
        self.said.seek(0)
        at = START
        for i in range(self.rows):
            byte = picked.read(1)[0]
            for _ in range(byte & 3):
                role, at = _NEXT[at]
                yield INSERT, None, ROLES[role], ""
            turn, named, size = struct.unpack("<qQQ", self.said.read(24))
            name, body = (self.said.read(n).decode("utf-8", "surrogatepass") for n in (named, size >> 1))
            edit = _EDITS[byte >> 2]
            if edit == KEEP:
                at = SYSTEM if at == START and name[:1] == "s" else _NEXT[at][1]
            elif edit == REROLE:
                role, at = _NEXT[at]
                name = ROLES[role]
            yield edit, None if size & 1 else turn, name, body
        for _ in range(k):
            role, at = _NEXT[at]
            yield INSERT, None, ROLES[role], ""
        picked.close()

    def close(self) -> None:
        self.back.close()
        self.said.close()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, gone`` of a table of turns with planted faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays, marked ``gone``), 1 empties the text, 2 takes the marks ``.!?`` out of it, 3 repeats the row, 4 makes the
    role ``user``. A null role or text, and a null id or turn in the crc, is one space.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    return rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), (kind == 0).alias("gone"))


def _ordered(rows: DataFrame) -> DataFrame:
    """The turns by conversation and turn, each with its role's initial and its first fault; one shuffle.

    The window that finds earlier equal turns is partitioned by more columns than the rows are dealt by, so it stays in the partition;
    it and the last sort spill.
    """
    extra = [c for c in ("copy", "gone") if c in rows.columns]
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in extra else F.lit(False)
    filled = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), gone.alias("gone"), (F.col("copy") if "copy" in extra else F.lit(0)).alias("copy"))
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    shown = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(shown == "", "blank").when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))
    return filled.repartition("conv_id").withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1)).sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "gone", F.col("turn").asc_nulls_first(), "role", "text", "copy"
    ).select(F.col("conv_id").cast("string").alias("key"), "gone", F.col("turn").cast("string").alias("turn"), "role", "text", "initial", "fault")


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, _Conversation]]:
    key, own = None, None
    for batch in batches:
        for k, gone, turn, role, text, initial, fault in zip(*(batch[c].tolist() for c in batch.columns)):
            k = None if pd.isna(k) else k
            if own is None or k != key:
                if own is not None:
                    yield key, own
                    own.close()
                key, own = k, _Conversation()
            if not gone:
                own.add(None if pd.isna(turn) else int(turn), role, text, initial, fault)
    if own is not None:
        yield key, own
        own.close()


_REPORT = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation of a table of turns: its faults, and cost, edits and digest of its cheapest repair.

    Turns go by ``turn``, nulls first; turns of one number by role and text. A null role or text is one space. ``gaps`` counts turn numbers missing
    between the least and the most; every turn counts by its first fault: ``blank`` (no word), ``duplicate`` (role and text seen earlier in the
    conversation), ``truncated`` (last mark not ``.!?``). ``illegal`` counts neighbours whose roles may not follow each other. ``audit`` has
    the initials of the edits Keep, Rerole, Delete and Insert in order, of all cheapest repairs the least text. ``repaired_sha256`` is of the lines
    ``role:text`` that stay. A null id is a conversation of its own. A conversation all of whose rows are marked ``gone`` has zeros, an
    empty audit and the digest of the empty text. An empty table gives no row; other columns are not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for key, own in _streamed(batches):
            digest, audit, begun = hashlib.sha256(), [], False
            for edit, _, role, text in own.edits():
                audit.append(edit)
                if edit != DELETE:
                    digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    begun = True
            held.append((key, own.gaps, own.blank, own.duplicate, own.truncated, own.illegal, own.cost, "".join(audit), digest.hexdigest()))
            if len(held) == 1000 or own.rows > 1000:
                yield pd.DataFrame(held, columns=_COLUMNS)
                held = []
        if held:
            yield pd.DataFrame(held, columns=_COLUMNS)

    kind = rows.schema["conv_id"].dataType
    return _ordered(rows).mapInPandas(run, _REPORT).select(F.col("key").cast(kind).alias("conv_id"), *_COLUMNS[1:])


_COLUMNS = [c.split()[0] for c in _REPORT.split(", ")]
_BATCH_ROWS, _BATCH_CHARS = 5_000, 8 << 20


def repaired(rows: DataFrame) -> DataFrame:
    """The turns after repair: ``conv_id, place, edit, turn, role, text``, ``place`` counting from 0 in each conversation.

    Deleted turns are left out; inserted ones have no turn number and an empty text. Nulls, ties, repeated rows, ``gone`` and
    an empty table as in ``report``; a conversation of which nothing stays has no row.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chars = [], 0
        for key, own in _streamed(batches):
            place = 0
            for edit, turn, role, text in own.edits():
                if edit == DELETE:
                    continue
                held.append((key, place, edit, None if turn is None else str(turn), role, text))
                place += 1
                chars += len(text)
                if len(held) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                    yield pd.DataFrame(held, columns=["key", "place", "edit", "turn", "role", "text"])
                    held, chars = [], 0
        if held:
            yield pd.DataFrame(held, columns=["key", "place", "edit", "turn", "role", "text"])

    kind = rows.schema["conv_id"].dataType
    return _ordered(rows).mapInPandas(run, "key string, place bigint, edit string, turn string, role string, text string").select(
        F.col("key").cast(kind).alias("conv_id"), "place", "edit", F.col("turn").cast("bigint").alias("turn"), "role", "text")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """The report over all conversations of the table after planted damage, those included that lost every row."""
    return report(damaged(rows))
