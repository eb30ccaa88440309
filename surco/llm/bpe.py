"""Byte-level BPE by a public rank file: texts to ids and back, merged as padded matrices of whole buckets of pieces.

A text is parted by the vocabulary's pattern. A part that is a token is done; the others, each distinct one once, are laid into
matrices, one row a part and one column a byte, parts of about one length together. A round looks up the rank of every pair of neighbours
that changed (two hash tables: bytes of a pair of ids, then the merged id), merges in each row the leftmost pair of the least rank, and
closes the gap, so that every row left is one column shorter; rows without a pair to merge are done. This is
what the tiktoken library does with a part, one merge after another.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from surco.llm.pieces import PieceCoder, blocks

#: Cells of one matrix, about; a part longer than that is a matrix by itself.
MATRIX_CELLS = 1 << 20
_NONE = np.int32(np.iinfo(np.int32).max)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_coders: dict[tuple[str, str], Coder] = {}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank; ranks have no gaps."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("the ranks of the file have gaps")
    return [found[r] for r in range(len(found))]


class PairTable:
    """Open-addressed hash table from two ids to the id of their bytes together, looked up for whole arrays."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        pairs = [(ids[t[:k]], ids[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ids = np.full(size, _NONE, np.int32)
        self.probes = 0
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        key, open_ = left << 32 | right, np.arange(len(pairs))
        slot = self._slots(key)
        while len(open_):  # every round each free place takes one of those that want it
            free = self.keys[slot[open_]] < 0
            self.keys[slot[open_[free]]] = key[open_[free]]
            won = self.keys[slot[open_]] == key[open_]
            self.ids[slot[open_[won]]] = merged[open_[won]]
            open_ = open_[~won]
            slot[open_] = slot[open_] + 1 & size - 1
            self.probes += 1

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair's bytes, or ``_NONE``; -1 pairs with nothing."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        slot = self._slots(key)
        out = np.full(key.shape, _NONE, np.int32)
        for _ in range(self.probes):
            seen = self.keys[slot]
            hit = seen == key
            out[hit] = self.ids[slot[hit]]
            if (hit | (seen == -1)).all():
                break
            slot = slot + 1 & len(self.keys) - 1
        return out


class Coder(PieceCoder):
    """Ids of texts and bytes of ids for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        tokens = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.of_token = {t: i for i, t in enumerate(tokens)}
        self.of_byte = np.array([self.of_token[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(tokens)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each part, none of them empty."""
        out: list[np.ndarray | None] = [None] * len(parts)
        size = np.array([len(p) for p in parts], np.int64)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            # a bucket: lengths from n to 1.25 n and as many rows as the cells allow
            most = int(np.searchsorted(size[order], size[order[at]] * 5 // 4, "right"))
            to = max(at + 1, min(most, at + MATRIX_CELLS // max(1, int(size[order[most - 1]]))))
            self._bucket(parts, order[at:to], size, out)
            at = to
        return out

    def _bucket(self, parts: list[bytes], rows: np.ndarray, size: np.ndarray, out: list) -> None:
        n = size[rows]
        width = int(n.max())
        inside = np.arange(width) < n[:, None]
        ids = np.full(inside.shape, -1, np.int32)
        ids[inside] = self.of_byte[np.frombuffer(b"".join([parts[r] for r in rows]), np.uint8)]
        rank = self.pairs.merged(ids[:, :-1], ids[:, 1:])
        rank = np.concatenate((rank, np.full((len(rows), 1), _NONE, np.int32)), axis=1)
        while len(rows):
            place = rank.argmin(axis=1)
            line = np.arange(len(rows))
            best = rank[line, place]
            done = best == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = ids[k, :n[k]].copy()
                left = ~done
                rows, n, ids, rank, place, best = rows[left], n[left], ids[left], rank[left], place[left], best[left]
                if not len(rows):
                    break
                line = np.arange(len(rows))
            ids[line, place] = best
            # close the gap right of each merged pair: one cell of every row goes
            n = n - 1
            width = ids.shape[1] - 1
            if len(rows) == 1:
                p = int(place[0])
                ids[0, p + 1:-1], rank[0, p + 1:-1] = ids[0, p + 2:].copy(), rank[0, p + 2:].copy()
                ids, rank = ids[:, :-1], rank[:, :-1]
            else:
                keep = np.ones(ids.shape, bool)
                keep[line, place + 1] = False
                ids, rank = ids[keep].reshape(-1, width), rank[keep].reshape(-1, width)
            after = np.where(place + 1 < n, ids[line, np.minimum(place + 1, width - 1)], -1)
            rank[line, place] = self.pairs.merged(best, after)
            has = np.flatnonzero(place)
            rank[line[has], place[has] - 1] = self.pairs.merged(ids[line[has], place[has] - 1], best[has])

    def whole(self, texts: list[str]) -> list[bytes]:
        return self.pieces(texts)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; each distinct part is encoded once, and remembered like a piece."""
        parted = [self.pattern.findall(p) for p in pieces]
        parts = list({p for parts in parted for p in parts})
        ids, unseen = self.known.find(parts)
        new = [parts[k] for k in unseen]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        own = [self.of_token.get(r) for r in raw]
        merged = iter(self.merge([r for r, o in zip(raw, own) if o is None]))
        found = [(next(merged).astype("<u4") if o is None else np.array([o], "<u4")).tobytes() for o in own]
        self.known.put(new, found)
        for k, i in zip(unseen, found):
            ids[k] = i
        of_part = dict(zip(parts, ids))
        return [of_part[parts[0]] if len(parts) == 1 else b"".join([of_part[q] for q in parts]) for parts in parted]

    def each(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        ids, n = self.encode(texts)
        return np.split(ids.astype("<u4", copy=False), np.cumsum(n)[:-1]) if len(n) else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids in a row."""
        size = self.size[ids]
        upto = np.cumsum(size)
        at = np.repeat(self.start[ids] - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)
        return self.bytes[at].tobytes()


def coder(path: str, pattern: str) -> Coder:
    """The worker's coder of a rank file; it outlives a task."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, little-endian unsigned 32-bit numbers in one binary value.

    A null or empty text has none. Every row stays, repeated ones and null ids too; an empty table gives no row; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for at, texts in blocks(pc.fill_null(batch.column("text").cast(pa.string()), "")):
                ids = [i.tobytes() for i in own.each(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(ids)), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decoded(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids``; null ids give no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for at, ids in blocks(pc.fill_null(batch.column("ids"), b"")):
                texts = [own.decode(np.frombuffer(i, "<u4")) for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document: its ids, and the bytes that these decode to.

    Both steps in one pass over the texts, so that neither ids nor bytes travel. Nulls, empty texts and repeated rows as in ``encoded``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for at, texts in blocks(pc.fill_null(batch.column("text").cast(pa.string()), "")):
                ids = own.each(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(ids)), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids], pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
