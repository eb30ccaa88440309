"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A paragraph is a run of text up to the next punctuation mark or line end. Its digest, with the number of earlier
paragraphs of the text that are equal to it, is a key; a key is added to ``HASHES`` cells, each with a count, the
xor of its keys and the xor of their checks. Cells subtract, so two sketches give the sketch of their difference;
peeling the cells that hold one key recovers the differing digests. Where peeling gets stuck, it is
repeated with a sketch twice as large.

All sketches of a batch are built and peeled together, as one array of cells.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from surco.session import written_once

CELLS, HASHES = 32, 3
#: Documents of a run whose neighbours are at hand, and of a batch that is sketched at once.
RUN_DOCS, BATCH_DOCS = 2_000, 200
#: The most runs: their first ids are held by every task. A run is streamed, so it may be long.
MAX_RUNS = 20_000
_PARAGRAPH = re.compile(r"[^.,!?;:|\n]*[.,!?;:|\n]+[ \t]*|[^.,!?;:|\n]+")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def paragraphs(text: str) -> list[bytes]:
    return [p.encode("utf-8", "surrogatepass") for p in _PARAGRAPH.findall(text)]


def digests(text: str) -> np.ndarray:
    """One key per paragraph; the k-th copy of a paragraph has a key of its own."""
    own = np.fromiter((xxh64_intdigest(p) for p in paragraphs(text)), np.uint64)
    if not len(own):
        return own
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return _mix(ranked + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _M1
    x = (x ^ x >> np.uint64(33)) * _M2
    return x ^ x >> np.uint64(33)


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys ^ np.uint64(0x5BD1E995A1B2C3D4))


class Cells:
    """Sketches of ``n`` sets of ``cells`` cells each; cell k of a key lies in the k-th part of the sketch."""

    def __init__(self, n: int, cells: int = CELLS):
        self.n, self.part = n, max(cells // HASHES, 1)
        self.cells = self.part * HASHES
        self.count = np.zeros(n * self.cells, np.int64)
        self.keys = np.zeros(n * self.cells, np.uint64)
        self.checks = np.zeros(n * self.cells, np.uint64)

    def add(self, sets: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        check = _check(keys)
        for k in range(HASHES):
            spread = _mix(keys + np.uint64(k * 0x1000193 + self.cells))
            at = sets * self.cells + k * self.part + (spread % np.uint64(self.part)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)

    def texts(self) -> list[str]:
        """Each sketch as text: counts, keys and half of the checks."""
        count = self.count.astype("<u4").reshape(self.n, -1)
        keys = self.keys.astype("<u8").reshape(self.n, -1)
        checks = (self.checks & np.uint64(0xFFFFFFFF)).astype("<u4").reshape(self.n, -1)
        return [base64.b64encode(c.tobytes() + k.tobytes() + x.tobytes()).decode() for c, k, x in zip(count, keys, checks)]

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """How many keys each difference has, and whether all were recovered."""
        found = np.zeros(self.n, np.int64)
        while True:
            pure = np.flatnonzero((np.abs(self.count) == 1) & (self.checks == _check(self.keys)))
            if not len(pure):
                break
            sets, keys, sign = pure // self.cells, self.keys[pure], self.count[pure]
            _, once = np.unique(np.stack((sets.astype(np.uint64), keys)), axis=1, return_index=True)
            sets, keys, sign = sets[once], keys[once], sign[once]
            found += np.bincount(sets, minlength=self.n)
            self.add(sets, keys, -sign)
        open_ = (self.count != 0) | (self.keys != 0)
        return found, ~open_.reshape(self.n, -1).any(axis=1)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = [len(s) for s in sets]
    return np.repeat(np.arange(len(sets)), size), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Sizes of the symmetric differences of the pairs of key sets, recovered from subtracted sketches.

    A pair whose sketch does not peel is sketched anew with twice the cells, until it does.
    """
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    while len(left):
        sketch = Cells(len(left), cells)
        sketch.add(*_flat([a[i] for i in left]), 1)
        sketch.add(*_flat([b[i] for i in left]), -1)
        found, done = sketch.peel()
        out[left[done]] = found[done]
        left = left[~done]
        cells *= 2
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared paragraphs over all paragraphs of each pair; 1 for two empty texts."""
    d = differences(a, b)
    shared = (np.array([len(x) for x in a]) + np.array([len(x) for x in b]) - d) / 2
    return np.where(shared + d > 0, shared / np.maximum(shared + d, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _sketched(docs: list[tuple[int | None, str]], following: list[str]) -> pd.DataFrame:
    texts = [t for _, t in docs]
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own, new = [digests(t) for t in texts], [digests(t) for t in changed]
    after = own[1:] + [digests(following[-1])]  # the documents of a batch follow each other

    def prints(sets: list[np.ndarray]) -> list[str]:
        cells = Cells(len(sets))
        cells.add(*_flat(sets), 1)
        return cells.texts()

    return pd.DataFrame({
        "doc_id": pd.array([i for i, _ in docs], "Int64"), "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": prints(own), "edited_fingerprint": prints(new), "near_edited": likeness(own, new), "near_next": likeness(own, after),
    })


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pack(text: str | None) -> bytes:
    return zstandard.compress((text or "").encode("utf-8", "surrogatepass"), 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the likeness to the edited and to the next text.

    Documents are in descending order of ``doc_id`` (null last; equal ids by the hash of the text); the next one of the
    last is the first. A null text is empty. A single document follows itself. An empty table gives no rows.
    The ids are cut into runs of about ``RUN_DOCS`` documents; the head of a run also goes to the run before it, so
    each task has the neighbours that it needs and texts move once.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids = written_once(named.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place")))
    total, top = ids.agg(F.count(F.lit(1)), F.max("place")).first()
    if not total:
        return spark.createDataFrame([], _RESULT)
    runs = min(-(-total // RUN_DOCS), MAX_RUNS)
    # one id per run, in exact ranks, not in estimates that depend on the order of merging
    heads = sorted({top, *_cuts(ids, runs, total)}, reverse=True)
    number = {h: k for k, h in enumerate(heads)}
    bounds = np.array(heads[::-1], np.int64)

    def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows ``run, place, guest``: every document in its run, heads also as guests of the run before."""
        for batch in batches:
            place = [-(1 << 63) if pd.isna(x) else int(x) for x in batch["doc_id"]]
            run = len(bounds) - 1 - np.searchsorted(bounds, np.array(place, np.int64), side="left")
            rows = []
            for p, k, text in zip(place, run.tolist(), batch["text"]):
                packed, tie = _pack(text), xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 1
                rows.append((k, False, p, tie, packed))
                if p in number:
                    rows.append(((k - 1) % len(bounds), True, p, tie, packed))
            yield pd.DataFrame(rows, columns=["run", "guest", "place", "tie", "packed"])

    def sketch(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int | None, str]] = []
        run = -1
        for batch in batches:
            for k, guest, place, packed in zip(batch["run"], batch["guest"], batch["place"], batch["packed"]):
                if k != run:
                    held, run = [], k
                elif guest and not held:
                    continue  # a further row of the head's id
                text = zstandard.decompress(packed).decode("utf-8", "surrogatepass")
                if guest:
                    yield _sketched(held, [t for _, t in held[1:]] + [text])
                    held = []
                    continue
                if len(held) >= BATCH_DOCS:
                    yield _sketched(held, [t for _, t in held[1:]] + [text])
                    held = []
                held.append((None if place == -(1 << 63) else place, text))

    dealt = named.mapInPandas(deal, "run int, guest boolean, place bigint, tie bigint, packed binary")
    parts = max(1, min(runs, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    return dealt.repartition(parts, "run").sortWithinPartitions("run", "guest", F.desc("place"), "tie").select(
        "run", "guest", "place", "packed").mapInPandas(sketch, _RESULT)


def _cuts(ids: DataFrame, runs: int, total: int) -> list[int]:
    """The ids at evenly spaced places, about one per run."""
    step = -(-total // runs)
    ranked = ids.repartitionByRange(max(1, total // 1_000_000), "place").sortWithinPartitions("place")

    def pick(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for batch in batches:
            yield batch.iloc[[k for k in range(len(batch)) if (at + k) % step == 0]]
            at += len(batch)

    return [r["place"] for r in ranked.mapInPandas(pick, "place bigint").distinct().collect()]
