"""Ids of whole texts by their pieces: texts are cut where every vocabulary pattern cuts, and each distinct piece is encoded once."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one Python worker remembers of pieces and their ids, about.
MEMORY_BYTES = 160 << 20
#: Bytes of text encoded at once.
BLOCK_BYTES = 12 << 20
#: Two neighbours of white space or control, or a zero byte: such a text is encoded whole.
_RUN = r"[\x{0}-\x{20}\x{7f}-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]{2}|\x{0}"
#: Where a run of letters ends and a mark follows, the pattern cuts too.
_WORD_END = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:|$%&*#])"


class Memory:
    """Ids by piece, bounded in bytes: half of it is young, and what is used again moves from the old half to the young one."""

    def __init__(self, most: int = MEMORY_BYTES):
        self.most, self.held = most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, pieces: list[str]) -> tuple[list[bytes | None], list[int]]:
        """The ids of each piece and the places of those not known."""
        ids = list(map(self.young.get, pieces))
        unseen = [k for k, i in enumerate(ids) if i is None]
        if self.old and unseen:
            older = list(map(self.old.get, [pieces[k] for k in unseen]))
            again = [(k, i) for k, i in zip(unseen, older) if i is not None]
            for k, i in again:
                ids[k] = i
            self.put([pieces[k] for k, _ in again], [i for _, i in again])
            unseen = [k for k, i in zip(unseen, older) if i is None]
        return ids, unseen

    def put(self, pieces: list[str], ids: list[bytes]) -> None:
        self.young.update(zip(pieces, ids))
        self.held += 190 * len(pieces) + sum(map(len, pieces)) + sum(map(len, ids))  # two objects and their place in the table

    def age(self) -> None:
        """To be called between blocks: while one is encoded, nothing is forgotten."""
        if self.held > self.most // 2:
            self.old, self.young, self.held = self.young, {}, 0


class PieceCoder:
    """Encodes texts piece by piece: a piece begins at a single space or line end between two other characters, behind
    such a line end, and at a mark behind a letter.

    The vocabulary's pattern always parts a text there, so the ids of a text are those of its pieces in a row. ``whole`` and
    ``pieces`` give the ids of texts and of new pieces as little-endian unsigned 32-bit numbers; texts that hold one of ``unbroken`` are never cut.
    """

    unbroken: tuple[str, ...] = ()

    def __init__(self):
        self.known = Memory()

    def whole(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def pieces(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row (unsigned 32-bit), and how many each text has."""
        collects = gc.isenabled()
        gc.disable()  # it would walk the remembered pieces again and again
        try:
            return self._encode(texts)
        finally:
            self.known.age()
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, _RUN)
        for content in self.unbroken:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        if not pc.any(odd).as_py():
            return self._cut(texts)
        flags = odd.to_numpy(zero_copy_only=False)
        parts: Iterator[np.ndarray] = iter(())
        if not flags.all():
            ids, n = self._cut(texts.filter(pc.invert(odd)))
            parts = iter(np.split(ids, np.cumsum(n)[:-1]))
        long = iter(self.whole(texts.filter(odd).to_pylist()))
        each = [np.frombuffer(next(long), "<u4") if f else next(parts) for f in flags]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        split = pc.split_pattern(pc.replace_substring_regex(marked, _WORD_END, "\\1\0\\2"), "\0")
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        ids, unseen = self.known.find(pieces)
        if unseen:
            new = [pieces[k] for k in unseen]
            found = self.pieces(new)
            self.known.put(new, found)
            for k, i in zip(unseen, found):
                ids[k] = i
        every = pa.array(ids, pa.large_binary()).take(coded.indices)
        filled = np.frombuffer(every.buffers()[1], np.int64)[:len(every) + 1] // 4
        ends = np.asarray(split.offsets) - split.offsets[0].as_py()
        return np.frombuffer(every.buffers()[2] or b"", "<u4")[:filled[-1]], np.diff(filled[ends])


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``most`` bytes with their first row; a longer text is a slice by itself."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most)))
        yield at, pa.array(texts.slice(at, to - at))
        at = to
