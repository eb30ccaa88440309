"""Token ids of whole texts by the tokenizers library and a public vocabulary file whose path is a parameter."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from surco.llm.common import give_back
from surco.llm.pieces import BLOCK_BYTES, Memory, PieceCoder, blocks

_codecs: dict[str, Codec] = {}


class Codec(PieceCoder):
    """The ids that the library gives whole texts. Runs of letters, which the pattern would leave whole, skip it."""

    def __init__(self, path: str):
        # Spark's tasks are the parallelism; the library's own threads only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # a text that holds one of these is encoded whole: cuts would part it
        self.unbroken = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.by_pattern = self.tokenizer.pre_tokenizer
        self.by_letters = ByteLevel(add_prefix_space=False, use_regex=False)

    def whole(self, texts: list[str]) -> list[bytes]:
        ids, ends = array("I"), [0]
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids.extend(e.ids)
            ends.append(len(ids))
        raw = np.frombuffer(ids, np.uint32).astype("<u4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(ends, ends[1:])]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        words = [p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) or p.isalpha() for p in pieces]
        self.tokenizer.pre_tokenizer = self.by_letters
        letters = iter(self.whole([p for p, w in zip(pieces, words) if w]))
        self.tokenizer.pre_tokenizer = self.by_pattern  # it stays: whole texts need it
        others = iter(self.whole([p for p, w in zip(pieces, words) if not w]))
        return [next(letters if w else others) for w in words]


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file; it outlives a task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def forget(path: str) -> None:
    """Let go of the pieces that this worker remembers: it outlives its task, and the next stage needs other memory."""
    codec(path).known = Memory()
    give_back()


def encoded(batches: Iterator[pa.RecordBatch], path: str, column: str = "text", block: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids of their texts (null: none) and each text's number of ids."""
    own = codec(path)
    for batch in batches:
        for at, texts in blocks(pc.fill_null(batch.column(column).cast(pa.string()), ""), block):
            yield batch.slice(at, len(texts)), *own.encode(texts)
