"""Byte-level BPE against the tiktoken library, and back to the bytes."""

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from surco.llm import bpe, pieces
from surco.llm.queries import QUERIES, RANKS, ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own():
    return bpe.coder(RANKS, public_tokenizers.PATTERN)


def ids_of(texts):
    return [i.tolist() for i in own().each(pa.array(texts, pa.string()))]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_given_documents(spark, sf_dir, library):
    got = {r.doc_id: r for r in QUERIES["op13_byte_bpe"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert tuple(got[doc_id])[1:] == (len(ids), sha(raw), sha((text or "").encode()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("thean d'sl 1.!\n\t 　é漢"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_any_texts(library, texts):
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]
    assert [own().decode(i) for i in own().each(pa.array(texts, pa.string()))] == [t.encode() for t in texts]


def test_long_unbroken_texts(library):
    r = random.Random(2)
    texts = ["a" * 5000, "".join(r.choice("abcdefghij") for _ in range(9000)), "é" * 2000, "?!" * 900, " " * 700, "the" * 400 + " " + "of" * 300, "x\0y z"]
    texts += ["".join(r.choice("theofin") for _ in range(r.randint(1, 70))) for _ in range(500)]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_every_pair_of_a_small_vocabulary(tmp_path):
    # leftmost of equal ranks, and a merge that no chain of smaller ones reaches
    tokens = [bytes([b]) for b in range(256)] + [b"aa", b"ab", b"aab", b"bab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    plain = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    coder = bpe.Coder(str(path), r"\S+")
    r = random.Random(5)
    parts = ["".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(2000)]
    assert [x.tolist() for x in coder.merge([p.encode() for p in parts])] == [plain._core_bpe.encode_single_piece(p.encode()) if p.encode() not in tokens else
                                                                             coder.merge([p.encode()])[0].tolist() for p in parts]
    assert [x.tolist() for x in coder.each(pa.array(parts))] == [plain.encode_ordinary(p) for p in parts]


def test_memory_is_bounded(library, monkeypatch):
    coder = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    coder.known = pieces.Memory(40_000)
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 2_000)
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("etaoin") for _ in range(r.randint(1, 9))) for _ in range(60)) for _ in range(300)]
    got = []
    for _, part in pieces.blocks(pa.array(texts)):
        got += [i.tolist() for i in coder.each(part)]
        assert len(coder.known.young) + len(coder.known.old) < 600
    assert got == [library.encode_ordinary(t) for t in texts]


def test_awkward_table(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (None, "hi there", "x"), (3, "hi  there\n", "x"), (3, "hi  there\n", "x"), (4, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    assert got == sorted(((i, len(library.encode_ordinary(t or "")), sha((t or "").encode())) for i, t, _ in rows), key=str)
    coded = bpe.encoded(df, RANKS, public_tokenizers.PATTERN)
    back = sorted((str(r.doc_id), bytes(r.bytes).decode()) for r in bpe.decoded(coded, RANKS, public_tokenizers.PATTERN).collect())
    assert back == sorted((str(i), t or "") for i, t, _ in rows)
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
