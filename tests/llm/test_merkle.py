"""The Merkle manifest against trees built by hand, on given and awkward documents."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from surco.llm import merkle
from surco.llm.queries import QUERIES, ship

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_by_hand(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_by_hand(digests):
    """Per leaf the siblings of each level, and the root."""
    paths, level, groups = [[] for _ in digests], digests, [[k] for k in range(len(digests))]
    while len(level) > 1:
        runs = [range(a, min(a + 8, len(level))) for a in range(0, len(level), 8)]
        for run in runs:
            for k in run:
                others = ("".join(level[i] for i in run if i < k), "".join(level[i] for i in run if i > k))
                for leaf in groups[k]:
                    paths[leaf].append(others)
        level, groups = [sha("".join(level[i] for i in run)) for run in runs], [sum((groups[i] for i in run), []) for run in runs]
    return paths, level[0]


def manifest_by_hand(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    out, order = [], sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(r)))
        trees[lang] = tree_by_hand([leaf_by_hand(r) for r in langs[lang]])
    if not rows:
        return []
    upper, root = tree_by_hand([trees[lang][1] for lang in order])
    for k, lang in enumerate(order):
        for r, path in zip(langs[lang], trees[lang][0]):
            path = path + upper[k]
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                changed = r[:4] + ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]),)
            fold = leaf_by_hand(changed)
            for left, right in path:
                fold = sha(left + fold + right)
            out.append((r[0], leaf_by_hand(r), trees[lang][1], root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_given_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert rows_of(QUERIES["op11_merkle_manifest"](spark, sf_dir)) == sorted(manifest_by_hand(rows), key=str)


@pytest.mark.parametrize("sizes", [[0], [1], [1, 1], [8, 9], [2, 64, 65, 1], [3] * 9 + [1] * 60, [530]])
def test_sizes_of_trees(spark, sizes):
    r = random.Random(1)
    rows = [(r.choice([None, k, k, k * 7 - 50]), r.choice([None, "s"]), None if t == 0 else f"l{t % 7}é{t}", r.choice([None, 5]), r.choice([None, "", "Aé b", "low"]))
            for t, size in enumerate(sizes) for k in range(size)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("tree", F.lit("x")).withColumn("at", F.lit(0)).withColumn("digest", F.lit(0)).repartition(3)
    got, want = rows_of(merkle.audit(df)), sorted(manifest_by_hand(rows), key=str)
    # rows that are alike but for what the digest leaves out have no order of their own: here there are none
    assert got == want


def test_blocks_part_no_run(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_NODES", 8)
    monkeypatch.setattr(merkle, "PART_ROWS", 10)
    rows = [(k, "s", "en", k, f"Text {k}") for k in range(203)] + [(k, "s", "en", 1, "same") for k in (7, 7, 7)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert rows_of(merkle.audit(df)) == sorted(manifest_by_hand(rows), key=str)
    plain = merkle.manifest(df)
    assert plain.filter("NOT verified").isEmpty()
    assert plain.agg(F.min(F.size("path")), F.max(F.size("path"))).first() == (3, 3)
