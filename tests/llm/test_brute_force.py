"""Sharding of the documents by hand, and learnt scores recomputed by plain loops, without influence of held-out labels."""

import collections
import heapq
import math
import zlib

import pytest
from pyspark.sql import functions as F

from surco.llm import ranking, sharding, toxicity
from surco.llm.labelled import sample
from surco.llm.queries import QUERIES, ship

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


def test_shards_of_the_documents(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op8_lpt_sharding"](spark, SF).collect()}
    assert set(got) == set(texts)
    places, load, slots = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
    sizes = collections.Counter()
    for i, raw in texts.items():
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        places[raw].add(r.shard)
        sizes[raw] += r.size
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(p) == 1 for p in places.values())  # equal texts stay together
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    # the schedule of every group by itself, largest first, is no better than by a bundle
    heap = [(0, s) for s in range(40)]
    for size in sorted(sizes.values(), reverse=True):
        least, s = heapq.heappop(heap)
        heapq.heappush(heap, (least + size, s))
    assert max(load.values()) <= max(h[0] for h in heap) * 1.02
    assert max(load.values()) - min(load[s] for s in range(40)) <= max(max(sizes.values()), 0.02 * sum(sizes.values()) / 40)


def test_longest_first_is_the_plain_schedule():
    import random

    r = random.Random(5)
    for _ in range(100):
        jobs = [(k, r.choice([1, 5, 5, r.randint(1, 500)])) for k in range(r.randint(0, 80))]
        loads, want = [0] * 7, {}
        for job, size in sorted(jobs, key=lambda x: (-x[1], x[0])):
            s = min(range(7), key=lambda i: (loads[i], i))
            want[job] = s
            loads[s] += size
        assert sharding.longest_first(jobs, 7) == want


def flipped(labels):
    """The held-out labels turned round."""
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return labels.select("doc_id", *[F.when(out, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])


@pytest.mark.parametrize("op", [ranking, toxicity])
def test_held_out_labels_have_no_influence(docs, labels, op):
    assert flipped(labels).exceptAll(labels).count() > 0
    one = {r.doc_id: tuple(r) for r in op.score(docs, labels).collect()}
    assert one == {r.doc_id: tuple(r) for r in op.score(docs, flipped(labels)).collect()}
    assert all(r[1] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in one.items())
    column = "quality" if op is ranking else "toxic"
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in sample(docs, labels, column, 20_000).select("doc_id").collect())


def test_quality_scores_by_a_plain_loop(docs, labels):
    model = ranking.learn(docs, labels)
    got = {r.doc_id: r for r in ranking.score(docs, labels).collect()}
    shift = model.threshold - math.log(0.3 / 0.7)
    for r in docs.select("doc_id", "text").collect():
        raw = sum((x - c) / s * w for x, c, s, w in zip(ranking.features(r.text), model.centre, model.scale, model.weight))
        want = 1 / (1 + math.exp(-max(-500.0, min(500.0, raw - shift))))
        assert math.isclose(got[r.doc_id].score, want, rel_tol=1e-9, abs_tol=1e-12)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
    # the learnt order on the pairs: it wins nearly all of them
    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    good, bad = ([got[i].score for i in y if y[i] == v and i in got] for v in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)


def test_toxicity_scores_by_a_plain_loop(docs, labels):
    lexicon, beta = toxicity.learn(docs, labels)
    weights = dict(lexicon.weights)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    hits = 0
    for r in docs.select("doc_id", "text").collect():
        total, dense, any_ = lexicon.measures(r.text)
        line = beta[0] + beta[1] * total + beta[2] * dense + beta[3] * any_
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-line)), rel_tol=1e-9, abs_tol=1e-12)
        # the automaton against a search for every term in turn
        text = toxicity.fold(r.text or "")
        found = [(term, w) for term, w in weights.items() if (term.rstrip("*") in text)]
        hits += bool(any_)
        if any_:
            assert found
        if not found:
            assert not any_ and not total
    assert hits


def test_every_labelled_text_counts_for_the_ranking(spark, monkeypatch):
    from surco.llm import labelled

    monkeypatch.setattr(labelled, "SAMPLE_ROWS", 40)
    rows = [(i, "fine words in a row " * (i % 7 + 3) if i % 3 else "spam!! | spam!! " * (i % 5 + 3), int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = ranking.learn(df, df)
    used = [ranking.features(t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert model.centre == pytest.approx([sum(c) / len(used) for c in zip(*used)])
