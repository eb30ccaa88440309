"""Conversation repair against a plain search over all edit strings, on given and on awkward conversations."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from surco.llm import conversations
from surco.llm.queries import QUERIES, ship

MARK = re.compile(r"[^\x20\x09-\x0D]")
ROWS = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def filled(x):
    return " " if x is None else str(x)


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = filled(role), filled(text)
        kind = zlib.crc32(f"{filled(conv)}:{filled(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def repair_by_hand(rows):
    """All that the report says of one conversation, from its rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        marks = MARK.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}  # the initials that may follow each place of the pattern

    @cache
    def best(i, place, inserts):
        found = [(0, "")] if i == len(rows) and place in ("", "a") else []
        if inserts < 4:
            c, e = best(i, after[place][-1], inserts + 1)
            found.append((c + 3, "I" + e))
        if i < len(rows):
            c, e = best(i + 1, place, 0)
            found.append((c + 4, "D" + e))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if rows[i][2][:1] and rows[i][2][0] in after[place]:
                    c, e = best(i + 1, rows[i][2][0], 0)
                    found.append((c + more, "K" + e))
                c, e = best(i + 1, after[place][-1], 0)
                found.append((c + 3 + more, "R" + e))
        return min(found) if found else (10 ** 9, "")

    cost, audit = best(0, "", 0)
    lines, place, i = [], "", 0
    for e in audit:
        if e != "D":
            name = {"u": "user", "a": "assistant"}[after[place][-1]]
            role = rows[i][2] if e == "K" else name
            lines.append(f"{role}:{'' if e == 'I' else rows[i][3]}")
            place = role[0]
        i += e != "I"
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def compare(got, original, after):
    got = {r[0]: tuple(r)[1:] for r in got}
    after = by_conversation(after)
    assert set(got) == {r[0] for r in original}
    for conv in got:
        assert got[conv] == repair_by_hand(after.get(conv, [])), conv


def test_given_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(QUERIES["op12_conversation_repair"](spark, sf_dir).collect(), rows, damage_by_hand(rows))


def awkward():
    r = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "u"]
    texts = ["yes.", "no", " \t", None, "", "really?", "done!  ", "x. ", "é."]
    rows = [(None, None, None, None), (None, 3, "user", "hi."), (-1, None, "user", "hi."), (-1, None, "user", "hi."), (-1, None, "assistant", "ho.")]
    for conv in range(300):
        turn = r.randint(-2, 3)
        for _ in range(r.randint(1, 9)):
            rows.append((conv, turn if r.random() > .05 else None, r.choice(roles if conv % 2 else roles[:3]), r.choice(texts)))
            turn += r.choice([0, 1, 1, 1, 2])
    return rows


def test_awkward_conversations(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, ROWS).withColumn("fault", F.lit(1)).withColumn("key", F.lit("x")).repartition(5)
    compare(conversations.damaged_and_repaired(df).collect(), rows, damage_by_hand(rows))
    compare(conversations.report(df).collect(), rows, [(c, t, filled(a), filled(b)) for c, t, a, b in rows])
    assert conversations.damaged_and_repaired(df.limit(0)).collect() == []
    assert conversations.repaired(df.limit(0)).collect() == []


def test_repaired_turns_agree_with_the_report(spark):
    df = spark.createDataFrame(awkward(), ROWS)
    want = {r.conv_id: r for r in conversations.report(df).collect()}
    turns = by_conversation(sorted((tuple(r) for r in conversations.repaired(df).collect()), key=lambda r: (r[0] or -9, r[1])))
    for conv, report in want.items():
        own = turns.get(conv, [])
        assert [t[1] for t in own] == list(range(len(own)))
        assert "".join(t[2] for t in own) == report.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{t[4]}:{t[5]}" for t in own).encode()).hexdigest() == report.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t[4][0] for t in own))


def test_a_giant_conversation_spills(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SPOOL_BYTES", 100)  # the plain class, run here
    r = random.Random(8)
    rows = [(1, k, r.choice(["user", "assistant"]), r.choice(["a.", "b", "c?", "d", f"{k}."])) for k in range(120)]
    own = conversations._Conversation()
    seen = set()
    for _, turn, role, text in rows:
        fault = "duplicate" if (role, text) in seen else "" if text[-1] in ".?" else "truncated"
        seen.add((role, text))
        own.add(turn, role, text, role[0], fault)
    edits = list(own.edits())
    want = repair_by_hand(rows)
    assert (own.cost, "".join(e[0] for e in edits)) == want[5:7]
    assert hashlib.sha256("\n".join(f"{e[2]}:{e[3]}" for e in edits if e[0] != "D").encode()).hexdigest() == want[7]
    # the whole job, over several Arrow batches
    monkeypatch.undo()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        got = conversations.report(spark.createDataFrame(rows, ROWS)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tuple(got[0])[1:] == want
