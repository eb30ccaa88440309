"""The two streams: new checkpoints, crashes between write and switch, replays, compaction."""

import pytest

from surco.operators import calendar as CAL
from surco.streaming import jobs as J
from surco.streaming.commits import CommitLog

CUT = "cvegeo string, anio int, ciclo string, modalidad string, cultivo string, fecha int, sembrada double, load_ord int"
SCENE = "scene_id string, obs_date date, cycle string, year int"


def cuts(spark, value, load, days=range(5)):
    return spark.createDataFrame([("c", 2024, "OI", "riego", "maiz", k, float(value), load) for k in days], CUT)


def stored(spark, table):
    rows = J.current_cuts(spark, cuts(spark, 0, 0).schema, table).collect()
    assert len({r["fecha"] for r in rows}) == len(rows)
    return {r["fecha"]: r["sembrada"] for r in rows}


def test_a_replayed_upsert_gives_the_same_table(spark, tmp_path):
    table = str(tmp_path / "cuts")
    J.upsert_batch(cuts(spark, 1, 0), 0, table, "a")
    for _ in range(2):  # the second batch again, as after a failure
        J.upsert_batch(cuts(spark, 2, 1, range(2)), 1, table, "a")
    J.upsert_batch(cuts(spark, 3, 0, [0]), 2, table, "a")
    assert stored(spark, table) == {0: 2.0, 1: 2.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_a_new_checkpoint_keeps_stored_cuts(spark, tmp_path):
    table, inbox = str(tmp_path / "cuts"), str(tmp_path / "inbox")
    schema = cuts(spark, 0, 0).schema
    for k, (folder, load, days) in enumerate((("one", cuts(spark, 1, 0), 5), ("two", cuts(spark, 2, 0, [7, 8]), 7), ("two", cuts(spark, 5, 0, [0]), 7))):
        load.write.mode("append").parquet(f"{inbox}/{folder}")
        J.progress_upsert(spark.readStream.schema(schema).parquet(f"{inbox}/{folder}"), table, str(tmp_path / f"log-{folder}")).awaitTermination()
        assert len(stored(spark, table)) == days
    assert stored(spark, table) == {0: 5.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 7: 2.0, 8: 2.0}


def test_a_crash_before_the_switch_loses_and_shows_nothing(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "cuts")
    J.upsert_batch(cuts(spark, 1, 0), 0, table, "a")

    def crash(self, how):
        raise RuntimeError("lost")

    monkeypatch.setattr(CommitLog, "change", crash)
    with pytest.raises(RuntimeError):
        J.upsert_batch(cuts(spark, 2, 1), 1, table, "a")
    with pytest.raises(RuntimeError):
        J.compact_cuts(spark, cuts(spark, 0, 0).schema, table) or J.upsert_batch(cuts(spark, 2, 1), 1, table, "a")
    monkeypatch.undo()
    assert set(stored(spark, table).values()) == {1.0}
    J.upsert_batch(cuts(spark, 2, 1, [0]), 1, table, "a")  # the replay; what the crash left is overwritten
    assert stored(spark, table) == {0: 2.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_compaction_leaves_one_row_a_key(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "cuts")
    schema = cuts(spark, 0, 0).schema
    for k in range(4):
        J.upsert_batch(cuts(spark, k, 0, range(k, 5)), k, table, "a")
    before = stored(spark, table)
    log = CommitLog(spark, table)
    J.compact_cuts(spark, schema, table)
    assert log.read(schema).count() == 5 and stored(spark, table) == before == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 3.0}
    J.upsert_batch(cuts(spark, 9, 0), 2, table, "a")  # a replay from before the compaction
    assert stored(spark, table) == before
    J.upsert_batch(cuts(spark, 9, 0, [4]), 4, table, "a")
    J.upsert_batch(cuts(spark, 8, -1, [3]), 5, table, "a")
    J.compact_cuts(spark, schema, table)
    J.compact_cuts(spark, schema, table)
    assert stored(spark, table) == before | {4: 9.0}
    assert len(list((tmp_path / "cuts" / "data").iterdir())) <= 4 and len(log.versions()) == 2
    # by itself after many batches
    monkeypatch.setattr(J, "COMPACT_FOLDERS", 2)
    for k in range(6, 12):
        J.upsert_batch(cuts(spark, k, 1, [0]), k, table, "a")
        assert len(log.state()["folders"]) <= 2
    assert stored(spark, table) == before | {0: 11.0, 4: 9.0}


def test_two_writers_both_count(spark, tmp_path):
    table = str(tmp_path / "cuts")
    log = CommitLog(spark, table)
    J.upsert_batch(cuts(spark, 1, 0, [0]), 0, table, "a")
    seen = []

    def slow(state):
        if not seen:  # another writer switches between reading and renaming
            seen.append(1)
            J.upsert_batch(cuts(spark, 2, 0, [1]), 0, table, "b")
        return state | {"runs": state["runs"] | {"c": 0}}

    assert log.change(slow)
    assert stored(spark, table) == {0: 1.0, 1: 2.0} and set(log.state()["runs"]) == {"a", "b", "c"}


def scenes(spark, names, day="2024-02-01"):
    import datetime

    return spark.createDataFrame([(n, datetime.date.fromisoformat(day), "OI", 2024) for n in names], SCENE)


def run_stage(spark, tmp_path, folder, rows):
    inbox, sink = str(tmp_path / "inbox" / folder), str(tmp_path / "sink")
    rows.coalesce(1).write.mode("append").parquet(inbox)
    windows = CAL.windows(CAL.calendar_of_years(spark.createDataFrame([(2024,)], "year int")))
    J.manifest_stage(spark.readStream.schema(rows.schema).parquet(inbox), windows, sink, str(tmp_path / f"log-{folder}")).awaitTermination()
    return sink, {r["scene_id"]: (str(r["obs_date"]), r["stage"]) for r in J.staged_scenes(spark, J.staged_schema(rows), sink).collect()}


def test_staged_scenes_of_two_checkpoints(spark, tmp_path):
    sink, got = run_stage(spark, tmp_path, "one", scenes(spark, "xy"))
    first = ("2024-02-01", "00_siembra_emergencia")
    assert got == {"x": first, "y": first}
    rows = CommitLog(spark, sink).read(J.staged_schema(scenes(spark, "x")))
    # seen scenes cost no row, an older scene that comes late does
    sink, got = run_stage(spark, tmp_path, "one", scenes(spark, "xy").union(scenes(spark, "v", "2023-12-31")))
    assert got == {"x": first, "y": first, "v": ("2023-12-31", "fuera_de_etapa")}
    rows = CommitLog(spark, sink).read(J.staged_schema(scenes(spark, "x")))
    assert rows.count() == 3
    # a new checkpoint has seen nothing: scenes stay, the first record of each counts
    sink, got = run_stage(spark, tmp_path, "two", scenes(spark, "z").union(scenes(spark, "x", "2024-05-20")))
    assert set(got) == set("vxyz") and got["x"] == first
    CommitLog(spark, sink).compact(J.staged_schema(scenes(spark, "x")), J.first_records)
    assert CommitLog(spark, sink).read(J.staged_schema(scenes(spark, "x"))).count() == 4
    sink, again = run_stage(spark, tmp_path, "two", scenes(spark, "w", "2024-03-05"))
    assert again == got | {"w": ("2024-03-05", "01_vegetativo")}
