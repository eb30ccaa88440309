"""Queries on rows that only larger tables hold."""

import duckdb
import pytest

import __spark_entry__ as entry


def rows_of_both(spark, folder, name, tables):
    """Sorted rows of a query and of its SQL over ``tables`` in ``folder``."""
    con = duckdb.connect()
    for t, text in tables.items():
        con.execute(f"COPY ({text}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    order = [got.columns.index(d[0]) for d in cur.description]
    return sorted((tuple(r[i] for i in order) for r in got.collect()), key=repr), sorted(cur.fetchall(), key=repr)


@pytest.mark.parametrize("key", [2405, 7150, 5])
def test_a_date_that_is_edited_is_another_one(spark, tmp_path, key):
    # the third stage of customers 2405 and 7150 begins on the day that the edit gives
    got, known = rows_of_both(spark, tmp_path, "mark_manual", {"customer": f"SELECT {key}::BIGINT AS c_custkey, 1 AS c_nationkey"})
    assert got == known


def test_items_repeated_on_a_page_are_dropped_before_they_are_sorted(spark):
    from surco.sources import catalogue as CT

    item = lambda i, d: f'{{"id": {i}, "properties": {{"datetime": "{d}"}}}}'
    text = '{"features": [' + ", ".join([item('"a"', 1), item('"b"', 2), item('"a"', 3), item("null", 4), item('"b"', 5)]) + "]}"
    pages = spark.createDataFrame([(1, "pc-s2", text), (2, "pc-s2", text), (3, "pc-s2", '{"features": []}'), (4, "pc-s2", "broken")], "page int, source string, value string")
    got = CT.parse_pages(pages, once=True).select("page", "id", "properties.datetime").collect()
    assert sorted(map(tuple, got)) == [(1, "a", "1"), (1, "b", "2"), (2, "a", "1"), (2, "b", "2")]
    assert CT.parse_pages(pages).count() == 8
