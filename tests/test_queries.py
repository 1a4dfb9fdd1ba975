"""Every query of the engine against the same in SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tidegauge.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table):
    return sorted(repr([None if v is None or v != v else v for _, v in sorted(r.items())]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 720
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_random_gaps_are_repeatable(spark):
    a, b = (QUERIES["filling_error_random"](spark, SF).first() for _ in range(2))
    assert a == b and a.column == "click" and a.imputation_error_pct > 0


def test_metadata_of_repeated_times(spark, duck, tmp_path):
    """Larger tables have several events of a kind at one time: all of them count."""
    spark.read.parquet(f"{SF}/events.parquet").limit(50).createOrReplaceTempView("some_events")
    twice = spark.sql("SELECT * FROM some_events UNION ALL SELECT event_id + 1000000, ts, user_id, event_type, value, props FROM some_events")
    twice.write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = con.sql(ORACLES["set_metadata"]).to_arrow_table()
    assert sum(want["n"].to_pylist()) == 100
    assert rows(QUERIES["set_metadata"](spark, str(tmp_path)).toArrow()) == rows(want)
