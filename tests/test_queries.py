"""Every registered query against its SQL in DuckDB, on tables where none of them is empty."""

import decimal
import math

import duckdb
import pytest

from tapewright.plans import registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(larger):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{larger}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def test_every_query_has_sql():
    assert registered.queries().keys() == registered.oracle_sql().keys()
    assert len(registered.queries()) > 95


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_against_sql(spark, larger, duck, name):
    result = registered.queries()[name](spark, larger)
    columns = sorted(result.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in result.collect()), key=repr)
    cursor = duck.execute(registered.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()), key=repr)
    assert want and got == want


def test_flagship(spark, data):
    assert registered.flagship(spark, data).count() > 0


def test_actor_trades_are_not_cut_from_all_listing_trades(spark, data, monkeypatch):
    """j05 pairs the trades of an event's actors only; pairs of the whole interval, four times as many, are not made."""

    def never(*_):
        raise AssertionError("all trades of all listings were joined")

    monkeypatch.setattr(registered, "_lt", never)
    assert registered.queries()["j05_actor_window_trades"](spark, data).columns == ["event_id", "exchange", "trade_id", "ts_ms", "first_pump_ms"]
