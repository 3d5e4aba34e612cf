"""Every registered query with SQL gives the rows of that SQL, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as contract
from catalog.views import TABLES, VIEWS, view
from tests.conftest import SMALL
from tools.check import rows_of

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
MAY_BE_EMPTY = {"f3_filter_by", "f8_display_filter", "s2_load_ways", "g9_same_edge", "g14_clip_to_ring", "f2_in_bbox", "g3_filter_kg", "f15_a3_map_tiers"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows(spark, duck, key):
    df = QUERIES[key](spark, SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLES[key])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1] or key in MAY_BE_EMPTY


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, key):
    assert QUERIES[key](spark, SMALL).limit(1).collect()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_views_count_in_doubles(spark, duck, tmp_path):
    """Rows of the grid beyond those of the small tables: coordinates agree to the last bit."""
    duck.execute(f"COPY (SELECT * REPLACE (p_partkey + 100000 AS p_partkey) FROM part) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got = sorted(map(tuple, view(spark, str(tmp_path), "stores").select("id", "lat", "lng").collect()))
    want = duck.execute(f"SELECT id, lat, lng FROM ({VIEWS['stores'].replace('FROM part', f'FROM read_parquet($${tmp_path}/part.parquet$$)')}) AS v ORDER BY id").fetchall()
    assert got == want
