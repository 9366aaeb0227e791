"""Every registered query of the library's own operators has a DuckDB oracle, and
every query with one equals it on the smallest data set (row count, column names
and types, and all values)."""

import duckdb
import pytest

import __spark_entry__ as contract
from faretrail.plans import catalog
from tools.compare import TABLES, digest, types

from conftest import SF_SMALL

NAMES = list(contract.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.registered()) <= set(NAMES) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = contract.queries()[name](spark, SF_SMALL).toArrow()
    dk = con.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert types(sp.schema) == types(dk.schema)
    a = digest(sp.to_pylist(), sp.column_names)
    b = digest(dk.to_pylist(), dk.column_names)
    assert a[:3] == b[:3]


def test_entry_smoke(spark):
    df = contract.entry(spark)
    assert df.columns == ["participantname_transfer", "participantname", "from_operator_id", "to_operator_id",
                          "num_transfers", "num_discounted", "transfer_revenue"]
    assert df.count() > 0
