"""Inputs over keys as large as those of large tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A table of sf0.001 with order keys from 54 million on, as 6 GB has them."""
    at = tmp_path_factory.mktemp("large")
    for table, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        duckdb.execute(f"COPY (SELECT * REPLACE ({key} + 54000000 AS {key}) FROM '{SMALL}/{table}.parquet') TO '{at}/{table}.parquet'")
    return str(at)


def _by_sql(sf_dir, name, key):
    """A query's own SQL; its arithmetic has the width of the key."""
    con = duckdb.connect()
    for table, column in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        con.execute(f"CREATE VIEW {table} AS SELECT * REPLACE ({column}::{key} AS {column}) FROM '{sf_dir}/{table}.parquet'")
    sql = entry.oracle_sql()[name]
    return con.execute(sql() if callable(sql) else sql).fetchall()


@pytest.mark.parametrize("name", ["structure", "drug_lines", "entity_codes", "fhir_observations"])
def test_documents_beyond_bigint(spark, large, name):
    """Documents' numbers are whole where they don't fit a BIGINT, in which the SQL fails, and BIGINTs where they do."""
    with pytest.raises(duckdb.OutOfRangeException):
        _by_sql(large, name, "BIGINT")
    order = lambda rows: sorted(rows, key=repr)
    want = [(int(r[0]), *r[1:]) for r in _by_sql(large, name, "HUGEINT")]
    got = entry.queries()[name](spark, large)
    assert got.schema[0].dataType.simpleString() == "decimal(38,0)"
    assert order((int(r[0]), *r[1:]) for r in got.collect()) == order(want)
    assert entry.queries()[name](spark, SMALL).schema[0].dataType.simpleString() == "bigint"
