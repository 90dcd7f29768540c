"""Every registered query against its SQL counterpart in DuckDB."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_point  # noqa: E402

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def value(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_counterpart():
    assert {name for name in QUERIES if not name.startswith("op") and name != "pipeline"} <= ORACLES.keys()
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    expected = duck.execute(ORACLES[name])
    kinds = {c[0]: str(c[1]) for c in expected.description}
    assert {f.name: KINDS[f.dataType.simpleString()] for f in result.schema.fields} == kinds
    assert table(result.columns, result.collect()) == table(list(kinds), expected.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
