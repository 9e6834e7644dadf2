"""Every query against its SQL counterpart on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from oracle.sql import ORACLE
from sieveline.plans.registry import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield con
    con.close()


def _text(value):
    return "" if value is None else repr(value + 0.0) if isinstance(value, float) else str(value)


def _sorted(rows, order):
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = _sorted([tuple(row) for row in frame.select(*columns).collect()], range(len(columns)))
    result = duck.execute(ORACLE[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    want = _sorted(result.fetchall(), [names.index(c) for c in columns])
    assert got == want
    assert got


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"shap_seeded", "lime_seeded"}
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and rows[0]["risk_score"] >= rows[-1]["risk_score"]
