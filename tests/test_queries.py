"""Every registered query of the engine's own operators against its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import subprocess
import sys

import duckdb
import pytest

from lectern.plans import catalog

from .conftest import ROOT, SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    frame = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(row[c]) for c in columns]) for row in frame.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    found = sql.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in found.fetchall())


def test_entry_imports_without_the_llm_folders():
    """The registry works where corpus_pipeline and the subpackage llm cannot be imported."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'hybrid_retrieve' in e.queries(); assert 'pipeline' not in e.queries(); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
