"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

from quarry import plans

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows_as_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    if name not in plans.SQL:
        assert df.count() >= 0
        return
    want = db.sql(plans.SQL[name])
    assert {n: TYPES[t] for n, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_subpackage_for_text(tmp_path):
    import shutil

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(top, "quarry"), tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
