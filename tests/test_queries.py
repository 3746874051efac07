"""Each query against its SQL over the smallest tables, and the entry point without the optional operators."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from snapstore.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(spark_rows, sql_rows):
    columns = sorted(sql_rows.columns)
    assert columns == sorted(spark_rows.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (spark_rows, sql_rows))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    rows = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        same(rows, duck.sql(sql).df())
    else:
        assert len(rows)


def test_entry(spark):
    assert entry.entry(spark).columns == ["section", "kind", "path"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_optional_operators(tmp_path, gone):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", *gone, "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'status_all' in q and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q; print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    tests = [sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", "blob_ids or test_entry or test_query and (blob_hash or status_all)"]
    done = subprocess.run(tests, cwd=tmp_path / "r", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "4 passed" in done.stdout, done.stdout
