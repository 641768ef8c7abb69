"""Every registered query against its SQL in DuckDB, and the entry point."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from tessera.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def values(frame, columns):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    frame = got.toPandas()
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name]).df()
        assert sorted(want.columns) == columns
        assert values(frame, columns) == values(want, columns)
    else:
        assert len(frame) > 0
    spark.catalog.clearCache()


def test_entry_and_import_without_llm(spark, tmp_path):
    import shutil
    import subprocess
    import sys

    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'keyword_search_bm25' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})
