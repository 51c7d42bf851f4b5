"""The driver's contract: every query's SQL agrees, and all works without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quirework.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    assert rows
    if sql := catalog.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.sql(sql)
        assert sorted(want.columns) == columns
        assert rows == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "quirework", tmp_path / "quirework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [n for n in q if n[:2] == 'op' and n[2].isdigit()] and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
