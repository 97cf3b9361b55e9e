"""Every named query with an oracle against DuckDB on the smallest tables, and the rest for a schema."""

import math

import pytest

from tidepanel import queries as named

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(named.queries()))
def test_query(spark, duck, name):
    df = named.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(map(norm, r)) for r in df.select(*cols).collect()]
    sql = named.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(f"select {', '.join(cols)} from ({sql})").fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(map(norm, r))) for r in want)


def test_the_entry_module_works_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidepanel", tmp_path / "tidepanel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
