"""Every registered query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from folio.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(plain, r)) for r in df.select(columns).collect()) == want


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "combined_text"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_corpus_operators(tmp_path):
    """The registry still imports when the llm subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/folio", tmp_path / "folio", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.selected_rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_orderpriority" in plan.split("PushedFilters")[1]
    assert "o_comment" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in plan
