"""Each driver query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from quillframe.plans import cell_queries as C
from quillframe.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or isinstance(v, str) or hasattr(v, "year"):
        return str(v)
    return round(float(v), 6)


def rows(frame):
    return sorted([tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, con, small, name):
    got, want = Q.QUERIES[name](spark, small).toPandas(), con.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(C.ORACLES))
def test_cell_query(spark, con, small, name):
    got, want = C.QUERIES[name](spark, small).toPandas(), con.execute(C.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as E

    assert set(Q.QUERIES) | set(C.QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0


def test_entry_without_the_llm_subpackage(tmp_path):
    """The rest imports when the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quillframe", tmp_path / "quillframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as E; print(len(E.queries()), [q for q in E.queries() if q.startswith('op')])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.strip() == f"{len(Q.QUERIES) + len(C.QUERIES)} []", out.stderr


def test_merge_does_not_depend_on_order(spark):
    from quillframe.operators import relational as R

    data = [("f", 1, "a", 0.9, "x"), ("f", 2, "b", 0.9, "y"), ("f", 3, None, 0.99, ""), ("g", 1, None, 0.5, ""), ("h", 2, "v", 0.4, "s"), ("h", 1, "v", 0.7, "r"), ("i", 1, "z", 0.3, "q")]
    schema = "k string, o int, v string, c double, s string"
    one = R.merge_candidates(spark.createDataFrame(data, schema), "k", "o", "v", "c", "s")
    two = R.merge_candidates(spark.createDataFrame(data[::-1], schema).repartition(3), "k", "o", "v", "c", "s")
    got = {r["k"]: tuple(r)[1:] for r in one.collect()}
    assert got == {r["k"]: tuple(r)[1:] for r in two.collect()}
    assert got["f"][:3] == ("a", 0.6, "多文件有不同值(a+b)") and got["g"][:2] == (None, 0.0)
    assert got["h"][:3] == ("v", 0.7, "r + s") and got["i"][:3] == ("z", 0.3, "q")
    assert all(0 <= g[1] <= 1 for g in got.values())
