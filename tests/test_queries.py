"""Registered queries against their oracles on the small tables, and the guard around the corpus operators."""

import datetime
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name in ("symloom", "__spark_entry__.py"):
            subprocess.run(["cp", "-r", f"{root}/{name}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/symloom/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
