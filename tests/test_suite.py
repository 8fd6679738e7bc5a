"""Every query with SQL beside it gives the same rows in both engines; the library stands without the corpus package."""

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sedgewire.plans import suite

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = Path(DATA, f"{t}.parquet")
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 4)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in found], key=str), sorted(columns)


@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_query(spark, duck, name):
    got = suite.QUERIES[name](spark, DATA)
    want = duck.sql(suite.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_flagship(spark):
    kinds = {r.kind for r in suite.flagship(spark, DATA).collect()}
    assert kinds == {"terms", "timeline"}


def test_entry_without_the_corpus_package(tmp_path):
    repo = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "sedgewire"):
        os.symlink(repo / name, tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for p in (repo / "sedgewire").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "sedgewire" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
