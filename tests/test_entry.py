"""The entry module: registered queries run, agree with their SQL, and survive without the llm folders."""

import hashlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from lectern.plans import queries as plans

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[0] == "page_id" and df.count() == 50


@pytest.mark.parametrize("name", [n for n in plans.ORACLES if n != "page_titles"])
def test_like_sql(spark, tiny, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(tiny):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tiny}/{f}'")
    got = plans.REGISTERED[name](spark, tiny)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({plans.ORACLES[name]})").fetchall()
    near = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    key = lambda row: hashlib.md5(repr(row).encode()).hexdigest()
    assert sorted(map(near, want), key=key) == sorted((near(tuple(r)) for r in got.select(names).collect()), key=key)


@pytest.mark.parametrize("name", ["sentences_uax29", "chunks", "document_speech"])
def test_without_sql(spark, tiny, name):
    assert plans.REGISTERED[name](spark, tiny).count() > 0


def test_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); print(sum(n.startswith('op') for n in q), len(q), len(e.oracle_sql()), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=60)
    assert out.stdout.split()[0] == "0" and out.stdout.split()[-1] == "False", out.stderr
