"""The driver's contract: names, checks, and life without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from fairloom.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(catalogue.queries()) >= 60
    assert 0 < entry.entry(spark).count() <= 50


def plain(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    return None if x is None or x != x else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    got = catalogue.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    key = sorted(names)
    assert sorted([tuple(plain(r[c]) for c in key) for r in got.collect()], key=repr) == sorted([tuple(plain(r[c]) for c in key) for r in want], key=repr)


def test_works_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path / "r", capture_output=True, text=True, check=True)
    assert said.stdout.split() == ["True", "False", "False"]
