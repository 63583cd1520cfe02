"""Every registered query runs; those with a twin equal it; the entry point holds without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from factlake import queries

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def connection():
    out = duckdb.connect()
    for table in TABLES:
        out.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return out


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return bytes(value) if isinstance(value, bytearray) else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, connection, name):
    got = queries.QUERIES[name](spark, SMALL)
    rows = got.collect()
    if name not in queries.ORACLES:
        assert rows
        return
    want = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    ours = sorted(str([plain(r[c]) for c in columns]) for r in rows)
    assert ours == sorted(str([plain(v) for v in r]) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def imported(folder, code="import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"):
    env = {"PATH": "/usr/bin", "PYTHONPATH": str(folder)}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    return done.stdout.split(), done.stderr


def test_the_rest_holds_without_the_optional_subpackage(tmp_path):
    own = [str(len(queries.QUERIES)), str(len(queries.ORACLES))]
    for gone, warned in ((("llm",), False), (("llm", "corpus_pipeline.py"), False), (("corpus_pipeline.py",), (ROOT / "factlake" / "llm").exists())):
        folder = tmp_path / "-".join(gone)
        shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
        counts, said = imported(folder)
        assert counts == own and ("left out" in said) == warned, said


def test_nothing_is_left_out_when_all_is_there(tmp_path):
    if not (ROOT / "factlake" / "llm").exists():
        pytest.skip("the optional subpackage was taken out")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    counts, said = imported(tmp_path / "repo")
    assert int(counts[0]) == len(queries.QUERIES) + 11 and "left out" not in said
    (tmp_path / "repo" / "ahocorasick.py").write_text("raise ImportError('not there')")
    counts, said = imported(tmp_path / "repo")  # a library that it needs is missing
    assert int(counts[0]) == len(queries.QUERIES) and "not there" in said
