"""Every registered query against its SQL, as the driver compares them."""

import datetime
import math
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]
D = os.environ.get("CATALOGUE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: v for k, v in entry.queries().items() if k in entry.catalogue.QUERIES}
SQL = {k: v for k, v in entry.oracle_sql().items() if k in OWN}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = OWN[name](spark, D)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    cols = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-6) if any(isinstance(v, float) for v in x) else x == y


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_other_queries_run(spark, name):
    got = OWN[name](spark, D)
    assert got.columns and got.count() >= 0


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["doc_id", "score"] and got.count() == 20


def test_without_the_optional_parts(tmp_path):
    """The other queries are there when the optional folders are deleted."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for p in ("corvidex/llm", "tests/llm"):
        shutil.rmtree(copy / p, ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [k for k in e.queries() if k.startswith('op') or k == 'pipeline'])"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split(maxsplit=2) == [str(len(OWN)), str(len(SQL)), "[]\n"] or said.stdout.strip() == f"{len(OWN)} {len(SQL)} []"


def test_nothing_else_imports_the_optional_parts():
    for p in [*REPO.glob("corvidex/**/*.py"), *REPO.glob("tests/*.py")]:
        if "llm" not in p.relative_to(REPO).parts and p.name != "test_catalogue.py":
            assert not re.search(r"\bllm\b|corpus_pipeline", p.read_text()), p
