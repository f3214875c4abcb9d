"""Every registered query against its SQL; the rest of the library without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sparkveil import suite

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    return None if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = suite.queries()[name](spark, sf_dir)
    result = duck.execute(suite.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda rows: sorted([tuple(map(normal, r)) for r in rows], key=str)
    assert key(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())) == key(result.fetchall())


def test_made_texts_are_dealt_to_tasks(spark, sf_dir, tmp_path):
    """A file of keys in one row group is one task when read; the texts made of them are searched in several, with the same result."""
    path = f"{tmp_path}/customer.parquet"
    con = duckdb.connect()
    con.execute(f"copy (select c_custkey + k * 1000 as c_custkey from '{sf_dir}/customer.parquet', range(60) r(k)) to '{path}' (row_group_size 1000000)")
    con.execute(f"create view customer as select * from '{path}'")
    assert spark.read.parquet(path).rdd.getNumPartitions() == 1
    got = suite.queries()["detect_made_identifiers"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == -(-9000 // suite.MADE_ROWS) > 1
    result = con.execute(suite.oracle_sql()["detect_made_identifiers"])
    columns = [c[0] for c in result.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(result.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "redacted", "n_entities"] and df.count() > 0


def test_imports_without_the_corpus_operators():
    for missing in ("sparkveil.llm", "corpus_pipeline", "xxhash"):  # the folder, the pipeline, a module that they need
        code = f"import sys; sys.modules['{missing}'] = None\nimport __spark_entry__ as e; assert 'template_ccpa' in e.queries() and 'template_ccpa' in e.oracle_sql() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']"
        subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin:/bin"})


def test_nothing_imports_the_corpus_operators():
    for p in (ROOT / "sparkveil").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm import" not in p.read_text() and "from .llm" not in p.read_text()
