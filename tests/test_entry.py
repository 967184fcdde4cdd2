"""Every query with SQL against DuckDB on the smallest tables; the entry point without the training-data operators."""

import os
import subprocess
import sys
from functools import cache

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import corpus_queries, tree_queries
from quarry.plans.project import Project

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def tree(spark):
    """One analysis for all queries over it."""
    return cache(lambda: Project(spark, files=tree_queries.files(spark, SF)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(corpus_queries.SQL | tree_queries.SQL))
def test_query_equals_sql(spark, duck, tree, monkeypatch, name):
    monkeypatch.setattr(tree_queries, "project", lambda *_: tree())
    frame = entry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    assert got == want


def test_everything_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_optional_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 30 and not any(n.startswith('op') for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
