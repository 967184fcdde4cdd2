"""Pipeline stages and queries on the smallest tables, against plain versions and DuckDB."""

import collections
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import quality
from quarry.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def sql(text):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(text)
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    columns, rows = sql(q.oracle_sql()[name])
    frame = q.queries()[name](spark, SF)
    order = sorted(columns)
    assert sorted(frame.columns) == order
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in frame.collect()), key=repr) == want


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        given = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert k == 4 or docs.columns == columns
        out.append((given, docs.collect()))
    return out


def test_quality_stage(stages):
    given, kept = stages[0]
    labels = dict(sql("SELECT doc_id, quality FROM labels")[1])
    text, size = {r[0]: r[1] for r in given}, {r[0]: r[4] for r in given}
    known = sorted(d for d in labels if zlib.crc32(str(d).encode()) % 3 != 1)
    model = quality.fit(*quality.features([text[d] for d in known], [size[d] for d in known]), np.array([labels[d] for d in known], float))
    ids = sorted(text)
    scores = quality.logistic(quality.raw_scores(model, *quality.features([text[d] for d in ids], [size[d] for d in ids]), len(ids)))
    assert sorted(r.doc_id for r in kept) == [d for d, s in zip(ids, scores, strict=True) if s >= 0.5]
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    right = [(scores[ids.index(d)] >= 0.5) == (labels[d] == 1) for d in held]
    assert sum(right) / len(right) >= 0.9


def test_exact_stage(stages):
    given, kept = stages[1]
    first = {}
    for r in sorted(given):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r[0])
    assert sorted(r.doc_id for r in kept) == sorted(first.values())


def test_near_stage(stages):
    given, kept = stages[2]
    sets = {}
    for r in given:
        w = (r[1] or "").encode().split()
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    assert sorted(r.doc_id for r in kept) == sorted({root(i) for i in sets})


def test_leak_stage(stages):
    given, kept = stages[3]
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [words(t) for (t,) in sql("SELECT text FROM benchmark")[1]]
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    dirty = set()
    for r in given:
        w = words(r[1])
        own = set(grams(w))
        for item in items:
            want = grams(item)
            if not own & set(want):
                continue
            for s in range(max(1, len(w) - len(item) + 1)):
                got = grams(w[s : s + len(item)])
                both = sum((got & want).values())
                if both >= 0.8 * (sum(got.values()) + sum(want.values()) - both):
                    dirty.add(r[0])
    assert dirty and sorted(r.doc_id for r in kept) == sorted(r[0] for r in given if r[0] not in dirty)


def test_packing_stage(stages):
    given, pieces = stages[4]
    assert {r.doc_id for r in pieces} == {r[0] for r in given}
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in pieces) // 4096) + 1
