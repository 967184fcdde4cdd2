"""Pairs of regions whose shared hashes are in very many regions."""

import collections
import itertools
import random

import pytest

from quarry.functions import kernels
from quarry.operators import similarity
from quarry.plans import corpus_queries


def texts():
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 5000)}"
    near, passage, line = [word() for _ in range(60)], [word() for _ in range(50)], [word() for _ in range(14)]
    out = [near[:k] + [word()] + near[k + 1 :] for k in range(0, 60, 2) for _ in range(2)]  # one group of near misses
    out += [[word() for _ in range(20)] + passage + [word() for _ in range(40 + k)] for k in range(40)]  # one passage
    out += [[word() for _ in range(30)] + line + [word() for _ in range(30)] for _ in range(40)]  # one line: a seed or two
    out += [out[0]] * 35 + [out[70]] * 3 + [[]] * 3 + [line] * 3
    rng.shuffle(out)
    return out


def plain(own):
    """near misses and fragments of all pairs of different texts, by their definition."""
    prints = [collections.Counter(h for h, _ in kernels.winnow(t, separator=" ")) for t in own]
    near, found = {}, set()
    for a, b in itertools.combinations(range(len(own)), 2):
        if own[a] == own[b] or sum(n * prints[b][h] for h, n in prints[a].items()) < similarity.LEAST_SEEDS:
            continue
        s = kernels.sequence_similarity(own[a], own[b], 0.0, None)
        if s >= similarity.STRONG or (min(len(own[a]), len(own[b])) >= similarity.BROAD_TOKENS and s >= similarity.BROAD):
            near[a, b] = s
        else:
            at = similarity.seeds_at(own[a], own[b], prints[a].keys() & prints[b].keys(), " ", None)
            found |= {(a, b, *m) for m in kernels.maximal_matches(own[a], own[b], at, most=None, matches=None)}
    return near, found


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    own, path = texts(), tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(own)], "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    first = {}
    for k, t in enumerate(own):
        first.setdefault(tuple(t), k)
    return own, first, str(path)


@pytest.mark.parametrize("block", [similarity.BLOCK, 16])
def test_pairs_of_hashes_in_many_regions(spark, tables, monkeypatch, block):
    own, first, path = tables
    init = similarity.Pairs.__init__
    monkeypatch.setattr(similarity.Pairs, "__init__", lambda self, *a: init(self, *a, block=block))
    near, found = plain(own)
    copies = [(first[tuple(t)], k) for k, t in enumerate(own) if first[tuple(t)] != k]
    tops = set(first.values())
    want = {p: s for p, s in near.items() if tops.issuperset(p)} | {p: 1.0 for p in copies if len(kernels.winnow(own[p[0]], separator=" ")) >= 2}
    got = corpus_queries.doc_near_miss_verified(spark, path).collect()
    assert len(got) == len(want) and {(r.left, r.right): r.similarity for r in got} == pytest.approx(want)
    # every near miss of all documents is in it, by the first documents of its words
    assert all(tuple(sorted((first[tuple(own[a])], first[tuple(own[b])]))) in want for a, b in near)
    whole = {(*p, 0, len(own[p[0]]) - 1, 0, len(own[p[0]]) - 1) for p in copies if len(own[p[0]]) >= kernels.FRAGMENT and p in want}
    rows = corpus_queries.doc_fragment_matches(spark, path).collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == {m for m in found if tops.issuperset(m[:2])} | whole
    assert len(want) > 1000 and len(rows) > 700  # of groups of over MOST_REGIONS


def test_regions_of_wide_hashes_are_told_once(spark):
    rows = [(d, 5, p) for d in range(100) for p in range(1 + d % 3)] + [(d, 6, 0) for d in range(31)] + [(d, 7, 0) for d in range(30)] + [(d, 8, 0) for d in range(40)]
    frame = spark.createDataFrame(rows, "doc long, hash long, pos int").coalesce(1)
    want = sorted([(5, d) for d in range(100)] + [(6, d) for d in range(31)] + [(8, d) for d in range(40)])
    for size in (3, 7, 33, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = similarity._paired(frame, "doc", wide=True).where("right IS NULL").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r.hash, r.left) for r in got) == want


def test_matches_and_long_texts_without_bounds():
    words = [f"w{k}" for k in range(3000)]
    parts = [words[50 * k : 50 * k + 45] for k in range(55)]
    left, right = ([x for k, p in enumerate(own) for x in [*p, f"{side}{k}"]] for side, own in (("l", parts), ("r", parts[::-1])))
    at = similarity.seeds_at(left, right, [h for h, _ in kernels.winnow(left)], kernels.SEPARATOR, None)
    assert len(kernels.maximal_matches(left, right, at, most=None, matches=None)) == 55 > len(kernels.maximal_matches(left, right, at))
    assert kernels.sequence_similarity(words, words[:-1], 0.0) == 0.0 and kernels.sequence_similarity(words, words[:-1], 0.0, None) > 0.99
