"""Operators on small frames against plain versions."""

import collections
import random

from pyspark.sql import functions as F

from quarry.functions import dice, kernels, normalize_fragment, percent, portable_path, simple_type_name, stable_hash, utf16_length
from quarry.operators import graph, ordered, resolve, similarity
from quarry.operators.components import connected_components
from quarry.operators.intervals import merge_intervals, overlap, within


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, 100), (None, 3)]
    top = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = sorted((root(a), root(b)))
            top[rb] = ra
    want = {x: root(x) for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_reach_follows_first_in_first_out(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}", k) for k in range(60)]
    seeds = [("n3", 0), ("n7", 1)]
    parent, queue = {s: None for s, _ in seeds}, [s for s, _ in seeds]
    for node in queue:
        for a, b, _ in edges:
            if a == node and b not in parent:
                parent[b] = node
                queue.append(b)

    def path(n):
        return [n] if parent[n] is None else [*path(parent[n]), n]

    frame = spark.createDataFrame(edges, "source string, target string, slot int").groupBy("source", "target").agg(F.min("slot").alias("slot"))
    got = {r.node: r.path for r in graph.reach(frame, spark.createDataFrame(seeds, "node string, rank int"), paths=True).collect()}
    assert got == {n: path(n) for n in parent}


def test_closure_ends_in_a_circle(spark):
    frame = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None)], "node string, parent string")
    got = {(r.node, r.ancestor) for r in graph.closure(frame).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"} | {("d", y) for y in "abc"}


def test_local_and_stored_searches_agree(spark):
    """Random graphs with circles: the same rows from a gathered relation and level by level."""
    rng = random.Random(9)
    for n in (14,):
        edges = {(f"n{rng.randint(0, n)}", f"n{rng.randint(0, n)}") for _ in range(n + 6)}
        rows = [(a, b, k) for k, (a, b) in enumerate(sorted(edges))]
        frame = spark.createDataFrame(rows, "source string, target string, slot long")
        seeds = spark.createDataFrame([("x", "n1", 0), ("x", "n2", 1), ("y", "n3", 0), ("z", "nowhere", 0)], "label string, node string, rank long")
        for own in (seeds, seeds.drop("label")):
            one, two = (sorted(map(str, graph.reach(frame, own, paths=True, local=local).drop("place").collect())) for local in (0, 10_000))
            assert one == two
        parents = frame.select(F.col("source").alias("node"), F.col("target").alias("parent"))
        pairs = frame.select(F.col("source").alias("u"), F.col("target").alias("v"))
        starts, tests = (spark.createDataFrame([(x,)], "node string") for x in ("n1", "n4"))
        nodes = spark.createDataFrame([(f"n{i}",) for i in range(n + 1)], "node string")
        for search in (lambda k: graph.closure(parents, local=k), lambda k: graph.circular(frame, local=k), lambda k: connected_components(pairs, local=k), lambda k: graph.three_valued(nodes, frame, starts, tests, local=k)):
            assert sorted(map(str, search(0).collect())) == sorted(map(str, search(10_000).collect()))
        out = collections.defaultdict(set)
        for a, b in edges:
            out[a].add(b)

        def found(a):
            seen, todo = set(), list(out[a])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += out[x]
            return seen

        want = {a for a in list(out) if any(x in found(x) for x in found(a) | {a})}
        assert {r.node for r in graph.circular(frame).collect()} == want


def test_exclusive(spark):
    nodes = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c")], "path string, node string")
    edges = spark.createDataFrame([("a", "b"), ("x", "c")], "source string, target string")
    assert [r.node for r in graph.exclusive(nodes, edges, spark.createDataFrame([("a",)], "node string")).collect()] == ["b"]


def test_merge_intervals(spark):
    rng = random.Random(3)
    data = [(k, a, a + rng.randint(0, 8)) for k in "ab" for a in (rng.randint(0, 80) for _ in range(20))]
    got = merge_intervals(spark.createDataFrame(data, "k string, s int, e int"), ["k"], "s", "e").collect()
    for key in "ab":
        covered = {x for k, a, z in data if k == key for x in range(a, z + 1)}
        own = sorted((r.s, r.e) for r in got if r.k == key)
        assert {x for a, z in own for x in range(a, z + 1)} == covered and all(b[0] > a[1] + 1 for a, b in zip(own, own[1:]))
    one = spark.range(1).select(overlap(*map(F.lit, (1, 3, 3, 5))).alias("o"), within(*map(F.lit, (1, 9, 2, 10))).alias("w")).first()
    assert one.o and not one.w


def test_last_wins_and_reaching(spark):
    frame = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("a", 3, 30), ("b", 4, None)], "k string, seq int, v int")
    assert {tuple(r) for r in ordered.last_wins(frame, ["k"], "seq", ["v"]).collect()} == {("a", 1, 30), ("b", 2, None)}
    frame = spark.createDataFrame([("x", 1, True), ("x", 2, False), ("x", 3, True), ("x", 4, True), ("x", 5, False)], "k string, o int, c boolean")
    got = [(r.since, r.alternatives) for r in ordered.reaching(frame, ["k"], ["o"], F.col("c")).orderBy("o").collect()]
    assert got == [(None, 1), (2, 0), (2, 1), (2, 2), (5, 0)]


def test_resolve_takes_the_first_tier(spark):
    refs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "ref int")
    near, far = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "ref int, target string"), spark.createDataFrame([(1, "z"), (3, "z")], "ref int, target string")
    got = collections.Counter((r.ref, r.tier, r.target, r.resolution) for r in resolve.resolve(refs, "ref", [("near", lambda left: left.join(near, "ref")), ("far", lambda left: left.join(far, "ref"))]).collect())
    assert got == collections.Counter([(1, "near", "a", "exact"), (2, "near", "a", "conservative"), (2, "near", "b", "conservative"), (3, "far", "z", "exact"), (4, None, None, "unresolved")])


def test_functions(spark):
    row = spark.range(1).select(
        simple_type_name(F.lit("Map<Id, A.B>[]")).alias("a"), simple_type_name(F.lit("ns.Outer.Inner")).alias("b"), utf16_length(F.lit("a😀b")).alias("c"), percent(F.lit(1005), F.lit(100000)).alias("d"),
        percent(F.lit(1), F.lit(0)).alias("e"), stable_hash(F.lit("a")).alias("f"), normalize_fragment(F.lit("WHERE A = 'x' AND n > 10 AND id = :v.Id")).alias("g"), portable_path(F.lit(".\\a\\b")).alias("h"), dice(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("i"),
    ).first()
    assert row.asDict() == {"a": "Map", "b": "Inner", "c": 4, "d": 1.01, "e": 0.0, "f": "e40c292c", "g": "wherea=?andn>?andid=:bind", "h": "a/b", "i": 2 / 3}


def test_labels_are_searched_by_executors(spark, monkeypatch):
    """Many labels over one gathered graph: nothing of the result is made in the driver, and the rows are those of the search level by level."""
    rng = random.Random(12)
    edges = spark.createDataFrame([(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}", k) for k in range(45)], "source string, target string, slot long").groupBy("source", "target").agg(F.min("slot").alias("slot"))
    seeds = spark.createDataFrame([(x, f"n{rng.randint(0, 30)}", k) for k, x in enumerate("abcdefgh" * 2)] + [("i", "nowhere", 0)], "label string, node string, rank long")
    monkeypatch.setattr(graph, "_searched", None)
    shown = lambda df: sorted(map(str, df.select("label", "node", "hops", "path").collect()))
    assert shown(graph.reach(edges, seeds, paths=True, local=60)) == shown(graph.reach(edges, seeds, paths=True))
    one, two = (graph.reach(edges, seeds, places=True, local=k).collect() for k in (60, 0))
    order = lambda rows: [(r.label, r.hops, r.node) for r in sorted(rows, key=lambda r: (r.label, r.hops, r.place))]
    assert order(one) == order(two) and "path" not in one[0]


def test_candidate_pairs_never_pair_places(spark):
    """Seeds as the definition counts them; a hash that stands often in two regions makes no row for each two of its places."""
    rng = random.Random(5)
    prints = [(d, rng.randint(0, 40), p) for d in range(12) for p in range(30)] + [(d, 99, p) for d in (3, 4) for p in range(400)] + [(d, 98, 0) for d in range(31)] + [(d, 97, 1) for d in range(30)] + [(None, 97, 2)]
    regions, places = collections.defaultdict(set), collections.Counter((d, h) for d, h, _ in prints if d is not None)
    for d, h in places:
        regions[h].add(d)
    want = collections.Counter()
    for h, own in regions.items():
        for a in own if 2 <= len(own) <= similarity.MOST_REGIONS else ():
            for b in own:
                if a < b:
                    want[a, b] += places[a, h] * places[b, h]
    frame = spark.createDataFrame(prints, "doc long, hash long, pos int")
    pairs = similarity.candidate_pairs(frame, "doc", hashes=True)
    got = {(r.left, r.right): (r.seeds, set(r.hashes)) for r in pairs.collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, n in want.items() if n >= similarity.LEAST_SEEDS}
    assert all(hashes == {h for h, own in regions.items() if len(own) in range(2, similarity.MOST_REGIONS + 1) and {*pair} <= own} for pair, (_, hashes) in got.items())
    # 160,000 pairs of places of one hash: its two regions are one row before rows are added up
    plan = pairs._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString()
    # read in small batches, so that hashes go on over their ends
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {(r.left, r.right): r.seeds for r in similarity.candidate_pairs(frame, "doc").collect()} == {k: n for k, (n, _) in got.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_verified_and_fragments_of_packed_tokens(spark):
    """Against plain versions over pairs of places; tokens with the marks of packing come back."""
    assert similarity.unpacked("") == []
    rng = random.Random(6)
    line = [f"w{k}" for k in range(60)]
    texts = [line, line + ["x\x1fy", "\x1e0"], line[:50] + [f"v{rng.randint(0, 9)}" for _ in range(80)], line * 3, [f"q{rng.randint(0, 9)}" for _ in range(50)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, tokens array<string>")
    prints = similarity.fingerprints(df, "doc", "tokens")
    pairs = spark.createDataFrame(similarity.candidate_pairs(prints, "doc", hashes=True).collect(), "left long, right long, seeds long, hashes array<long>")
    want = {(a, b) for a in range(4) for b in range(a + 1, 4)}
    checked = similarity.verified(pairs, df, "doc", "tokens").collect()
    assert {(r.left, r.right): r.similarity for r in checked} == {(a, b): kernels.sequence_similarity(texts[a], texts[b], 0) for a, b in want}
    found = collections.defaultdict(list)
    for r in similarity.fragments(pairs, df, "doc", "tokens").collect():
        found[r.left, r.right].append(tuple(r)[2:])
    own = [kernels.winnow(t) for t in texts]
    for a, b in want:
        at = sorted((i, j) for h, i in own[a] for g, j in own[b] if g == h)
        assert sorted(found[a, b]) == sorted(kernels.maximal_matches(texts[a], texts[b], at))
