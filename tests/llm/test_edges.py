"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import chat_collapse, decontaminate, html_text, packing, quality, secrets, substring_dedup, token_store
from quarry.llm.exact_dedup import ExactDedup
from quarry.llm.ngram_join import NgramJoin

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, node long, key long, keep_id long, _qx string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(9000))


def rows(*pairs):
    return [(i, t, "en", "s", None if t is None else len(t), "a", 1, 2, 3, "b") for i, t in pairs]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(120))


@pytest.fixture(scope="module")
def docs(spark, prose):
    near = prose.split()
    near[60] = "changed"
    data = rows(
        (5, prose), (3, prose.replace(" ", "\n", 3)), (9, " ".join(near)), (None, prose), (None, None), (1, None), (2, ""), (2, ""), (7, "   \t\n"), (8, LONG), (11, "one two"), (12, "one two"),
        (20, "password = hunter22 é😀 token: abc AKIA" + "A1" * 10 + " " + "0f" * 20), (-4, "zz top " * 3),
    )
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    got = ExactDedup(docs).decisions().collect()
    assert len(got) == docs.count()
    want = collections.defaultdict(list)
    for d in docs.collect():
        want[" ".join((d.text or "").replace("\n", " ").split(" ")) if (d.text or "").strip() else ("" if not d.text else " ")].append(d.doc_id)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r.doc_id)
    assert sorted(sorted(map(str, g)) for g in groups.values()) == sorted(sorted(map(str, g)) for g in want.values())
    assert all(r.group_size == len(groups[r.text_sha256]) and r.keep_id == min((i for i in groups[r.text_sha256] if i is not None), default=None) for r in got)
    same = next(r for r in got if r.doc_id == 5)
    assert (same.keep_id, same.group_size, same.kept) == (3, 3, False)
    assert sorted(r.doc_id or 0 for r in ExactDedup(docs).survivors().collect()) == sorted(r.doc_id or 0 for r in kept)
    assert ExactDedup(docs).survivors().columns == docs.columns
    assert ExactDedup(none).decisions().count() == ExactDedup(none).survivors().count() == 0


def test_ngram_join(docs, none):
    got = {(r.doc_id, r.n_links): r.class_id for r in NgramJoin(docs).classes().collect() if r.doc_id in (3, 5, 9, 11, 12, 8, 2)}
    assert got[(9, 3)] == got[(5, 3)] == got[(3, 3)] == 3
    assert got[(11, 1)] == got[(12, 1)] == 11
    assert got[(8, 0)] == 8 and got[(2, 0)] == 2
    left = NgramJoin(docs).survivors()
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert 3 in ids and 5 not in ids and 9 not in ids and ids.count(11) == 1
    assert NgramJoin(none).classes().count() == NgramJoin(none).survivors().count() == 0


def test_decontaminate(spark, docs, none, prose):
    items = spark.createDataFrame([(1, " ".join(prose.split()[20:60]).upper(), "x"), (2, None, "x"), (3, ""  , "x"), (None, "zz top!", "x"), (4, "nowhere to be found at all", "x")], "item_id long, text string, key string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(5, 1), (3, 1), (9, 1), (None, 1), (-4, None)}  # the word that 9 changes is behind the item
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns
    assert {5, 3, -4}.isdisjoint({r.doc_id for r in clean.collect()})
    assert clean.where("doc_id = 8 OR doc_id = 2").count() == 3
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()


def made(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_decontaminate_beyond_the_radius(spark):
    rng = random.Random(11)
    items = [(k, made(rng, 50)) for k in range(150)]
    cut = spark.createDataFrame(rows(*((k, " ".join(w[:41])) for k, w in items)), SCHEMA)
    got = decontaminate.contaminated(cut, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in got} == {(k, k, 37 / 46) for k, _ in items}


def test_decontaminate_every_start(spark):
    """Words changed at the ends and put in between: against brute force over all starts."""
    rng = random.Random(12)
    items, data = [], []
    for k in range(30):
        w, n = made(rng, rng.randint(50, 70)), rng.randint(1, 2)
        mid = len(w) // 2 + rng.randint(-3, 3)
        copy = [*made(rng, 1), *w[1:mid], *made(rng, n), *w[mid:-1], *made(rng, 1)]
        around = [made(rng, 40), made(rng, rng.choice((0, 40)))] if k % 5 else [[], []]
        items.append((k, " ".join(w)))
        data.append((k, " ".join([*around[0], *copy, *around[1], *(copy if k % 7 == 0 else [])])))
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for (k, d), (_, i) in zip(data, items, strict=True):
        w, i = d.split(), i.split()
        for s in range(max(1, len(w) - len(i) + 1)):
            one, two = grams(w[s : s + len(i)]), grams(i)
            both = sum((one & two).values())
            want[k] = max(want.get(k, 0), both / (sum(one.values()) + sum(two.values()) - both))
    want = {k: s for k, s in want.items() if s >= 0.8}
    got = decontaminate.contaminated(spark.createDataFrame(rows(*data), SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 5 and {r.doc_id: r.similarity for r in got if r.doc_id == r.item_id} == want and len(got) == len(want)


def test_decontaminate_texts_of_one_id(spark):
    rng = random.Random(13)
    texts = [" ".join(made(rng, 30)) for _ in range(4)]
    items = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3])], "item_id long, text string")
    found = spark.createDataFrame(rows(*enumerate(texts)), SCHEMA)
    got = [(r.doc_id, r.item_id, r.similarity) for r in decontaminate.contaminated(found, items).collect()]
    assert sorted(got, key=lambda r: r[0]) == [(0, None, 1.0), (1, None, 1.0), (2, 7, 1.0), (3, 7, 1.0)]
    assert decontaminate.clean(found, items).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (5, 1), (3, 1), (9, 0), (8, 0), (20, 0), (None, 1), (11, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()


def test_token_store(spark, docs, none, tmp_path):
    file = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write(docs, f"{tmp_path}/a", file, 0, shard_ids=100)
    got = token_store.read(spark, f"{tmp_path}/a").orderBy("start").collect()
    plain = Tokenizer.from_file(file)
    data = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    at = 0
    for (missing, i, text), r in zip(data, got, strict=True):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert r.start == at and r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.doc_id == (None if missing else i)
        at += len(ids)
    token_store.write(none, f"{tmp_path}/b", file, 0)
    assert token_store.read(spark, f"{tmp_path}/b").count() == 0


def test_packing(docs, none):
    file = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, file, 1).collect()
    plain = Tokenizer.from_file(file)
    want = collections.Counter()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            want[(r.doc_id, p // 4096, p, tuple(ids[p : p + 4096]))] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in got)
    assert all(r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(none, file, 1).count() == 0


def test_substring_dedup(docs, none):
    got = collections.Counter(map(tuple, substring_dedup.deduplicated(docs).collect()))
    assert got == brute(docs, 35)
    assert substring_dedup.deduplicated(none).count() == 0


def brute(docs, window):
    data = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    seen = collections.Counter(tuple(w[i : i + window]) for _, w in data for i in range(len(w) - window + 1))
    out = collections.Counter()
    for i, w in data:
        gone = {k for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        out[(i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())] += 1
    return out


def test_secrets(spark, docs, none, tmp_path):
    ledger = secrets.BlobLedger(spark, f"{tmp_path}/ledger")
    got = ledger.scan(docs).collect()
    assert len(got) == docs.count()
    one = next(r for r in got if r.doc_id == 20)
    text = docs.where("doc_id = 20").first().text
    assert [(s.rule, text[s.start : s.end]) for s in one.spans if s.rule in ("assign", "hex", "access")] == [("assign", "password = hunter22"), ("access", "AKIA" + "A1" * 10), ("hex", "0f" * 20)]
    assert ledger.scan(none).count() == 0


def test_ledger_scans_a_pair_once(spark, docs, tmp_path):
    ledger = secrets.BlobLedger(spark, f"{tmp_path}/ledger")
    first = ledger.scan(docs).collect()
    blobs = ledger.rows().count()
    assert blobs == len({r.sha for r in first})
    again = ledger.scan(docs).collect()
    assert ledger.rows().count() == blobs and sorted(map(str, again)) == sorted(map(str, first))
    newer = tuple(r._replace(version=2) if r.name == "hex" else r for r in secrets.RULES)
    ledger.scan(docs, newer).count()
    assert {tuple(r.rules) for r in ledger.rows().collect()} == {tuple(r.key for r in secrets.RULES), ("hex@2",)}


def test_ledger_after_a_version_change(spark, tmp_path):
    docs = spark.createDataFrame(rows((1, "0f" * 12 + " AKIA" + "A1" * 10)), SCHEMA)
    ledger = secrets.BlobLedger(spark, f"{tmp_path}/ledger")
    kinds = lambda rules: sorted((s.rule, s.start, s.end) for s in ledger.scan(docs, rules).first().spans)
    access, hexes = ("access", 25, 49), ("hex", 0, 24)
    assert kinds(secrets.RULES) == [access, hexes]
    newer = tuple(r._replace(version=2, least=40) if r.name == "hex" else r for r in secrets.RULES)
    assert kinds(newer) == [access]
    assert kinds(tuple(r for r in secrets.RULES if r.name != "access")) == [hexes]
    assert kinds(secrets.RULES) == [access, hexes]


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, chunk int, h1 string"
    turns = [("user", "a"), ("bot", "b"), ("user", None), (None, "d")]
    data = [(c, k, r, t, 0, "") for c, n in ((1, 2), (2, 4), (3, 4), (None, 3), (5, 1)) for k, (r, t) in enumerate(turns[:n])]
    data += [(7, None, "user", "late", 0, ""), (7, 0, "user", "early", 0, ""), (7, 0, "user", "early", 0, "")]
    data += [(8, k, "user", f"t{k}", 0, "") for k in range(600)] + [(9, k, "user", f"t{k}", 0, "") for k in range(520)]
    got = chat_collapse.collapse_and_render(spark.createDataFrame(data, schema)).orderBy("conv_id", "part").collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(2, 4), (7, 3), (8, 600)}
    assert [r.part for r in got if r.conv_id == 8] == [0, 1, 2]
    text = "".join(r.text for r in got if r.conv_id == 2)
    assert text == "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)
    assert "".join(r.text for r in got if r.conv_id == 7).index("early") < "".join(r.text for r in got if r.conv_id == 7).index("late")
    assert chat_collapse.collapse_and_render(spark.createDataFrame([], schema)).count() == 0


def test_secrets_equal_a_plain_scan(spark, docs, tmp_path):
    """Every document of the smallest table and of ours, by patterns written out once more."""
    import re

    patterns = [("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 6), ("access", re.compile("(AKIA[A-Z0-9]+)"), 20), ("hex", re.compile("([0-9a-f]+)"), 24)]
    more = "Token:'abc12' secret = abc.def/7 api_key:\"zzzzzz\" PASSWORD=short " + "0f" * 11 + " " + "0f" * 12 + "G AKIA" + "B" * 15 + " AKIA" + "B" * 16
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(90, more), (91, more + more)], "doc_id long, text string"))
    spans = lambda found: sorted(x for x in found if x[1] in ("assign", "access", "hex"))
    got = [(r.doc_id, spans((s.start, s.rule, s.end) for s in r.spans)) for r in secrets.BlobLedger(spark, f"{tmp_path}/l").scan(docs).collect()]
    want = [(r.doc_id, spans((m.start(), k, m.end()) for k, p, least in patterns for m in p.finditer(r.text or "") if len(m[1] if k == "assign" else m[0]) >= least)) for r in docs.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(len(x) for _, x in want) > 10


def test_ledger_scans_alike_with_and_without_a_broadcast(spark, docs, tmp_path, monkeypatch):
    want = sorted(map(str, secrets.BlobLedger(spark, f"{tmp_path}/a").scan(docs).collect()))
    monkeypatch.setattr(secrets, "SHARE", 1)
    assert sorted(map(str, secrets.BlobLedger(spark, f"{tmp_path}/b").scan(docs).collect())) == want


def test_ngram_join_in_small_blocks(spark):
    """A group dealt out as pairs of blocks, some without nodes, has the links of the whole group."""
    rng = random.Random(14)
    base = made(rng, 80)
    data = [(k, " ".join(w if i != k else "x" for i, w in enumerate(base))) for k in range(5)]
    frame = spark.createDataFrame(rows(*data, (9, None), (10, "")), SCHEMA)
    for block in (1, 2, 256):
        assert sorted(map(tuple, NgramJoin(frame, block=block).classes().collect())) == [*((k, 0, 4) for k in range(5)), (9, 9, 0), (10, 10, 0)]
    assert sorted(map(tuple, NgramJoin(frame, block_bytes=500).classes().collect()))[:5] == [(k, 0, 4) for k in range(5)]


def test_packing_groups_do_not_grow(spark):
    """Lengths that leave a gap in every bin: no partition has more than about its share, and every bin is full or certified."""
    from pyspark.sql import functions as F

    seen = []
    real = packing._packer

    def packer(size, turn, last):
        seen.append((turn, last))
        return real(size, turn, last)

    lengths = spark.range(20_000).select(F.col("id").alias("uid"), (F.lit(1100) + F.pmod(F.xxhash64("id"), F.lit(800))).cast("long").alias("length"))
    packing._packer = packer
    try:
        got = packing.place(lengths, pieces=1000).join(lengths, "uid").collect()
    finally:
        packing._packer = real
    assert len(seen) <= packing.ROUNDS and len(got) == 20_000
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><div id="cookie-notice">We use cookies</div><nav><ul><li><a href="/">Home</a></ul></nav>
    <main><h1>Head &amp; line</h1><p>First&nbsp;<b>para</b>graph<br>goes on.<p>Second<script>var x = "</p>";</script> one</p><form><input><label>Name</label></form></main>
    <section class="comments"><article><p>I disagree</p></article></section><div class="ad">Buy!</div><footer>(c)</footer></body></html>"""
    plain = "<div class=menu>a b c</div><div><p>" + "Long text of an article without marks. " * 8 + "</p><p>Short.</p></div><div class='footer'>f</div>"
    data = [(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", plain, 0), (None, "u", page, 0), (6, "u", "<nav>only</nav>", 0)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string, text int")).collect()}
    want = "Head & line\n\nFirst paragraph goes on.\n\nSecond one"
    assert got[1].text == got[None].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == got[6].text == "" and got[2].n_chars == 0
    assert got[4].text == ("Long text of an article without marks. " * 8).strip() + "\n\nShort."
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_without_article():
    long = "A long paragraph of an article that no element marks. " * 12
    cells = "".join(f"<tr><td>k{i}</td><td>{i}</td></tr>" for i in range(9))
    inner = f"<div><p>{long}</p></div><div><p>Short one.</p></div><div><table>{cells}</table></div><blockquote>So it goes.</blockquote><div><p>Brief.</p></div><div><p>{long}</p></div>"
    want = [long.strip(), "Short one.", *(x for i in range(9) for x in (f"k{i}", str(i))), "So it goes.", "Brief.", long.strip()]
    for page in (f"<body>{inner}</body>", f"<body><div class=menu>a b</div><div>{inner}</div><div class=footer>f</div></body>"):
        assert html_text.main_text(page).split("\n\n") == want
    tail = f"<body><p>{long}</p><p>Then.</p><table>{cells}</table><blockquote>The end.</blockquote></body>"
    assert html_text.main_text(tail).split("\n\n") == [long.strip(), "Then.", *want[2:20], "The end."]


def test_html_clusters_inside_an_article():
    """Regions of links without a cluster go, at either end; short paragraphs in elements of their own stay."""
    long = "A long paragraph that an article has, with many words in it. " * 6
    links = "<ul>" + "".join(f"<li><a href='/{i}'>see {i}</a></li>" for i in range(8)) + "</ul>"
    inner = f"<div>{links}</div><h1>Head</h1><p>{long}</p><div><p>Aside, <a href='/x'>so</a>.</p></div><p>{long}</p><div><p>Yes.</p></div><div><p>Yes, yes.</p></div><div>{links}</div>"
    want = ["Head", long.strip(), "Aside, so.", long.strip(), "Yes.", "Yes, yes."]
    for page in (f"<article>{inner}</article>", f"<body><p>{long}</p><main><article>{inner}</article></main></body>", f"<div><div role=main>{inner}</div></div>"):
        assert html_text.main_text(page).split("\n\n") == want
    assert html_text.main_text(f"<article><h1>All</h1>{links}<p>{long}</p></article>").split("\n\n") == ["All", *(f"see {i}" for i in range(8)), long.strip()]


def test_html_of_deep_and_long_pages():
    long = "word " * 200_000
    assert html_text.main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert html_text.main_text("<div>" * 3000 + "<p>Deep in it.</p>" + "</div>" * 3000) == "Deep in it."


def test_sha_of_secrets_digest(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    found = secrets.BlobLedger(spark, f"{tmp_path}/l").scan(docs)
    base = tuple(r.name for r in secrets.BASE)
    row = found.where("doc_id = 1").select(F.sha2(secrets.listed(F.col("spans"), base), 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"").hexdigest()
