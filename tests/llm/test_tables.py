"""Registered queries over the whole smallest tables, against plain versions of their contracts."""

import collections
import hashlib
import html
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def encoded(name, end_id, docs):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    return {i: np.array([*plain.encode(t, add_special_tokens=False).ids, end_id], "<u4") for i, t in docs.items()}


def test_token_store(spark, docs):
    at, want = 0, []
    for i, ids in sorted(encoded("byte_bpe_50k.json", 0, docs).items()):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, q.op4_token_store(spark, SF).collect())) == want


def test_packing(spark, docs):
    want = [(i, p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(ids[p : p + 4096].tobytes())) for i, ids in encoded("word_bpe_49k.json", 1, docs).items() for p in range(0, len(ids), 4096)]
    got = q.op7_packing(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    bound = packing.lower_bound(np.bincount([w[3] for w in want], minlength=4097), 4096)
    assert bound <= len(bins) <= bound + 1


def test_substring_dedup(spark, docs):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for i, t in docs.items()}
    seen = collections.Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    want = []
    for i, w in words.items():
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    assert sorted(map(tuple, q.op6_substring_dedup(spark, SF).collect())) == sorted(want) and any(w[2] for w in want)


def test_ngram_join(spark, docs):
    sets = {}
    for i, t in docs.items():
        w = t.encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = lambda a, b: bool(sets[a]) and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    links = {a: [b for b in sets if a != b and near(a, b)] for a in sets}
    top = {}
    for a in sorted(sets):
        todo = [a] if a not in top else []
        while todo:
            x = todo.pop()
            if x not in top:
                top[x] = a
                todo += links[x]
    got = {r.doc_id: (r.class_id, r.n_links) for r in q.op8_ngram_join(spark, SF).collect()}
    assert got == {a: (top[a], len(links[a])) for a in sets} and any(links.values())


def test_html_text(spark):
    """The tables' pages have one article of plain blocks: by patterns, without a parser."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {}
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html or "", re.S)
        blocks = re.split(r"</?(?:h[1-6]|p|li|ul|ol|div|blockquote|table|tr|td|pre|section)\b[^>]*>", re.sub(r"<(script|style)\b.*?</\1>", "", inner[1] if inner else "", flags=re.S))
        plain = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\b[^>]*>", " ", b))).split()) for b in blocks)
        text = "\n\n".join(filter(None, plain))
        want[p.page_id] = (p.url, text, len(text))
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in q.op9_html_text(spark, SF).collect()} == want


def test_secrets(spark, docs):
    kinds = [("assign", re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 6), ("access", re.compile("(AKIA[A-Z0-9]+)"), 20), ("hex", re.compile("([0-9a-f]+)"), 24)]
    want = {}
    for i, t in docs.items():
        found = sorted((m.start(), n, m.end()) for n, (_, p, least) in enumerate(kinds) for m in p.finditer(t) if (len(m[1]) if n == 0 else m.end() - m.start()) >= least)
        text = ",".join(f"{kinds[n][0]}:{a}:{z}" for a, n, z in found)
        want[i] = (*(sum(n == k for _, n, _ in found) for k in range(3)), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in q.op10_secrets(spark, SF).collect()} == want
