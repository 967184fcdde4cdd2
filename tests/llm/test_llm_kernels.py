"""Kernels against plain versions: tokenizer cache, Elias-Fano code, packing bounds, windows, bands, smoothing."""

import random
import types

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from quarry.llm import packing, quality, substring_dedup
from quarry.llm.elias_fano import EliasFano
from quarry.llm.html_text import smoothed
from quarry.llm.ngram_join import BANDS, ROWS, bands_of, linked, shingles
from quarry.llm.token_store import Shard, shard_bytes
from quarry.llm.words import Encoder

PARTS = ["a", " ", "  ", "\n", "\t", "é", " ", "᠎", "\x1c", "'s", "'ll", "'", "1", "23", "$", "!!", "İ", "Σ", "ς", "ﬁ", "é", "中文", "<|endoftext|>", "</w>", "😀", "THE", "don't", " ", "\x85", "\r\n", "_", "ß", "word", "Word,", "\0"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    coder = Encoder(public_tokenizers.path(name))
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() for x in coder.ids(pa.array(texts))] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    coder.chunks.size = coder.units.size = 5  # and with a full one
    more = ["".join(rng.choice(PARTS) for _ in range(9)) for _ in range(500)]
    assert [x.tolist() for x in coder.ids(pa.array(more))] == [e.ids for e in plain.encode_batch(more, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=1200))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.int64))
    code, size = EliasFano.from_bytes(memoryview(EliasFano.of(values).to_bytes()))
    assert (code.all() == values).all()
    assert [code[i] for i in range(len(values))] == values.tolist()
    for i, j in ((0, 1), (1, 5), (500, 530), (len(values) - 3, len(values))):
        assert code.between(max(0, i), min(j, len(values))).tolist() == values[max(0, i) : j].tolist()


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(EliasFano.of(ends).to_bytes()) < 50_000 * 13 / 8 + 1000


def test_shard_round_trip():
    lengths = np.array([3, 0, 2, 5])
    shard = Shard(shard_bytes([-5, 7, 7, None], lengths, np.arange(10), 2))
    assert shard.doc_ids(1, 4) == [7, 7, None] and shard.doc_ids(3, 4) == [None]
    assert [(i, x.tolist()) for i, x in map(shard.document, range(4))] == [(-5, [0, 1, 2]), (7, []), (7, [3, 4]), (None, [5, 6, 7, 8, 9])]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_packing(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, room = packing.best_fit_decreasing(lengths, 20)
    bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)
    assert bound <= fewest(lengths.tolist(), 20) <= len(room)
    used = np.bincount(bins, lengths, len(room)) if len(room) else np.empty(0)
    assert (used + room == 20).all()


def fewest(lengths, size):
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i, b in enumerate(bins):
            if b + lengths[k] <= size:
                place(k + 1, [*bins[:i], b + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_windows_hash_alike_only_if_equal():
    rng = random.Random(2)
    words = [rng.choice("ab") for _ in range(400)]
    made = substring_dedup.Words(pa.array([" ".join(words)]))
    hashes = substring_dedup.rolled(made.hashes, 7)
    same = {}
    for i, h in enumerate(hashes.tolist()):
        assert same.setdefault(h, words[i : i + 7]) == words[i : i + 7]
    assert len(same) == len({tuple(words[i : i + 7]) for i in range(394)})
    values = np.array([rng.randint(0, 99) for _ in range(60)])
    assert substring_dedup.sliding_min(values, 11).tolist() == [values[i : i + 11].min() for i in range(50)]


def test_super_kmers_cover_each_window_once():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (90, 3, 35, 0, 34, 60)]
    words = substring_dedup.Words(pa.array([f" {t}\n" for t in texts]))
    for hot in (np.empty(0, np.uint64), np.unique(substring_dedup.windows(words, 35)[1])[::2]):
        first, n, _ = substring_dedup.super_kmers(words, 35, np.sort(hot))
        covered = [s + k for s, m in zip(first.tolist(), n.tolist()) for k in range(m)]
        assert covered == substring_dedup.windows(words, 35)[0].tolist()


def test_band_counts_meet_the_recall():
    assert 1 - (1 - 0.8**ROWS) ** BANDS > 0.9999


def test_links_of_a_group_are_exact():
    rng = random.Random(6)
    base = [str(rng.randint(0, 999)) for _ in range(80)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = "x"
        texts.append(" ".join(w))
    sets = shingles(texts)
    links, _ = linked(sets, np.ones(40, np.int64), np.zeros(40, np.int64), False)
    want = [sum(len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) - 1e-9 for b in sets) - 1 for a in sets]
    assert links.tolist() == want
    assert bands_of(sets).shape == (40, BANDS)


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = quality.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    keys, values = rng.choice(50, 12, replace=False), rng.normal(size=12)
    want = 0.3 + (model.linear[keys] * values).sum() + sum(model.factors[keys[i]] @ model.factors[keys[j]] * values[i] * values[j] for i in range(12) for j in range(i))
    got = quality.raw_scores(model, np.zeros(12, np.int64), keys, values, 1)
    assert abs(got[0] - want) < 1e-9


def test_smoothing_keeps_a_constant():
    assert all(abs(x - 4) < 1e-12 for x in smoothed([4.0] * 9))


def test_unseen_chunks_are_encoded_together(monkeypatch):
    file = public_tokenizers.path("byte_bpe_50k.json")
    coder, plain = Encoder(file), Tokenizer.from_file(file)
    asked: list[str] = []
    encode = coder.tokenizer.encode_batch
    coder.tokenizer = types.SimpleNamespace(encode_batch=lambda texts, **more: asked.extend(texts) or encode(texts, **more))
    long = " ".join(f"wort{n},\nWört{n} it's<|endoftext|>%%" for n in range(900))
    texts = [long, "", "one", " odd  text \n ", "it's it's\nnot'll 東京  x", "a\x00b c", long[:500]]
    assert [x.tolist() for x in coder.ids(pa.array(texts))] == [_plain(plain, t) for t in texts]
    assert len(asked) < 25 and not coder.units.place
    # ids that don't tell their bytes: chunk by chunk instead
    coder = Encoder(file)
    coder.measure[5::7] = 0
    assert [x.tolist() for x in coder.ids(pa.array(texts))] == [_plain(plain, t) for t in texts]


def _plain(tokenizer, text):
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text, add_special_tokens=False).ids
