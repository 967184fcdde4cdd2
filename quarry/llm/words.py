"""Tokenizing with a cache of word pieces, and flat arrays of many short ones.

A BPE of words never merges over the borders of its own pre-tokens, so a text's ids are its chunks' ids in a row.
Chunks repeat a lot: each is encoded once by the tokenizers library, and its ids are reused within the Python worker.
Where spaces have ids, new chunks are encoded many at a time, as a text that has them in a row; where white space is dropped,
the words and marks that they consist of are, which repeat even more. Cutting happens only where the tokenizer itself must cut;
whatever is not plainly such a place stays in one piece.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks, and units of them, in the caches of one worker; beyond that, new ones are kept for their batch only. Where
#: chunks are encoded without units, more of them have room.
CHUNKS, UNITS, ALONE = 300_000, 600_000, 500_000
#: Chunks that are encoded as one text, such texts at a time (the library's results are large), places that are gathered at once.
JOINED, TEXTS, BLOCK = 1000, 16, 1 << 15
#: Letters whose lower case is one letter, and marks that are never part of a contraction.
_L, _P = "[A-Za-zÀ-ÖØ-öø-ÿŒœŠšŸŽž]+", r"[!-&(-/:-@\[-`{-~]+"
_PLAIN = re.compile(rf" ?{_L}(?:{_P})?(?:\n{_L}(?:{_P})?)*")
_UNITS = re.compile(rf" ?{_L}|{_P}|\n")
_WORD = re.compile(_L)
#: Texts with white space beside white space or at an end, or with unusual white space, are cut with more care.
_ODD = r"^[ \t\n\r]|[ \t\n\r]\z|  | [\t\n\r]|[\t\n\r] |[\x00\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BEFORE_SPACE = re.compile("(?<=[^\\s\u180e])(?= [^\\s\u180e])")
_WHITE = re.compile(r"[\x20\x09-\x0D]+")


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[s : s + n] of all (s, n), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Table:
    """Ids of strings, by place; those beyond the cache's size stay until the next forget()."""

    def __init__(self, size: int):
        self.size = size
        self.place: dict[str, int] = {}
        self.extra: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        base, room = len(self.starts), max(0, self.size - len(self.place))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
        self.place.update(zip(keys[:room], range(base, base + len(keys)), strict=False))
        self.extra.update(zip(keys[room:], range(base + min(room, len(keys)), base + len(keys)), strict=True))

    def forget(self) -> None:
        if self.extra:
            n = len(self.place)
            self.extra = {}
            self.starts, self.lengths = self.starts[:n].copy(), self.lengths[:n].copy()
            self.flat = self.flat[: int(self.starts[-1] + self.lengths[-1])].copy() if n else self.flat[:0]

    def places(self, keys: list[str], learn) -> np.ndarray:
        """Where each is. learn(new keys) adds those that aren't there."""
        at = np.array(list(map(self.place.get, keys, repeat(-1))), np.int64)
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            absent = [keys[k] for k in missing]
            if new := list(dict.fromkeys(c for c in absent if c not in self.extra)):
                learn(new)
            at[missing] = [self.extra[c] if c in self.extra else self.place[c] for c in absent]
        return at

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each place has. They are gathered in blocks, whose indices stay in the processor's cache."""
        lengths = self.lengths[at]
        out, end = np.empty(int(lengths.sum()), np.uint32), 0
        for k in range(0, len(at), BLOCK):
            found = gathered(self.flat, self.starts[at[k : k + BLOCK]], lengths[k : k + BLOCK])
            out[end : end + len(found)], end = found, end + len(found)
        return out, lengths


class Encoder:
    """ids(texts) are what the tokenizer file gives for each text, special tokens neither added nor read."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.spaced = self.tokenizer.normalizer is None  # else white space is dropped
        vocabulary = self.tokenizer.get_vocab()
        #: Of each id: the bytes it stands for (a byte is one character of its name), or whether a word ends with it.
        self.measure = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, i in vocabulary.items():
            self.measure[i] = len(name) if self.spaced else name.endswith("</w>")
        self.chunks, self.units = Table(ALONE if self.spaced else CHUNKS), Table(0 if self.spaced else UNITS)

    def id_bytes(self, *more: int) -> int:
        """Bytes that hold any id of the vocabulary, and the ids in more."""
        return 2 if max(len(self.measure) - 1, *more) < 1 << 16 else 4

    def cut(self, text: str) -> list[str]:
        """Chunks of an odd text. One that is to be read without a space before it starts with a zero character, if spaces count."""
        if not self.spaced:
            return [c for c in _WHITE.split(text) if c]
        return ["\0" + c for c in _BEFORE_SPACE.split(text)]

    def encode(self, units: list[str]) -> None:
        """Words are joined and encoded many at a time, other units one by one."""
        joins = [_WORD.fullmatch(u) is not None for u in units]
        words, rest = [u for u, j in zip(units, joins, strict=True) if j], [u for u, j in zip(units, joins, strict=True) if not j]
        groups = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([" ".join(g) for g in groups] + rest, add_special_tokens=False)]
        counts = [np.diff(np.flatnonzero(self.measure[r]) + 1, prepend=0) for r in got[: len(groups)]]  # by the ids that end a word
        self.units.add(words + rest, np.concatenate(got), np.concatenate([*counts, np.array([len(r) for r in got[len(groups) :]], np.int64)]))

    def learn_joined(self, new: list[str]) -> None:
        """Chunks behind a space many at a time, as they stand in a text, others one by one."""
        spaced, alone = [" " + c for c in new if c[0] != "\0"], [c for c in new if c[0] == "\0"]
        sizes = pc.binary_length(pa.array(spaced, pa.string())).to_numpy(zero_copy_only=False)
        groups = [slice(i, i + JOINED) for i in range(0, len(spaced), JOINED)]
        asked, got, counts = ["".join(spaced[g]) for g in groups] + [c[1:] for c in alone], [], []
        for k in range(0, len(asked), TEXTS):
            got += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(asked[k : k + TEXTS], add_special_tokens=False)]
        for k, g in enumerate(groups):
            ends, wanted = np.cumsum(self.measure[got[k]]), np.cumsum(sizes[g], dtype=np.int64)
            at = np.searchsorted(ends, wanted)
            if at[-1] != len(ends) - 1 or not np.array_equal(ends[at], wanted):  # bytes without an id: which chunk lacks them isn't seen in the whole
                each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(spaced[g], add_special_tokens=False)]
                got[k], at = np.concatenate(each), np.cumsum(list(map(len, each))) - 1
            counts.append(np.diff(at, prepend=-1))
        self.chunks.add([c[1:] for c in spaced] + alone, np.concatenate(got), np.concatenate([*counts, np.array([len(r) for r in got[len(groups) :]], np.int64)]))

    def learn(self, new: list[str]) -> None:
        """Chunks from their units: words, marks and single newlines, or the whole chunk if it isn't so plain."""
        if self.spaced:
            return self.learn_joined(new)
        new_texts = [c.lower() if c.isascii() else c for c in new]
        units = [_UNITS.findall(c) if _PLAIN.fullmatch(c) else [c] for c in new_texts]
        counts = np.array(list(map(len, units)), np.int64)
        at = self.units.places([u for own in units for u in own], self.encode)
        flat, lengths = self.units.ids(at)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        self.chunks.add(new, flat, np.diff(ends, prepend=0))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        if self.spaced:
            lists = pc.split_pattern(pc.binary_join_element_wise("\0", plain, ""), " ")
        else:
            lists = pc.ascii_split_whitespace(plain)
        coded = lists.flatten().dictionary_encode()
        strange = [self.cut(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        keys = coded.dictionary.to_pylist()
        at = self.chunks.places(keys + [c for own in strange for c in own], self.learn)
        at = np.concatenate([at[: len(keys)][coded.indices.to_numpy()], at[len(keys) :]])
        ids, lengths = self.chunks.ids(at)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.concatenate([pc.list_value_length(lists).to_numpy(), np.array(list(map(len, strange)), np.int64)])
        ends = sums[np.cumsum(counts, dtype=np.int64)].tolist()
        self.chunks.forget()
        self.units.forget()
        found = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        back = np.empty(len(texts), np.int64)
        back[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(texts))
        return [found[k] for k in back]


@cache
def encoder(file: str) -> Encoder:
    """One for each worker process."""
    return Encoder(file)
