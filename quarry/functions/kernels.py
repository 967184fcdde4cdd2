"""Sequence kernels without Spark: FNV-1a of k-grams, winnowing, common subsequences, maximal matches."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from quarry.functions import FNV_PRIME, FNV_START, MASK

K, WINDOW, CELLS, SEEDS, MATCHES, FRAGMENT = 12, 6, 2_000_000, 500, 50, 40
#: Between the tokens of a k-gram.
SEPARATOR = "\x1f"
#: Bits of a k-gram's place in its sequence.
PLACE = 28


def fnv1a32(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = FNV_START
    for unit in memoryview(text.encode("utf-16-le", "surrogatepass")).cast("H"):
        h = (h ^ unit) * FNV_PRIME & MASK
    return h


def stable_hash(text: str) -> str:
    return f"{fnv1a32(text):08x}"


def kgram_hashes(tokens: list[str], counts: np.ndarray, k: int = K, separator: str = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Of each k tokens in a row of one sequence: the place of the first among all tokens, and the FNV-1a of them joined.

    tokens: those of all sequences in a row; counts: how many each has. All k-grams step through their characters together.
    """
    last = np.repeat(np.cumsum(counts), counts) - k
    first = np.flatnonzero(np.arange(len(tokens)) <= last)
    if not len(first):
        return first, np.empty(0, np.int64)
    units = np.frombuffer(separator.join(tokens).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    sizes, gap = np.fromiter(map(len, tokens), np.int64, len(tokens)), len(separator)
    if int(sizes.sum()) + gap * (len(tokens) - 1) != len(units):  # some characters are two units
        sizes = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in tokens], np.int64)
    starts = np.cumsum(sizes + gap) - sizes - gap
    lengths = starts[first + k - 1] + sizes[first + k - 1] - starts[first]
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[first][order], lengths[order]
    h = np.full(len(first), FNV_START, np.uint64)
    live = np.searchsorted(-left, -np.arange(int(left[0])), side="left")  # how many have a character more
    for step, m in enumerate(live.tolist()):
        h[:m] = (h[:m] ^ units[at[:m] + step]) * np.uint64(FNV_PRIME) & np.uint64(MASK)
    out = np.empty(len(first), np.int64)
    out[order] = h.astype(np.int64)
    return first, out


def winnowed(tokens: list[str], counts: np.ndarray, k: int = K, window: int = WINDOW, separator: str = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, hash, index): the rightmost least hash of each window of k-grams of a sequence, each once; of all its
    k-grams, if there are few. tokens and counts as kgram_hashes takes them."""
    counts = np.asarray(counts, np.int64)
    first, hashes = kgram_hashes(tokens, counts, k, separator)
    own = np.repeat(np.arange(len(counts)), counts)[first]
    index = first - (np.cumsum(counts) - counts)[own]
    keys = (hashes << PLACE) - index  # the later of equal hashes is the lesser key
    grams = np.maximum(counts - k + 1, 0)
    begins = np.cumsum(grams) - grams
    least = sliding_window_view(keys, window).min(axis=1) if len(keys) >= window else keys[:0]
    full = np.arange(len(least))[index[: len(least)] + window <= grams[own[: len(least)]]]
    few = np.flatnonzero((grams > 0) & (grams < window))
    short = np.array([keys[begins[d] : begins[d] + grams[d]].min() for d in few], np.int64)
    docs, picked = np.concatenate([own[full], few]), np.concatenate([least[full], short])
    new = np.ones(len(docs), bool)  # a least key stays for some windows in a row
    new[1:] = (docs[1:] != docs[:-1]) | (picked[1:] != picked[:-1])
    docs, picked = docs[new], picked[new]
    return docs, (picked + (1 << PLACE) - 1) >> PLACE, -picked % (1 << PLACE)


def winnow(tokens: list[str], k: int = K, window: int = WINDOW, separator: str = SEPARATOR) -> list[tuple[int, int]]:
    """(hash, index) of one sequence's fingerprints."""
    _, hashes, places = winnowed(tokens, np.array([len(tokens)]), k, window, separator)
    return list(zip(hashes.tolist(), places.tolist(), strict=True))


def masks(left: list) -> dict:
    """For each token, the bits of its places."""
    out: dict = {}
    for i, x in enumerate(left):
        out[x] = out.get(x, 0) | 1 << i
    return out


def lcs_length(left: list, right: list, known: dict | None = None) -> int:
    """Of the longest common subsequence: bits of a row advance together. known: masks of left, if they are there."""
    if not left or not right:
        return 0
    at = masks(left) if known is None else known
    full = (1 << len(left)) - 1
    row = full
    for x in right:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(left) - row.bit_count()


def dice(left: set, right: set) -> float:
    return 2 * len(left & right) / (len(left) + len(right)) if left or right else 1.0


def sequence_similarity(left: list[str], right: list[str], fallback: float, cells: int | None = CELLS) -> float:
    """Twice the common subsequence by both lengths; the fallback where the table would have over so many cells (None: never)."""
    if not left and not right:
        return 1.0
    if cells is not None and len(left) * len(right) > cells:
        return fallback
    return 2 * lcs_length(left, right) / (len(left) + len(right))


def maximal_matches(left: list[str], right: list[str], seeds: list[tuple[int, int]], k: int = K, least: int = FRAGMENT, most: int | None = SEEDS, matches: int | None = MATCHES) -> list[tuple[int, int, int, int]]:
    """(left start, left end, right start, right end), ends inclusive: seeds grown both ways, the longest that don't overlap.

    most, matches: how many seeds and matches count; None: all.
    """
    found, grown = set(), {}
    for a, b in seeds[:most]:
        before = grown.get(a - b)
        if before and before[0] <= a <= before[1]:  # in a run that is known
            continue
        if left[a : a + k] != right[b : b + k]:
            continue
        begin = 0
        while a - begin > 0 and b - begin > 0 and left[a - begin - 1] == right[b - begin - 1]:
            begin += 1
        end = k
        while a + end < len(left) and b + end < len(right) and left[a + end] == right[b + end]:
            end += 1
        grown[a - b] = a - begin, a + end - 1
        if begin + end >= least:
            found.add((a - begin, a + end - 1, b - begin, b + end - 1))
    chosen: list[tuple[int, int, int, int]] = []
    for m in sorted(found, key=lambda m: (m[0] - m[1], m[0], m[2])):
        if all((m[1] < c[0] or c[1] < m[0]) and (m[3] < c[2] or c[3] < m[2]) for c in chosen):
            chosen.append(m)
            if len(chosen) == matches:
                break
    return chosen


def all_matches(left: np.ndarray, right: np.ndarray, own: tuple, other: tuple, k: int = K, least: int = FRAGMENT) -> list[tuple[int, int, int, int]]:
    """maximal_matches of numbered tokens, of all seeds and without a bound on matches. own, other: (hashes, places) of each side's fingerprints.

    Seeds of one diagonal that touch are of one run, so only the first of them grows; all runs grow together.
    """
    order = np.argsort(other[0], kind="stable")
    hashes, places = other[0][order], other[1][order]
    begin, end = np.searchsorted(hashes, own[0], "left"), np.searchsorted(hashes, own[0], "right")
    n = end - begin
    a = np.repeat(own[1], n).astype(np.int64)
    b = places[np.arange(len(a)) + np.repeat(begin - (np.cumsum(n) - n), n)].astype(np.int64)
    for t in range(k):
        same = left[a + t] == right[b + t]
        a, b = (a, b) if same.all() else (a[same], b[same])
    order = np.lexsort((a, a - b))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (np.diff(a - b) != 0) | (np.diff(a) > k)
    final = np.append(first[1:], True)[: len(a)]
    start, begin, stop, end = a[first], b[first], a[final] + k - 1, b[final] + k - 1
    live = np.arange(len(start))
    while len(live := live[(start[live] > 0) & (begin[live] > 0)]) and len(live := live[left[start[live] - 1] == right[begin[live] - 1]]):
        start[live] -= 1
        begin[live] -= 1
    live = np.arange(len(start))
    while len(live := live[(stop[live] + 1 < len(left)) & (end[live] + 1 < len(right))]) and len(live := live[left[stop[live] + 1] == right[end[live] + 1]]):
        stop[live] += 1
        end[live] += 1
    long = stop - start + 1 >= least
    found = set(zip(*(x[long].tolist() for x in (start, stop, begin, end)), strict=True))
    chosen, one, two = [], bytearray(len(left)), bytearray(len(right))
    for m in sorted(found, key=lambda m: (m[0] - m[1], m[0], m[2])):
        if not (one[m[0]] or one[m[1]] or two[m[2]] or two[m[3]]):  # those before are as long at least: one that overlaps has an end of this
            chosen.append(m)
            one[m[0] : m[1] + 1] = two[m[2] : m[3] + 1] = b"\1" * (m[1] - m[0] + 1)
    return chosen


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed integer intervals, overlapping or touching ones as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out
