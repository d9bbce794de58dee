"""Removal of repeated substrings, by refining buckets of anchored positions.

Every window of ``length`` bytes is anchored at the least ``gram``-byte hash in
it, a place that depends on its bytes alone: equal windows have equal anchors at
equal distances.  So positions need not be sorted one by one.  Anchors are put in
buckets by their gram:

1. a bucket of one anchor is unique: no window with that anchor repeats;
2. a bucket whose anchors agree in the whole span that windows can reach is done:
   all its windows repeat;
3. in the others every window is identified by the pair of its grams' hashes, at its
   start and ``length - gram`` bytes later, and one sort by these tells windows
   apart.  Refining bucket pointers round by round in place of that sort gave the
   same bytes at three to four times the time, beyond what the operator may take.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = np.ones((2, 1), np.uint64)


def numbers(data: np.ndarray) -> np.ndarray:
    """Symbols as 64-bit numbers: bytes by a table, words as they are."""
    return _BYTE[data] if data.dtype == np.uint8 else data


def _power_tables(n: int) -> np.ndarray:
    """Powers of the base and of its inverse (mod 2^64), grown as needed."""
    global _powers
    if _powers.shape[1] < n:
        size = 1 << (n - 1).bit_length()
        table = np.empty((2, size), np.uint64)
        for row, base in enumerate((_BASE, _INVERSE)):
            table[row] = base
            table[row, 0] = 1
            np.multiply.accumulate(table[row], out=table[row])
        _powers = table
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the low bits of hashes over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any slices of a sequence of 64-bit symbols: a polynomial, shifted to a common origin."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.powers = _power_tables(len(symbols) + 1)
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.powers[0, : len(symbols)], out=self.prefix[1:])

    def windows(self, size: int) -> np.ndarray:
        """The hash of each window of ``size`` bytes."""
        n = len(self.prefix) - size
        return mix((self.prefix[size:] - self.prefix[:n]) * self.powers[1, :n])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each slice."""
        return mix((self.prefix[end] - self.prefix[start]) * self.powers[1, start])


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text (bytes) start and end: runs without ASCII white space."""
    inner = np.zeros(len(data) + 2, np.int8)
    inner[1:-1] = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edges = np.diff(inner)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def words(data: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """The words of a text (bytes) as 64-bit numbers, in blocks of words so that memory is bounded."""
    starts, ends = word_places(data)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + block, side="right")))
        low = starts[first]
        rolling = Rolling(_BYTE[data[low : ends[last - 1]]])
        out[first:last] = rolling.slices(starts[first:last] - low, ends[first:last] - low)
        first = last
    return out


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    width, out = 1, values
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < size:
        rest = size - width
        out = np.minimum(out[:-rest], out[rest:])
    return out


def anchors(hashes: np.ndarray, windows: int, reach: int) -> np.ndarray:
    """The distinct anchors of windows 0 to ``windows`` - 1: leftmost least hash of ``reach`` grams."""
    places = np.uint64((1 << max(len(hashes) - 1, 1).bit_length()) - 1)
    keys = (hashes & ~places) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(keys, reach)[:windows]
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return np.unique((least[first] & places).astype(np.int64))


def text_anchors(data: np.ndarray, length: int, gram: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, bucket, span) of a text's anchors, in blocks of windows so that memory is bounded."""
    n, reach = len(data), length - gram + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, n - length + 1, block):
        windows = min(block, n - length + 1 - first)
        low = max(first - reach + 1, 0)
        rolling = Rolling(numbers(data[low : first + windows + 2 * length]))
        hashes = rolling.windows(gram)[first - low :][: windows + reach - 1]
        at = anchors(hashes, windows, reach) + first
        start, end = np.maximum(at - (length - gram), 0), np.minimum(at + length, n)
        span = rolling.slices(start - low, end - low)
        span ^= mix(((at - start) * (length + 1) + (end - at)).astype(np.uint64))
        found.append((at, hashes[at - first], span))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    position, bucket, span = (np.concatenate(x) for x in zip(*found, strict=True))
    position, own = np.unique(position, return_index=True)  # an anchor may serve windows of two blocks
    return position, bucket[own], span[own]


def repeated_windows(
    bucket: np.ndarray, left: np.ndarray, contexts: list[bytes], copies: np.ndarray, length: int, gram: int, symbol: type = np.uint8,
    owner: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts of anchors: which windows exist, which repeat in these rows, and the identifiers.

    Column l of each matrix is the window that begins l bytes before the anchor.
    A window's identifier is the pair of its grams' buckets, at its start and
    ``length - gram`` bytes later: grams are identified once and reused for every
    window that holds them.  With ``owner`` a window repeats if contexts of two owners
    have it, or one with ``copies``.
    """
    reach = length - gram
    right = np.array([len(c) for c in contexts]) // np.dtype(symbol).itemsize - left
    pair = np.empty((len(contexts), reach + 1), np.uint64)
    for first in range(0, len(contexts), 1024):  # hashes of a few contexts at a time bound the memory
        some = slice(first, first + 1024)
        pair[some] = _window_ids(contexts[some], left[some].tolist(), length, gram, symbol)
    ids = mix(pair ^ mix(bucket)[:, None]) + np.arange(reach + 1, dtype=np.uint64) * _BASE
    back = np.arange(reach + 1)
    exists = (back <= left[:, None]) & (length - back <= right[:, None])
    where = np.flatnonzero(exists)
    order = where[np.argsort(ids.ravel()[where], kind="stable")]
    ordered = ids.ravel()[order]
    if owner is not None and len(order):
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        row = order // (reach + 1)
        low, high = (f.reduceat(owner[row], first) for f in (np.minimum, np.maximum))
        shared = np.repeat((low != high) | np.maximum.reduceat(copies[row] > 1, first), np.diff(np.append(first, len(order))))
        repeats = np.zeros(exists.size, bool)
        repeats[order[shared]] = True
        return exists, repeats.reshape(exists.shape), pair
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    repeats = np.zeros(exists.size, bool)
    repeats[order[same]] = True
    repeats[order[same + 1]] = True
    repeats = repeats.reshape(exists.shape) | (exists & (copies > 1)[:, None])
    return exists, repeats, pair


def _window_ids(contexts: list[bytes], left: list[int], length: int, gram: int, symbol: type) -> np.ndarray:
    """Identifiers of the windows that begin 0, 1, 2, ... bytes before the anchor."""
    reach = length - gram
    table = np.zeros((len(contexts), reach + length), symbol)
    for row, (context, before) in enumerate(zip(contexts, left, strict=True)):
        own = np.frombuffer(context, symbol)
        table[row, reach - before : reach - before + len(own)] = own
    powers = _power_tables(reach + length + 1)
    prefix = np.zeros((len(contexts), reach + length + 1), np.uint64)
    np.cumsum(numbers(table) * powers[0, : reach + length], axis=1, out=prefix[:, 1:])
    grams = mix((prefix[:, gram:] - prefix[:, :-gram]) * powers[1, : reach + length + 1 - gram])
    starts = reach - np.arange(reach + 1)
    return mix(grams[:, starts] * np.uint64(3) + grams[:, starts + length - gram])


def cover(intervals: np.ndarray, n: int) -> np.ndarray:
    """Disjoint maximal runs of the union of (start, end) intervals within 0 to n."""
    if not len(intervals):
        return np.empty((0, 2), np.int64)
    intervals = np.clip(intervals[np.argsort(intervals[:, 0], kind="stable")], 0, n)
    reached = np.maximum.accumulate(intervals[:, 1])
    opens = np.concatenate(([True], intervals[1:, 0] > reached[:-1]))
    first = np.flatnonzero(opens)
    return np.stack([intervals[first, 0], reached[np.append(first[1:], len(intervals)) - 1]], axis=1)
