"""Words, hashes and shingles of many texts at once, in numpy.

A batch is the bytes of all its texts in a row and the offsets at which they begin. A word is
a run of bytes other than 0x20 and 0x09-0x0D. The hash of a word is a polynomial over the
bytes modulo 2**64 (from prefix sums, so every word costs a difference and a product), mixed
afterwards. Long texts are worked through in parts, so that what is held beside the words is small.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_SHIFTS = mix(np.arange(1, 6, dtype=U)) | U(1)


def _byte_values(fold_case: bool) -> np.ndarray:
    byte = np.arange(256, dtype=U)
    if fold_case:
        byte[65:91] += U(32)
    return mix(byte + U(_BASE))


_FOLDED, _RAW = _byte_values(True), _byte_values(False)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes, or words, that are worked on at once.
PART = 1 << 18


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse from 0 to PART."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(PART + 1, base, U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def runs(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of one kind (by table; kind 0: no run), within texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds[data]
    change = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    at = np.flatnonzero(change)
    inside = kind[at[:-1]] != 0
    return at[:-1][inside], at[1:][inside]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(data, offsets, (~SPACE).astype(np.uint8))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; A-Z count as a-z if fold_case. Spans are in order and apart."""
    values, (up, down) = _FOLDED if fold_case else _RAW, _powers()
    out = np.zeros(len(starts), U)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = int(np.searchsorted(ends, low + PART, side="right"))
        if last == first:  # a span longer than PART
            whole = 0
            for k, at in enumerate(range(low, int(ends[first]), PART)):
                part = values[data[at : min(at + PART, int(ends[first]))]]
                whole += int((part * up[: len(part)]).sum(dtype=U)) * pow(_BASE, k * PART, 1 << 64)
            out[first] = whole % (1 << 64)
            last += 1
        else:
            part = values[data[low : int(ends[last - 1])]]
            total = np.zeros(len(part) + 1, U)
            np.cumsum(part * up[: len(part)], out=total[1:])
            own = starts[first:last] - low
            out[first:last] = (total[ends[first:last] - low] - total[own]) * down[own]
        first = last
    return mix(out + (ends - starts).astype(U))


def counts(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many spans begin in each text."""
    return np.diff(np.searchsorted(starts, offsets))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each text, in order, and the offsets of each text's.

    A text with fewer words, but at least one, has its whole sequence as the only one.
    """
    starts, ends = words(data, offsets)
    word = span_hashes(data, starts, ends)
    per = counts(offsets, starts)
    have = np.where(per >= size, per - size + 1, np.minimum(per, 1))
    out_at = np.concatenate([[0], np.cumsum(have)])
    skipped = np.concatenate([[0], np.cumsum(per)])[:-1] - out_at[:-1]  # words before a text that begin no shingle
    out = np.zeros(out_at[-1], U)
    for low in range(0, len(out), PART):
        place = np.arange(low, min(low + PART, len(out)))
        text = np.searchsorted(out_at, place, side="right") - 1
        begin, length = place + skipped[text], np.minimum(per[text], size)
        some = length.astype(U)
        for k in range(size):
            inside = np.minimum(begin + k, len(word) - 1)
            part = word[inside] * _SHIFTS[k % 5] + U(k)
            part ^= part >> U(29)
            some += np.where(length > k, part, U(0)) * U(_BASE + 2 * k)
        out[low : low + len(place)] = mix(some)
    return out, out_at
