"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, their hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time (a longer text is taken alone).
SLICE_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
#: An odd multiplier and the values of bytes; A-Z share those of a-z.
_P = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of a base; tables longer than eight slices are not kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, SLICE_BYTES + 1), np.uint64)
        out[0] = 1
        out[1:] = _U(base)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        if len(have) <= 8 * SLICE_BYTES:
            _powers[base] = have
    return have


def slices(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) in pieces of about SLICE_BYTES; nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if pa.types.is_string(text.type):
        text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more entry than rows)."""
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off[:-1]] = True
    first = first[:-1]
    before = np.empty_like(word)
    if len(word):
        before[0] = False
        before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | first))
    after = np.zeros(len(data) + 1, bool)
    after[off[1:]] = True
    last = np.ones(len(word), bool)
    if len(word):
        last[:-1] = ~word[1:] | first[1:]
    end = np.flatnonzero(word & last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(_P, n + 1)[:n], out=total[1:])
        back = _power(pow(_P, -1, 1 << 64), n + 1)
        return mix64((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each row, and the index of each row's first; rows with fewer words have one of all."""
    n = np.diff(first)
    with np.errstate(over="ignore"):
        k = max(len(h) - size + 1, 0)
        s = np.zeros(k, np.uint64)
        for i in range(size):
            s = mix64(s * _U(0x2545F4914F6CDD1D) + h[i : i + k] + _U(i + 1))
        count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
        out = np.empty(int(count.sum()), np.uint64)
        at = np.concatenate([[0], np.cumsum(count)])
        full = n >= size
        if full.any():
            c, f = count[full], first[:-1][full]
            step = np.arange(int(c.sum())) - np.repeat(np.concatenate([[0], np.cumsum(c)[:-1]]), c)
            out[np.repeat(at[:-1][full], c) + step] = s[np.repeat(f, c) + step]
        for r in np.flatnonzero((n > 0) & ~full):
            x = _U(n[r])
            for w in h[first[r] : first[r + 1]]:
                x = mix64(np.array([x * _U(0x2545F4914F6CDD1D) + w], np.uint64))[0]
            out[at[r]] = x ^ _U(0x5BD1E9955BD1E995)
    return out, at
