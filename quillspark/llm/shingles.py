"""Hashed word shingles of Arrow text columns, computed with numpy over the raw UTF-8 bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D, ASCII capitals lowered. A word is hashed eight bytes
at a time, each block mixed into the state before the next; a word longer than LONG bytes by BLAKE2b. No
step is linear in the bytes, so words that are built alike (repetitions, complements) do not collide more
often than others: two different words, or shingles of words, agree with a probability near 2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes hashed in one go; a block ends at a separator.
BLOCK = 1 << 20
#: Longer words are hashed one by one.
LONG = 64
WIDTH = 5

_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_PLACES = [np.uint64(_mixed(77 + i) | 1) for i in range(64)]
#: The low n bytes of a block.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def windows(data: np.ndarray) -> np.ndarray:
    """For each place of data the eight bytes from there on as one little-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def blocks_of(view: np.ndarray, begins: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of words that have more than 8 * k bytes; bytes beyond a word's end are zero."""
    return view[begins + 8 * k] & _BYTES[np.minimum(sizes - 8 * k, 8)]


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(begins), np.uint64)
    lo = 0
    while lo < len(begins):
        base = begins[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        part = _LOWER[data[base : ends[hi - 1]]]
        view, b = windows(part), begins[lo:hi] - base
        size = ends[lo:hi] - begins[lo:hi]
        state = mix(size.astype(np.uint64))
        state = mix(state ^ blocks_of(view, b, size, 0))
        here = np.flatnonzero((size > 8) & (size <= LONG))
        k = 1
        while len(here):
            state[here] = mix(state[here] ^ blocks_of(view, b[here], size[here], k))
            k += 1
            here = here[size[here] > 8 * k]
        for i in np.flatnonzero(size > LONG).tolist():
            state[i] = int.from_bytes(hashlib.blake2b(part[b[i] : b[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
        out[lo:hi] = state
        lo = hi
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the offsets of each; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of all texts begins and ends; no word goes from one text into the next."""
    inside = ~_SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    left = np.concatenate([[False], inside[:-1]])
    right = np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~left | first[:-1])), np.flatnonzero(inside & (~right | first[1:])) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words begin (length n + 1)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begins, ends = word_bounds(data, offsets)
    return word_hashes(data, begins, ends), np.searchsorted(begins, offsets).astype(np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, rising, and offsets; fewer words than `width` make one shingle of them all."""
    own, at = words(data, offsets)
    counts = np.diff(at)
    runs = np.zeros(max(0, len(own) - width + 1), np.uint64)
    for i in range(width if len(runs) else 0):
        runs ^= own[i : len(runs) + i] * _PLACES[i]
    runs = mix(runs)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts.tolist()):
        if n >= width:
            got = np.sort(runs[at[i] : at[i] + n - width + 1])
            if len(got) > 1:
                got = got[np.concatenate([[True], got[1:] != got[:-1]])]
        elif n:
            code = _mixed(n)
            for k, w in enumerate(own[at[i] : at[i] + n].tolist()):
                code ^= w * int(_PLACES[k]) & _MASK
            got = mix(np.array([code], np.uint64))
        else:
            continue
        sets.append(got)
        sizes[i] = len(got)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def set_digests(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, as signed values; sums do not depend on the order."""
    a = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    b = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ np.uint64(0x14057B7EF767814F)), dtype=np.uint64)])
    return (a[offsets[1:]] - a[offsets[:-1]]).view(np.int64), (b[offsets[1:]] - b[offsets[:-1]]).view(np.int64)
