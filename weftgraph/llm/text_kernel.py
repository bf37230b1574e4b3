"""Words, shingles and their 64-bit hashes for whole Arrow batches of texts.

Everything works on the UTF-8 buffer of the batch: one prefix sum of a polynomial
rolling hash gives the hash of any word as a difference, so there is no Python object
per word. Buffers are walked in blocks, so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Arrow's own pool keeps what it has freed; a worker that runs one operator after another would hold the sum of their peaks.
pa.set_memory_pool(pa.system_memory_pool())

BLOCK = 1 << 20
CHUNK_BYTES = 4 << 20
_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_LANES = np.random.default_rng(20240229).integers(1, 1 << 62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits separates; bytes of longer characters belong to words.
NOT_ALNUM = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
#: Only letters (and longer characters) make words.
NOT_LETTER = np.array([not (chr(b).isalpha() or b >= 128) for b in range(256)])

_byte_hash = np.random.default_rng(7).integers(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_byte_hash[65:91] = _byte_hash[97:123]  # A-Z count as a-z


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK + 4096)
        _powers[:] = []
        for base in (_P, _PINV):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers.append(np.multiply.accumulate(a))
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of several texts; those of text i are [ptr[i], ptr[i+1])."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (or one text): first row, end row, bytes, offsets. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITESPACE) -> Words:
    """Maximal runs of non-separator bytes within each text, hashed with A-Z as a-z."""
    n, found = len(buf), []
    inner = offsets[(offsets > 0) & (offsets < n)]
    lo = 0
    while lo < n:
        hi = min(n, lo + BLOCK)
        if hi < n:  # end a block at a separator or at the end of a text
            seps = np.flatnonzero(separators[buf[lo:hi]])
            cut = lo + int(seps[-1]) + 1 if len(seps) else 0
            k = int(np.searchsorted(inner, hi, "right")) - 1
            cut = max(cut, int(inner[k]) if k >= 0 else 0)
            while cut <= lo and hi < n:
                more = np.flatnonzero(separators[buf[hi : hi + BLOCK]])
                k = int(np.searchsorted(inner, hi, "right"))
                cut = min(hi + int(more[0]) + 1 if len(more) else n + 1, int(inner[k]) if k < len(inner) else n + 1)
                if cut > n:
                    hi = min(n, hi + BLOCK)
                    cut = n if hi == n else 0
            hi = max(cut, lo + 1)
        part = buf[lo:hi]
        is_word = ~separators[part]
        begin, finish = is_word.copy(), is_word.copy()
        begin[1:] &= ~is_word[:-1]
        finish[:-1] &= ~is_word[1:]
        b = inner[np.searchsorted(inner, lo) : np.searchsorted(inner, hi)] - lo
        begin[b] = is_word[b]
        b = b[b > 0]
        finish[b - 1] = is_word[b - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        power, inverse = _pow(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_byte_hash[part] * power[: len(part)], out=sums[1:])
        found.append(((sums[e] - sums[s]) * inverse[s], s + lo, e + lo))
        lo = hi
    if found:
        h, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        h, s, e = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Words(mix(h + (e - s).astype(np.uint64) * np.uint64(_P)), s, e, np.searchsorted(s, offsets))


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), A-Z as a-z; ranges are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        power, inverse = _pow(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_byte_hash[buf[lo:hi]] * power[: hi - lo], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_P))
        i = j
    return out


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, in order, and where each text's begin. A text with
    fewer words has its whole sequence as one shingle; a text without words has none."""
    n, counts = len(w.hash), np.diff(w.ptr)
    acc = np.zeros(n, np.uint64)
    ok = np.zeros(n + 1, np.int64)
    short = []
    for j in range(size):
        if j:  # the texts of j words, complete by now
            at = w.ptr[:-1][counts == j]
            short.append((at, mix(acc[at] + _LANES[40 + j % 20])))
        acc[: max(n - j, 0)] += w.hash[j:] * _LANES[j]
    acc = mix(acc)
    for at, h in short:
        acc[at] = h
    rows = counts >= size
    np.add.at(ok, w.ptr[:-1][rows], 1)
    np.add.at(ok, w.ptr[1:][rows] - size + 1, -1)
    keep = np.cumsum(ok)[:n] > 0
    keep[w.ptr[:-1][(counts > 0) & ~rows]] = True
    return acc[keep], np.concatenate([[0], np.cumsum(keep)])[w.ptr]
