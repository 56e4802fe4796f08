"""Vectorised word splitting and hashing over Arrow text columns (no Spark here).

Words are maximal runs of bytes of a class in the UTF-8 text, A-Z lower-cased. A word's hash takes in eight bytes at a
time, each time mixed by a permutation of the 64 bits; words of more than ``LONG`` bytes are hashed by BLAKE2. Sequences
of words are hashed from the words' hashes and their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
#: Texts handled at once.
ROWS = 4096


def _lut(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: ``[^\x20\x09-\x0D]``
SPACED = _lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing, hence A-Z too.
ALNUM = _lut(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output's."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _lower(b: int) -> int:
    return b + 32 if 0x41 <= b <= 0x5A else b


#: Longest word that is hashed eight bytes at a time.
LONG = 64
_LOWER = np.array([_lower(b) for b in range(256)], dtype=np.uint8)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)

with np.errstate(over="ignore"):
    _STEP = mix((np.arange(64, dtype=U) + U(77)) * U(0x9E3779B97F4A7C15)) | U(1)


def padded(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """A copy of buf that eights() can read up to its end."""
    out = np.zeros(len(buf) + 8, np.uint8)
    out[: len(buf)] = _LOWER[buf] if lower else buf
    return out


def eights(pad: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; bytes beyond the number left count as 0."""
    every = np.lib.stride_tricks.sliding_window_view(pad, 8)
    return every[at].view("<u8")[:, 0] & _MASK[np.minimum(left, 8)]


def hashes(pad: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes."""
    size = end - start
    with np.errstate(over="ignore"):
        out = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019))
        live, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
        while len(live):
            out[live] = mix((out[live] ^ eights(pad, start[live] + k, size[live] - k)) * U(0xD6E8FEB86659FD93))
            k += 8
            live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(pad[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def equal_ranges(a: np.ndarray, at: np.ndarray, b: np.ndarray, of: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which ranges of two padded buffers, of the same sizes, hold the same bytes."""
    same, live, k = np.ones(len(size), dtype=bool), np.flatnonzero(size > 0), 0
    while len(live):
        ok = eights(a, at[live] + k, size[live] - k) == eights(b, of[live] + k, size[live] - k)
        same[live[~ok]] = False
        k += 8
        live = live[ok]
        live = live[size[live] > k]
    return same


class Words:
    """Words of some texts: ``start``, ``end`` (byte offsets into ``buf``), ``hash``; ``first[d]:first[d+1]`` are those of text d."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.buf, n = buf, len(buf)
        mask = is_word[buf]
        begins, ends = mask.copy(), mask.copy()
        begins[1:] &= ~mask[:-1]
        ends[:-1] &= ~mask[1:]
        if len(offsets) > 2:
            at = offsets[1:-1]
            at = at[(at > 0) & (at < n)]
            begins[at] |= mask[at]
            ends[at - 1] |= mask[at - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        #: the texts in lower case, for eights()
        self.pad = padded(buf, lower=True)
        self.hash = hashes(self.pad, self.start, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that cross a text's end are to be left out, see whole()."""
        return grams(self.hash, n)

    def whole(self, n: int) -> np.ndarray:
        """Which starts have n words left in their text."""
        left = np.repeat(self.first[1:], self.count) - np.arange(len(self.start))
        return (left >= n)[: max(0, len(self.start) - n + 1)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    with np.errstate(over="ignore"):
        g = np.full(m, U(n) * U(0xD1B54A32D192ED03), dtype=U)
        for j in range(n):
            g += h[j : j + m] * _STEP[j % 64]
            if j % 64 == 63:
                g = mix(g)
        return mix(g)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text: (hashes, first) with hashes ascending in ``first[d]:first[d+1]``.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    ok = w.whole(n)
    g, d = w.grams(n)[ok], w.doc()[: len(ok)][ok]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        g = np.concatenate([g, [grams(w.hash[w.first[i] : w.first[i + 1]], w.count[i])[0] for i in short]]).astype(U)
        d = np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    if len(g):
        keep = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
        g, d = g[keep], d[keep]
    return g, np.searchsorted(d, np.arange(len(w.count) + 1))


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a text column into runs of about CHUNK bytes: (row of the first, bytes, offsets). Null is empty."""
    if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
        kind = np.int32
    else:
        kind = np.int64
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    off = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(at + ROWS, max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1))
        yield at, buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to
