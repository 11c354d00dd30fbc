"""Words and word shingles of whole Arrow text columns, computed on the UTF-8 bytes with numpy.

A word's hash is a polynomial over 64-bit byte codes, taken from one prefix sum, so that no Python object
is made per word. Work goes on in chunks of about CHUNK bytes; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 5)  # odd, so that it has an inverse modulo 2^64
_PINV = _U(pow(int(_P), -1, 1 << 64))
_Q = [_U(int(x) | 1) for x in np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64)]
_CODES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        out = []
        for p in (_P, _PINV):
            x = np.full(size, p, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (one to one)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Alphabet:
    """Which bytes are parts of words, and the byte that each stands for (A-Z in lower case)."""

    def __init__(self, separators: bytes):
        self.word = np.ones(256, dtype=bool)
        self.word[list(separators)] = False
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.lower = lower
        self.codes = _CODES[lower]


#: Words between white space: [^\x20\x09-\x0D]+
SPACED = Alphabet(b" \t\n\x0b\x0c\r")
#: Words of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are in lower case
LETTERS = Alphabet(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null texts are empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=len(column) + 1, offset=column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes together, or one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of a run of texts: byte places in the chunk, hashes; words of text d are first[d]:first[d+1]."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    low: int


def words(data: np.ndarray, offsets: np.ndarray, i: int, j: int, alphabet: Alphabet) -> Words:
    low, high = int(offsets[i]), int(offsets[j])
    part, bounds = data[low:high], offsets[i : j + 1] - low
    n = len(part)
    is_word = alphabet.word[part]
    edge = bounds[:-1][bounds[:-1] < n]
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    before[edge] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    after[edge[edge > 0] - 1] = False
    end = np.flatnonzero(is_word & ~after) + 1
    power, inverse = _tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(alphabet.codes[part] * power[:n], out=total[1:])
    return Words(start, end, (total[end] - total[start]) * inverse[start], np.searchsorted(start, bounds), low)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, and bounds of each text's runs. A text of fewer words, but not
    none, has one: the whole sequence."""
    counts = np.diff(w.first)
    n = len(w.hash)
    if n >= k:
        h = np.zeros(n - k + 1, dtype=np.uint64)
        for q in range(k):
            h += w.hash[q : n - k + 1 + q] * _Q[q]
        h = mix(h)
    else:
        h = np.zeros(0, dtype=np.uint64)
    whole = counts >= k
    sizes = np.where(whole, counts - k + 1, (counts > 0).astype(counts.dtype))
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    if whole.all():
        keep = np.repeat(w.first[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
        return h[keep], bounds
    out = np.empty(bounds[-1], dtype=np.uint64)
    at = np.repeat(w.first[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    long = np.repeat(whole, sizes)
    out[long] = h[at[long]]
    for d in np.flatnonzero(~whole & (counts > 0)):
        x = w.hash[w.first[d] : w.first[d + 1]]
        total = _U(len(x))
        for q, y in enumerate(x):
            with np.errstate(over="ignore"):
                total = total + y * _Q[q + 8]
        out[bounds[d]] = mix(np.array([total], dtype=np.uint64))[0]
    return out, bounds


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
