"""Vectorised work on UTF-8 text columns: byte views, range hashes, words, lines.

Every function takes the bytes of several texts in one array and their offsets,
so that numpy works on a megabyte at a time and never on one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that numpy works on at a time (one longer text is one slice).
SLICE_BYTES = 1 << 19

U64 = np.uint64
#: Range hashes are two polynomials over the prime field of 2**31 - 1, whose bases and byte values are drawn at random.
_P = (1 << 31) - 1
_rng = np.random.default_rng(20240229)
_TABLES = _rng.integers(1, _P, (2, 256), dtype=np.int64).astype(U64)
_BASES = tuple(_rng.integers(1 << 20, _P, 2, dtype=np.int64).tolist())
_LENGTH_FACTOR = 0xA24BAED4963EE407
_powers: dict[int, np.ndarray] = {}

#: True for the bytes 0x20 and 0x09-0x0D, which separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, every row in exactly one."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _folded(x: np.ndarray) -> np.ndarray:
    """Values congruent modulo 2**31 - 1, under 2**31 + 4 for any below 2**64."""
    x = (x & U64(_P)) + (x >> U64(31))
    return (x & U64(_P)) + (x >> U64(31))


def _residue(x: np.ndarray) -> np.ndarray:
    x = _folded(x)
    x = (x & U64(_P)) + (x >> U64(31))
    return np.where(x == U64(_P), U64(0), x)


def _power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**31 - 1 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(1, U64)
        while len(out) < n:
            out = np.concatenate([out, _residue(out * U64(pow(base, len(out), _P)))])
        _powers[base] = have = out
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class RangeHash:
    """Hashes of any byte ranges of ``data`` after one pass over it: two residues of 31 bits, mixed with the length.

    The field is prime, so no family of strings collides whatever the base, as alternating
    patterns do modulo a power of two.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums, self.back = [], []
        for table, base in zip(_TABLES, _BASES, strict=True):
            sums = np.zeros(n + 1, U64)
            np.cumsum(_folded(table[data] * _power(base, n)[:n]), out=sums[1:])  # under 2**64 for 2**32 bytes
            self.sums.append(sums)
            self.back.append(_power(pow(base, -1, _P), n + 1))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (_residue(_residue(s[end] - s[start]) * k[start]) for s, k in zip(self.sums, self.back, strict=True))
        return mix((a << U64(31) | b) + (end - start).astype(U64) * U64(_LENGTH_FACTOR))

    def fixed(self, k: int) -> np.ndarray:
        """Hashes of the k bytes from each position that has k bytes."""
        m = len(self.sums[0]) - k
        if m <= 0:
            return np.zeros(0, U64)
        a, b = (_residue(_residue(s[k:] - s[:m]) * f[:m]) for s, f in zip(self.sums, self.back, strict=True))
        return mix((a << U64(31) | b) + U64(k * _LENGTH_FACTOR % 2**64))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's first word (with a last bound)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~IS_SPACE[data]
    edge = offs[(offs > 0) & (offs < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def shingle_hashes(word: np.ndarray, n: int = 3) -> np.ndarray:
    """Hashes of each n words in a row, from the words' hashes."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for i in range(n):
        out = out * U64(0x9E3779B97F4A7C15 | 1) + mix(word[i : i + m] + U64(i + 1))
    return mix(out)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... count[i] values each, one after the other."""
    count = np.asarray(count, np.int64)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = count > 0
    s, c = np.asarray(start, np.int64)[keep], count[keep]
    heads = np.cumsum(c)[:-1]
    out[0] = s[0]
    out[heads] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
