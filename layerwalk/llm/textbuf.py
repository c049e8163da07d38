"""Vectorised text primitives over Arrow string columns: words, hashes and word shingles of whole texts.

All functions see a run of texts as one byte buffer with offsets; a null text counts as empty. Runs are cut by
:func:`runs` to a bounded number of bytes, so memory does not follow the batch size (one text is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: 0x20 and 0x09-0x0D.
SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
RUN_BYTES, RUN_TEXTS = 1 << 20, 4096

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers of a seed."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = numbers(1, 256)[_LOWER]
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, RUN_BYTES + 1), _U(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * RUN_BYTES:
            _powers[base] = have
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_null(texts.type):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most ``most`` bytes and RUN_TEXTS texts, or of one longer text."""
    data, off = buffers(texts)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1), lo + RUN_TEXTS, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every word, a run of bytes that are ``inside``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    start, end = is_word.copy(), is_word.copy()
    start[1:] &= ~is_word[:-1] | cut[1:-1]
    end[:-1] &= ~is_word[1:] | cut[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


#: Byte values of hashes that tell A-Z from a-z.
EXACT = numbers(1, 256)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each span, of bytes with A-Z lower-cased: a polynomial over random byte values, then mixed."""
    run = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * _power(_BASE, len(data)), out=run[1:])
    return mix((run[end] - run[start]) * _power(_INVERSE, len(data) + 1)[start] + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


_PLACE = numbers(2, 64) | _U(1)


def shingles(data: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of ``size`` words; a text of fewer words (but one) gives its whole sequence."""
    start, end, text = words(data, off)
    if not len(start):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = span_hashes(data, start, end)
    per = np.bincount(text, minlength=len(off) - 1)
    n = len(h)
    out = np.zeros(n, _U)
    whole = np.zeros(n, bool)
    if n >= size:
        m = n - size + 1
        for k in range(size):
            out[:m] += h[k : k + m] * _PLACE[k]
        whole[:m] = text[:m] == text[size - 1 :]
    first = np.cumsum(per) - per
    for t in np.flatnonzero((per > 0) & (per < size)):
        f = first[t]
        out[f] = (h[f : f + per[t]] * _PLACE[: per[t]]).sum(dtype=_U) + _U(int(per[t]))
        whole[f] = True
    return mix(out[whole]), text[whole]


def distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text (their upper 52 bits), sorted by text; at most 4096 texts a call."""
    key = np.sort((text.astype(_U) << _U(52)) | (h >> _U(12)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return key & _U((1 << 52) - 1), (key >> _U(52)).astype(np.int64)


def jaccard_parts(a: pa.Array, b: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes of two text columns and of their intersections, row by row, over whole texts."""
    na, nb, both = (np.zeros(len(a), np.int64) for _ in range(3))
    lo = 0
    wa, wb = np.diff(buffers(a)[1]), np.diff(buffers(b)[1])
    total = np.append(0, np.cumsum(wa + wb))
    while lo < len(a):
        hi = min(max(lo + 1, int(np.searchsorted(total, total[lo] + 2 * RUN_BYTES, "right")) - 1), lo + RUN_TEXTS, len(a))
        keys = []
        for col, n in ((a, na), (b, nb)):
            h, t = distinct(*shingles(*buffers(col.slice(lo, hi - lo)), size))
            n[lo:hi] = np.bincount(t, minlength=hi - lo)
            keys.append((t.astype(_U) << _U(52)) | h)
        key = np.sort(np.concatenate(keys))
        same = key[1:][key[1:] == key[:-1]]
        both[lo:hi] = np.bincount((same >> _U(52)).astype(np.int64), minlength=hi - lo)
        lo = hi
    return na, nb, both
