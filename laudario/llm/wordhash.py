"""Words of many texts at once, as 64-bit hashes, by array operations over the bytes of a batch."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.default_rng(20_011)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_TURN = np.uint64(0x9E3779B97F4A7C15)

_WORD, _OTHER, _SKIP = 1, 0, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = _WORD
_CLASS[128:] = _WORD
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _classes(b: np.ndarray) -> np.ndarray:
    """What each byte of NFKD text is: part of a word, between words, or nothing at all."""
    kind = _CLASS[b]
    n = len(b)

    def mark(at: np.ndarray, width: int, what: int) -> None:
        for k in range(width):
            kind[np.minimum(at + k, n - 1)] = what

    if not (b >= 0x80).any():
        return kind
    second = np.append(b[1:], 0)
    third = np.append(b[2:], [0, 0]) if n > 1 else np.zeros(n, np.uint8)
    mark(np.flatnonzero(b == 0xC2), 2, _OTHER)  # signs of Latin-1; its letters and digits have decomposed
    mark(np.flatnonzero((b == 0xC2) & (second == 0xAD)), 2, _SKIP)
    mark(np.flatnonzero((b == 0xCC) | ((b == 0xCD) & (second < 0xB0))), 2, _SKIP)  # combining marks
    mark(np.flatnonzero(b == 0xE2), 3, _OTHER)  # punctuation, mathematical and other signs
    mark(np.flatnonzero((b == 0xE2) & (((second == 0x80) & (third >= 0x8B) & (third <= 0x8F)) | ((second == 0x81) & (third == 0xA0)))), 3, _SKIP)
    mark(np.flatnonzero((b == 0xE3) & (second == 0x80)), 3, _OTHER)
    mark(np.flatnonzero((b == 0xEF) & (second == 0xBF)), 3, _OTHER)
    mark(np.flatnonzero(b >= 0xF0), 4, _OTHER)  # pictures and rare scripts
    mark(np.flatnonzero((b == 0xEF) & (second == 0xBB) & (third == 0xBF)), 3, _SKIP)
    return kind


# Letters of Latin-1 that decompose, by the second byte of their UTF-8 form.
_LATIN = np.zeros(256, np.uint8)
for _i in range(0x80, 0xC0):
    _c = unicodedata.normalize("NFKD", chr(_i + 0x40))
    if len(_c) > 1:
        _LATIN[_i] = ord(_c[0])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    b = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return b, bounds - bounds[0]


def _decomposed(texts: pa.Array) -> pa.Array:
    """NFKD of the texts that hold anything beyond ASCII and Latin-1 letters; those letters are left for later."""
    b, bounds = _bytes(texts)
    strange = np.concatenate([[0], np.cumsum((b == 0xC2) | (b >= 0xC4))])
    mask = strange[bounds[1:]] > strange[bounds[:-1]]
    if not mask.any():
        return texts
    mask = pa.array(mask)
    out = pc.replace_with_mask(texts, mask, pc.utf8_normalize(texts.filter(mask), "NFKD"))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, place of the first word of each text and of the end).

    Words are in lower case and without accents, numbers without the separators between their digits,
    as some layouts lose them; layout and punctuation vanish. NULL texts have no words.
    """
    plain = _decomposed(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    b, bounds = _bytes(plain)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(plain) + 1, np.int64)
    accented = np.flatnonzero(b == 0xC3)
    b = b.copy()
    base = _LATIN[b[accented + 1]]
    b[accented + 1] = np.where(base, base, b[accented + 1])
    kind = _classes(b)
    kind[accented[base > 0]] = _SKIP
    if len(b) > 2:
        point = ((b == 46) | (b == 44))[1:-1] & _DIGIT[b[:-2]] & _DIGIT[b[2:]]
        kind[np.flatnonzero(point) + 1] = _SKIP
    first = np.zeros(len(b) + 1, bool)
    first[bounds[:-1]] = True
    keep = kind != _SKIP
    if not keep.all():
        moved = np.concatenate([[0], np.cumsum(keep)])
        bounds = moved[bounds]
        b, kind = b[keep], kind[keep]
        first = np.zeros(len(b) + 1, bool)
        first[bounds[:-1]] = True
    inside = kind == _WORD
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | first[: len(b)]))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(plain) + 1, np.int64)
    at = np.flatnonzero(inside)
    owner = np.cumsum((inside & (~before | first[: len(b)]))[at], dtype=np.int32) - 1
    place = at - start[owner]
    with np.errstate(over="ignore"):
        value = _BYTE[b[at]]
        turn = _PLACE[place & 63]
        if place.max() > 63:
            turn += (place >> 6).astype(np.uint64) * _TURN
        value *= turn
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        hashes = np.add.reduceat(value, cut)
        hashes ^= hashes >> np.uint64(29)
        hashes *= _TURN
    return hashes, np.searchsorted(start, bounds)
