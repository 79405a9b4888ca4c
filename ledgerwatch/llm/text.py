"""Words and word shingles of whole Arrow batches, in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a polynomial over random byte
values, a shingle's hash a polynomial over word hashes; both are 64 bits wide and finalised, so that two different shingles share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MULTIPLIER = np.uint64(0xD1342543DE82EF95)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(0, n - 1), _MULTIPLIER, dtype=np.uint64)), dtype=np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and the offsets of each text; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Bytes that are hashed at a time; what a piece needs is some 60 times its size, whatever a text's length.
PIECE = 1 << 18


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of each text's words. Texts are hashed by pieces; a word that a piece's end cuts goes on in the next."""
    sums, lengths, places, open_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for low in range(0, len(data), PIECE):
        part = data[low : low + PIECE]
        inside = ~_SPACE[part]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        firsts = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, low + len(part))] - low
        start[firsts] = inside[firsts]  # a text's first byte starts a word whatever came before
        at = np.flatnonzero(inside)
        if not len(at):
            open_ = 0
            continue
        starts = np.flatnonzero(start[at])
        n = np.diff(np.append(starts, len(at)))
        factors = powers(int(n.max()))[np.arange(len(at)) - np.repeat(starts, n)]
        goes_on = open_ > 0 and bool(inside[0]) and not (len(firsts) and firsts[0] == 0)
        if goes_on:
            factors[: n[0]] *= np.uint64(pow(int(_MULTIPLIER), open_, 1 << 64))
        sum_, place = np.add.reduceat(_BYTES[part[at]] * factors, starts), at[starts] + low
        if goes_on:
            with np.errstate(over="ignore"):
                sums[-1][-1] += sum_[0]
            lengths[-1][-1] += n[0]
            open_ += int(n[0])
        if len(n) > goes_on:
            sums.append(sum_[int(goes_on) :])
            lengths.append(n[int(goes_on) :])
            places.append(place[int(goes_on) :])
            open_ = int(n[-1])
        if not inside[-1]:
            open_ = 0
    hashes = mix(np.concatenate(sums) + np.concatenate(lengths).astype(np.uint64) * _GOLDEN)
    return hashes, np.searchsorted(np.concatenate(places), offsets)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order; a text of fewer words has the whole sequence as its one shingle."""
    hashes, ends = word_hashes(*text_bytes(texts))
    n = max(0, len(hashes) - size + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        rolled = rolled * _MULTIPLIER + hashes[k : k + n]
    rolled = mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * _MULTIPLIER + h
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit name of a set of hashes, signed."""
    with np.errstate(over="ignore"):
        x = mix(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes)) * _GOLDEN
    return int(mix(np.array([x], dtype=np.uint64)).view(np.int64)[0])
