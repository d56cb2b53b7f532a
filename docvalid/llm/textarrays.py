"""Words and shingles of whole texts as numpy arrays, straight from Arrow's string buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D.  UTF-8 never
uses those bytes inside a character, so bytes suffice.  A word's hash is the sum
of random 64-bit values by byte and position; a shingle's combines the hashes of
its words.  Both are 64 bits wide: two different shingles of a corpus of 10^9
distinct ones agree with a chance of about 3 %, and then one set counts one
element less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are held as arrays at a time; a longer text is one piece of its own.
PIECE_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(1, 2**63, 64, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 places where its texts begin; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    if len(texts) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(places, kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie end to end, and each word's text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = _IN_WORD[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    begins = at[:-1][at[:-1] < at[-1]]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[begins[begins > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the spans [start, end), none empty, lower-cased in A-Z if so asked."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    taken = data[place + np.repeat(starts, lengths)]
    values = _BYTE[_LOWER[taken] if lower else taken]
    longest = int(lengths.max())
    if longest <= len(_PLACE):
        values *= _PLACE[place]
    else:  # a longer word's places get values from their number
        values *= _PLACE[place % len(_PLACE)] + mix((place // len(_PLACE)).astype(np.uint64)) * np.uint64(2)
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; with fewer words, the whole sequence as one."""
    data, at = string_buffers(texts)
    for first, last in pieces(at):
        low, high = at[first], at[last]
        here = at[first : last + 1] - low
        part = data[low:high]
        starts, ends, of = words(part, here)
        hashes = word_hashes(part, starts, ends)
        counts = np.bincount(of, minlength=last - first)
        begins = np.concatenate([[0], np.cumsum(counts)])
        windows = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for j in range(size):
            windows += hashes[j : j + len(windows)] * _PLACE[j]
        windows = mix(windows)
        for k in range(last - first):
            a, n = begins[k], counts[k]
            if n >= size:
                out = np.sort(windows[a : a + n - size + 1])
                if len(out) > 1:
                    out = out[np.concatenate([[True], out[1:] != out[:-1]])]
                yield out
            elif n:
                yield mix((hashes[a : a + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _SHORT[n : n + 1])
            else:
                yield np.zeros(0, np.uint64)
