"""Vectorised word and shingle hashes over the UTF-8 bytes of Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; as the separators are ASCII, bytes give the
same words as characters do. Hashes have 64 bits: a sum over the word's bytes of a fixed random value of the byte times a
fixed random odd multiplier of its place, mixed by a finalizer. (A polynomial modulo 2 ** 64 would give long words of
opposite Thue-Morse order one hash.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Bytes worked on at once; a chunk ends with a document, a longer document is cut between words.
CHUNK_BYTES = 1 << 18

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_places = np.zeros(0, U)


def _place_multipliers(n: int) -> np.ndarray:
    global _places
    if len(_places) < n:
        _places = mix((np.arange(max(n, 4096), dtype=U) + U(1 << 32)) * BASE) | U(1)
    return _places


def byte_values(fold: np.ndarray) -> np.ndarray:
    """A fixed random value for each byte, equal for bytes that ``fold`` makes equal."""
    return mix((fold.astype(U) + U(1)) * BASE)


def prefix_sums(buf: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``len + 1`` sums whose difference over a word, which begins at one of ``starts``, is the word's hash before mixing."""
    sums = np.zeros(len(buf) + 1, U)
    if len(starts):
        # places count on through the separators after a word, which no word sums up
        bounds = np.concatenate([[0], starts, [len(buf)]])
        place = np.arange(len(buf)) - np.repeat(bounds[:-1], np.diff(bounds))
        np.cumsum(values[buf] * _place_multipliers(int(place.max()) + 1)[place], out=sums[1:])
    return sums


def utf8_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the ``len + 1`` offsets of a string array; a null is an empty text."""
    if pa.types.is_large_string(texts.type) or pa.types.is_string(texts.type):
        arr = texts if texts.null_count == 0 else texts.fill_null("")
    else:
        arr = texts.cast(pa.large_string()).fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


WORD_VALUES = byte_values(LOWER)


def _hash_words(buf: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and past-the-end positions of the words; no word spans a position in ``doc_starts``."""
    inside = ~IS_SEPARATOR[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at_start = doc_starts[doc_starts < len(buf)]
    first[at_start] |= inside[at_start]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = at_start[at_start > 0] - 1
    last[before] |= inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix_sums(buf, starts, WORD_VALUES)
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(U)), starts, ends


def iter_word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, document past the end, word hashes, words of each document), a chunk at a time."""
    data, offsets = utf8_buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        buf = data[offsets[lo] : offsets[hi]]
        if len(buf) > 4 * CHUNK_BYTES:  # one long document
            hashes = _long_document(buf)
            yield lo, hi, hashes, np.array([len(hashes)])
        else:
            bounds = offsets[lo : hi + 1] - offsets[lo]
            hashes, starts, _ = _hash_words(buf, bounds[:-1])
            yield lo, hi, hashes, np.diff(np.searchsorted(starts, bounds))
        lo = hi


def _long_document(buf: np.ndarray) -> np.ndarray:
    parts, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + CHUNK_BYTES)
        while end < len(buf):  # on to the next separator, so that no word is cut
            gaps = np.flatnonzero(IS_SEPARATOR[buf[end : end + CHUNK_BYTES]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(buf), end + CHUNK_BYTES)
        parts.append(_hash_words(buf[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(parts)


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, repeats included, and their number for each document.

    A document of fewer words (one at least) has one shingle: the whole sequence.
    """
    n = len(hashes)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if n == 0:
        return np.zeros(0, U), sizes
    multipliers = mix(np.arange(1, k + 1, dtype=U) * BASE) | U(1)
    ends = np.cumsum(counts)
    starts = ends - counts
    total = np.zeros(n, U)
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the document's end
    for i in range(k):
        m = n - i
        if m <= 0:
            break
        term = hashes[i:] * multipliers[i]
        total[:m] += np.where(left[:m] > i, term, U(0))
    keep = left >= k
    short = (counts > 0) & (counts < k)
    keep[starts[short]] = True
    if short.any():  # the length keeps a short sequence apart from a longer one's shingle
        total[starts[short]] += mix(counts[short].astype(U) + U(77))
    return mix(total[keep]), sizes
