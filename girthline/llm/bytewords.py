"""Words and word shingles of whole Arrow columns of text, hashed with numpy over the raw UTF-8 bytes.

Runs inside Spark tasks only. A column is worked on in slices of a few megabytes, so that memory is bounded by the slice or
by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
SHINGLE = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: A span beyond this many bytes is hashed by itself.
LONG = 256
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word: everything but white space, or letters and digits and all beyond ASCII (capitals count as their small form).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits evenly."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and where each text begins; null counts as empty."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    strings = pc.fill_null(strings.cast(pa.large_string()), "")
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def slices(strings: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts of about ``SLICE_BYTES``, each as ``flat`` gives it."""
    data, at = flat(strings)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        yield data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lowered: bool, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: its 64-bit words are mixed in one after the other, in steps over all spans.

    For one length a step is a bijection of the word, so spans of up to 8 bytes and equal length never collide, and longer ones only by
    chance (2^-64 for two spans). Spans beyond ``LONG`` bytes are hashed by BLAKE2b. Another ``seed`` gives an independent hash.
    """
    data = np.append(LOWER[data] if lowered else data, np.zeros(8, np.uint8))
    loads = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64) * _BASE + np.uint64(seed * 2 + 1))
    live, step = np.flatnonzero((length > 0) & (length <= LONG)), 0
    while len(live):
        word = loads[starts[live] + step] & _LOW[np.minimum(length[live] - step, 8)]
        step += 8
        out[live] = mix((out[live] ^ word) * _BASE)
        live = live[length[live] > step]
    for i in np.flatnonzero(length > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts, and for each text where its words begin among them."""
    in_word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], in_word[:-1])) if len(data) else in_word
    after = np.concatenate((in_word[1:], [False])) if len(data) else in_word
    starts = np.flatnonzero(in_word & (~before | edge[:-1]))
    ends = np.flatnonzero(in_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def _fold(words_of: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    x = np.full(len(starts), 0x51ED270B * length + 1, np.uint64)
    for j in range(length):
        x = mix(x * _BASE + words_of[starts + j])
    return x


def shingle_sets(strings: pa.Array, inside: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles, letters A-Z lowered.

    A text with fewer words has its whole sequence as the only shingle, a text without words or a null has none.
    """
    for data, at in slices(strings):
        starts, ends, first = words(data, at, inside)
        hashed = span_hashes(data, starts, ends, True)
        windows = _fold(hashed, np.arange(max(0, len(hashed) - k + 1)), k)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= k:
                yield np.unique(windows[lo:hi - k + 1])
            elif hi > lo:
                yield _fold(hashed, np.array([lo]), hi - lo)
            else:
                yield np.zeros(0, np.uint64)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of one numpy array for each row."""
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
