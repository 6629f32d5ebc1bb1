"""Words of whole texts as NumPy arrays: boundaries, 64-bit hashes, windows.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 equals `[^\\x20\\x09-\\x0D]+` over
code points. Hashes are chains of 64-bit blocks through a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text worked on at once.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LENGTH, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Blocks that are chained in a row; a longer span is hashed by groups of so many, and then the groups' hashes.
GROUP = 32


def _blocks(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, bytes beyond `left` being 0; data are 64-bit words of the bytes."""
    shift = (at & 7).astype(np.uint64) << np.uint64(3)
    first = at >> 3
    block = data[first] >> shift
    block |= data[first + 1] << (np.uint64(63) - shift) << np.uint64(1)
    over = np.maximum(8 - left, 0).astype(np.uint64) << np.uint64(3)
    return block & (~np.uint64(0) >> over)


def _chained(data: np.ndarray, unit: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    state, live, done = mix(sizes.astype(np.uint64) * _LENGTH), np.flatnonzero(sizes > 0), 0
    while len(live):
        at = starts[live] + done
        block = data[at] if unit == 1 else _blocks(data, at, sizes[live] - done)
        state[live] = mix((state[live] ^ block) + _STEP)
        done += unit
        live = live[sizes[live] > done]
    return state


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[starts[i]:ends[i]], of bytes or of 64-bit hashes; spans may overlap.

    Blocks of eight bytes (or single hashes) are chained through the finaliser, which is not linear in them, so
    no pattern of a span's own cancels out; spans of eight bytes or less never collide with those of their length.
    """
    unit = 8 if data.dtype == np.uint8 else 1
    if unit == 8:
        padded = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
        padded[: len(data)] = data
        data = padded.view("<u8")
    sizes = ends - starts
    whole = GROUP * unit
    out = _chained(data, unit, starts, np.minimum(sizes, whole))
    long = np.flatnonzero(sizes > whole)
    if len(long):
        groups = -(-sizes[long] // whole)
        bounds = np.concatenate([[0], np.cumsum(groups)])
        inside = flat_ranges(np.zeros(len(long), np.int64), groups) * whole
        parts = _chained(data, unit, np.repeat(starts[long], groups) + inside, np.minimum(np.repeat(sizes[long], groups) - inside, whole))
        out[long] = mix(span_hashes(parts, bounds[:-1], bounds[1:]) ^ (sizes[long].astype(np.uint64) * _LENGTH))
    return out


@dataclass
class Texts:
    """Some whole texts end to end: text i is data[bounds[i]:bounds[i + 1]], its words are first[i]:first[i + 1]."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.n_words)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def find_words(data: np.ndarray, bounds: np.ndarray) -> Texts:
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] = inside[cut]  # no word goes on from one text into the next
    stop[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begin)
    return Texts(data, bounds, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, bounds))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, their words): whole texts, about `size` bytes at once."""
    if not len(column):
        return
    data, bounds = utf8(column)
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        part = data[bounds[at] : bounds[to]]
        yield at, to, find_words(LOWER[part] if lower else part, bounds[at : to + 1] - bounds[at])
        at = to


_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k hashes in a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _MULTIPLIERS[0]
    for j in range(1, k):
        total += hashes[j : j + n] * _MULTIPLIERS[j]
    return mix(total + np.uint64(k))


def inside_one_text(t: Texts, k: int) -> np.ndarray:
    """For every window of k words of the chunk, whether all its words are of one text."""
    doc = t.word_doc()
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = starts - (np.cumsum(lengths) - lengths)
    if total + int(starts.max()) < 1 << 31:
        return np.arange(total, dtype=np.int32) + np.repeat(at.astype(np.int32), lengths)
    return np.arange(total) + np.repeat(at, lengths)
