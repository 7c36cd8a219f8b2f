"""Arrow string arrays seen as bytes and words, by whole-array operations.

A word is a run of bytes that holds no ASCII white space. Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


SLICE_BYTES = 2 << 20  # of text that whole-array operations take at once; a longer text is taken alone
SLICE_ROWS = 1024


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and text bytes, so that what is worked out from them stays small."""
    sizes = np.cumsum(np.diff(flat(batch.column(text))[1]))
    begin = 0
    while begin < batch.num_rows:
        upto = sizes[begin - 1] if begin else 0
        end = min(max(int(np.searchsorted(sizes, upto + most_bytes, "right")), begin + 1), begin + most_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each text begins (and the last ends)."""
    array = array.cast(pa.large_binary())
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each word, in order."""
    inside = ~SPACE[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & (first | ~np.r_[False, inside[:-1]]))
    last = np.zeros(len(data), bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & (last | ~np.r_[inside[1:], False])) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    powers = np.multiply.accumulate(np.full(int(lengths.max()), BASE, np.uint64))
    firsts = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    codes = BYTE_CODES[data[at + np.repeat(starts, lengths)]] * powers[at]
    return mix(np.add.reduceat(codes, firsts))
