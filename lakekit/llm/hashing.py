"""Hashes of words and word windows of UTF-8 bytes, in whole-array operations.

A word is the sum of one mixed value for each of its bytes and their place in it, a window is made of windows half as
long, each step mixed again. Neither is a polynomial, so no regular text makes different words or windows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ODD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def is_space(data: np.ndarray) -> np.ndarray:
    """Where the bytes are one of the six ASCII white-space characters."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of each maximal run without ASCII white space."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~is_space(data)
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """One 64-bit value per word; ``which`` chooses one of two independent ones."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    sizes = ends - starts
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters = data[place + np.repeat(starts, sizes)].astype(np.uint64)
    values = mix((place.astype(np.uint64) << np.uint64(8) | letters) + np.uint64(_SALTS[which]))
    sums = np.add.reduceat(values, np.cumsum(sizes) - sizes)
    return mix(sums + sizes.astype(np.uint64) * np.uint64(_ODD[which]))


def window_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """One 64-bit value per window of ``length`` consecutive words; none if there are fewer words."""
    count = len(words) - length + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    odd = np.uint64(_ODD[which])
    power, width = mix(words + np.uint64(_SALTS[which])), 1
    whole, done = None, 0
    while True:
        if length & width:
            part = power[done : done + count]
            whole = part if whole is None else mix(whole * odd + part)
            done += width
        if done == length:
            return whole
        power, width = mix(power[:-width] * odd + power[width:]), 2 * width


def shingles(data: np.ndarray, length: int) -> np.ndarray:
    """The distinct window values of a text, ascending; all its words as one if it has fewer."""
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(length, len(words))))


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each value of a string column without copies; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    valid, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    known = np.ones(len(column), dtype=bool) if valid is None else np.asarray(column.is_valid())
    for row in range(len(column)):
        yield content[places[row] : places[row + 1]] if known[row] else content[:0]
