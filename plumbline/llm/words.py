"""Words of many texts at once, over the bytes of an Arrow column: no Python string is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
WORD_BREAKS = (9, 10, 11, 12, 13, 32)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of unsigned 64-bit numbers over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offset of each text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, limit: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges with about `limit` bytes of text each; a longer text is alone in its range."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


class Words:
    """Splits texts into words (runs without blanks) and hashes every word to 64 bits.

    A word's hash is a polynomial over random byte values, taken from running sums, so the cost per byte is a few
    vector operations. Long texts are taken in pieces that end at a blank, so memory beyond the text itself is bounded
    by the piece (or by the longest word).
    """

    def __init__(self, lower: bool = False) -> None:
        values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            values[65:91] = values[97:123]
        self.values = values
        self.blank = np.zeros(256, dtype=bool)
        self.blank[list(WORD_BREAKS)] = True
        self._grow(PIECE)

    def _grow(self, n: int) -> None:
        power, inverse = np.full(n, MULTIPLIER, dtype=np.uint64), np.full(n, pow(MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
        power[0] = inverse[0] = 1
        self.power, self.inverse = np.cumprod(power), np.cumprod(inverse)

    def pieces(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        start, n = 0, len(data)
        while start < n:
            end = min(start + PIECE, n)
            if end < n:
                cuts = np.flatnonzero(self.blank[data[start:end]])
                if len(cuts):
                    end = start + int(cuts[-1]) + 1
                else:
                    while end < n:
                        cuts = np.flatnonzero(self.blank[data[end : end + PIECE]])
                        if len(cuts):
                            end += int(cuts[0]) + 1
                            break
                        end = min(end + PIECE, n)
            yield start, end
            start = end

    def hashed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges of one piece."""
        if len(data) > len(self.power):
            self._grow(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte start, byte end and hash of every word, and for each text the number of its first word (one more entry closes)."""
        starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in self.pieces(data):
            part = data[a:b]
            word = ~self.blank[part]
            first = word.copy()
            first[1:] &= ~word[:-1]
            last = word.copy()
            last[:-1] &= ~word[1:]
            edges = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
            first[edges] = word[edges]
            edges = edges[edges > 0] - 1
            last[edges] = word[edges]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            starts.append(s + a)
            ends.append(e + a)
            hashes.append(self.hashed(part, s, e))
        s = np.concatenate(starts)
        return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, offsets, "left")


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; fewer words are one run, no words none."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, size)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(MULTIPLIER) + words[k : n - width + 1 + k]
    return mix(total)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=kind))
