"""Bidirectional FM-index of a sequence of word numbers, and the n-grams that its intervals spell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Side:
    """One direction: rows are the suffixes in the order of their first `depth` symbols, `bwt` the symbol before each.

    The order of deeper symbols is never asked for: an interval of a pattern of m symbols is right as soon as rows are sorted
    by their first m symbols, and so is the rank that extends it by one."""

    def __init__(self, seq: np.ndarray, depth: int) -> None:
        n = len(seq)
        self.bwt = np.roll(seq, 1)[np.argsort(_order(seq, depth), kind="stable")]
        by_symbol = np.argsort(self.bwt, kind="stable")
        self.places = self.bwt[by_symbol] * n + by_symbol
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=int(seq.max(initial=0)) + 1))])

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """C[symbol] + rank(symbol, row): where the interval begins that puts `symbol` before the one beginning at `row`."""
        return np.searchsorted(self.places, symbol * len(self.bwt) + row)


def _order(seq: np.ndarray, depth: int) -> np.ndarray:
    """A number per place that sorts like the `depth` symbols from it on; beyond the end stand zeros."""
    order, known = seq, 1
    while known < depth:
        ahead = min(known, depth - known)
        # `order` covers `known` symbols from a place; the same numbers `ahead` places on cover `ahead` more.
        shifted = np.zeros_like(order)
        shifted[: max(len(order) - ahead, 0)] = order[ahead:]
        order = np.unique(order * (int(shifted.max(initial=0)) + 1) + shifted, return_inverse=True)[1].astype(np.int64)
        known += ahead
    return order


class FmIndex:
    """Both directions of a sequence; symbol 0 separates and belongs to no pattern.

    A pattern is an interval of `size` rows that begins at `lo` in the forward index and at `rlo` in the reverse one. Extending
    a pattern reads the symbols before its rows in one direction and moves both intervals along."""

    def __init__(self, seq: np.ndarray, depth: int) -> None:
        seq = np.concatenate([np.asarray(seq, dtype=np.int64), [0]])
        self.forward, self.reverse = Side(seq, max(depth - 1, 1)), Side(seq[::-1], max(depth - 1, 1))
        self.symbols = len(self.forward.first) - 1

    def ngrams(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to `depth` words: the patterns as a table of symbols, one row each, and how often each occurs. Patterns grow to
        the right and to the left in turn."""
        first = self.forward.first
        words = np.arange(1, self.symbols, dtype=np.int64)
        lo = rlo = first[1:-1]
        size = np.diff(first)[1:]
        live = size > 0
        words, lo, rlo, size = words[live][:, None], lo[live], rlo[live], size[live]
        yield words, size
        for k in range(2, depth + 1):
            if k % 2:
                pattern, symbol, lo, rlo, size = self.extend(self.forward, lo, rlo, size)
                words = np.hstack([symbol[:, None], words[pattern]])
            else:
                pattern, symbol, rlo, lo, size = self.extend(self.reverse, rlo, lo, size)
                words = np.hstack([words[pattern], symbol[:, None]])
            yield words, size

    def extend(self, side: Side, lo: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every pattern with every symbol found before its rows on `side`: pattern and symbol, the interval on that side, on
        the other side, and its size."""
        pattern = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(pattern)) - np.repeat(np.cumsum(size) - size, size)
        key = np.sort(pattern * self.symbols + side.bwt[np.repeat(lo, size) + within])
        start = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(start, append=len(key))
        pattern, symbol = key[start] // self.symbols, key[start] % self.symbols
        # On the other side the rows of a pattern are sorted by just these symbols.
        smaller = start - (np.cumsum(size) - size)[pattern]
        real = symbol > 0
        pattern, symbol, count, smaller = pattern[real], symbol[real], count[real], smaller[real]
        return pattern, symbol, side.step(symbol, lo[pattern]), other[pattern] + smaller, count
