"""Quality rules from repetition: suffix arrays over the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import MULTIPLIER, Words, mix, slices, text_bytes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SHORTEST = 6
MAX_COVERED_PERCENT = 30
MAX_LONGEST = 64
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_covered long, longest_repeat long"
)


def repetition_rules(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text",
    shortest: int = SHORTEST, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """Base counts, the repetition measures and the verdict of every row.

    A suffix array over a text's words gives, at each word, the longest passage that starts there and starts elsewhere in
    the text too (the larger of the two neighbouring common prefixes). n_covered counts words in the union of such maximal
    repeats of `shortest` words or more, longest_repeat is the longest of all. kept is false if a base rule fails, if more
    than max_covered_percent of the words are covered or the longest repeat is over max_longest words.
    Null and empty texts have zeros everywhere and fail the base. Rows repeat and ids may be null: each row is judged alone.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column):
                yield _judged(split, batch.column("doc_id").slice(a, b - a), *text_bytes(column.slice(a, b - a)), shortest, max_covered_percent, max_longest)

    return rows.mapInArrow(run, SCHEMA)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` between offsets."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def range_hashes(split: Words, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of sorted byte ranges of any length, from sums taken piece by piece."""
    step = len(split.power)
    bounds = np.unique(np.concatenate([starts, ends]))
    sums, inverse = np.zeros(len(bounds), dtype=np.uint64), np.ones(len(bounds), dtype=np.uint64)
    power, back, base = np.uint64(1), np.uint64(1), np.uint64(0)
    with np.errstate(over="ignore"):
        for a in range(0, len(data) + 1, step):
            part = data[a : a + step]
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(split.values[part] * split.power[: len(part)], out=total[1:])
            i, j = np.searchsorted(bounds, [a, a + step])
            at = bounds[i:j] - a
            sums[i:j] = base + power * total[at]
            inverse[i:j] = back * split.inverse[at]
            base = base + power * total[-1]
            power, back = power * split.power[-1] * np.uint64(MULTIPLIER), back * split.inverse[-1] * np.uint64(pow(MULTIPLIER, -1, 1 << 64))
    s, e = np.searchsorted(bounds, starts), np.searchsorted(bounds, ends)
    return mix((sums[e] - sums[s]) * inverse[s] + (ends - starts).astype(np.uint64))


def duplicate_lines(split: Words, data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), len(data))
    ends = np.where((ends > starts) & (data[ends - 1] == 10), ends - 1, ends) if len(data) else ends
    filled = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[filled], ends[filled]
    owner = np.searchsorted(offsets, starts, "right") - 1
    hashes = range_hashes(split, data, starts, ends)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    again = np.zeros(len(owner), dtype=bool)
    again[1:] = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    return np.bincount(owner[again], minlength=len(offsets) - 1)


def repeated_word_count(hashes: np.ndarray, owner: np.ndarray, firsts: np.ndarray, width: int) -> np.ndarray:
    """Per text, the words inside runs of `width` words that the text has twice or more."""
    n = len(hashes)
    cover = np.zeros(n + 1, dtype=np.int64)
    if n >= width:
        same = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
        total = owner[same].astype(np.uint64) + np.uint64(1)
        for k in range(width):
            total = total * np.uint64(MULTIPLIER) + hashes[same + k]
        total = mix(total)
        order = np.argsort(total, kind="stable")
        total = total[order]
        twin = np.zeros(len(total), dtype=bool)
        twin[1:] = total[1:] == total[:-1]
        twin[:-1] |= twin[1:]
        at = same[order[twin]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
    return per_text(np.cumsum(cover[:n]) > 0, firsts)


def longest_repeats(hashes: np.ndarray, owner: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For every word, the length of the longest passage that starts there and at another word of its text.

    The suffix array comes by prefix doubling over the suffixes that still share a rank; common prefixes of neighbours by
    halving over hashes of word runs, so nothing is kept per level."""
    n = len(hashes)
    longest = np.zeros(n, dtype=np.int64)
    if n == 0:
        return longest
    end = firsts[1:][owner]
    symbols = mix(hashes + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIER))
    order = np.argsort(symbols, kind="stable")
    fresh = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    counts = np.bincount(rank, minlength=n)
    active = order[counts[rank[order]] > 1]
    shared = np.sort(active)
    width = 1
    while len(active):
        follow = active + width
        inside = follow < end[active]
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[active]))
        active, second, group = active[by], second[by], rank[active][by]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        place = np.arange(len(active))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        rank[active] = group + np.maximum.accumulate(np.where(new, place, 0)) - start
        run = np.flatnonzero(new)
        size = np.diff(np.append(run, len(active)))
        active = active[np.repeat(size > 1, size)]
        width *= 2
    # `shared` are the suffixes whose first word repeats; neighbours in rank order hold the longest common prefixes.
    line = shared[np.argsort(rank[shared], kind="stable")]
    left, right = line[:-1], line[1:]
    near = owner[left] == owner[right] if len(line) > 1 else np.zeros(0, dtype=bool)
    left, right = left[near], right[near]
    if len(left) == 0:
        return longest
    power = np.full(n, MULTIPLIER, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(n, pow(MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * power, out=sums[1:])
    low, high = np.zeros(len(left), dtype=np.int64), np.minimum(end[left] - left, end[right] - right)
    while np.any(low < high):
        middle = (low + high + 1) // 2
        same = (sums[left + middle] - sums[left]) * inverse[left] == (sums[right + middle] - sums[right]) * inverse[right]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    np.maximum.at(longest, left, low)
    np.maximum.at(longest, right, low)
    return longest


def _judged(split: Words, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, shortest: int, max_covered: int, max_longest: int) -> pa.RecordBatch:
    starts, _, hashes, firsts = split.split(data, offsets)
    n_words = np.diff(firsts)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    characters = per_text(~split.blank[data] & ((data & 0xC0) != 0x80), offsets)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    repeat_words = repeated_word_count(hashes, owner, firsts, 3)
    longest = longest_repeats(hashes, owner, firsts)
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(longest >= shortest)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + longest[at], -1)
    covered = per_text(np.cumsum(cover[:-1]) > 0, firsts)
    top = np.zeros(len(n_words), dtype=np.int64)
    np.maximum.at(top, owner, longest)
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (100 * covered <= max_covered * n_words) & (top <= max_longest)
    columns = [n_words, characters, per_text(symbol[data], offsets), duplicate_lines(split, data, offsets, starts), repeat_words]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.record_batch(
        [ids, *(pa.array(c.astype(np.int64)) for c in columns), pa.array(failed), pa.array(kept), pa.array(covered), pa.array(top)], names=names
    )
