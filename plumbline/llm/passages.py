"""Removal of passages that repeat anywhere in the corpus, with sharded Aho-Corasick automata.

A window is `window` consecutive words of one text. Every window has an anchor: the least hash of the runs of ANCHOR words in it.
Equal windows have equal anchors at equal places, so a window can repeat only where its anchor does, and one row per anchor
(about one for fourteen words) instead of one per window goes through the cluster.

1. The windows that share an anchor's place make a stretch. Stretches that occur twice as they are repeat as a whole.
2. Of the others whose anchor repeats, the windows that repeat are confirmed among all stretches of that anchor; an anchor with
   very many is dealt out, and all its windows are counted over the parts.
3. The first and last window of every confirmed run are patterns, and so are windows that several parts hold. Patterns are sharded by anchor; each shard is compiled into
   an Aho-Corasick automaton over words, and all stretches of the shard's anchors stream through it in as many tasks as their
   number asks for. Patterns and texts are compared by 32 bits a word.
4. A text's removed words are the union of what was located.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_small, row_key, stored
from plumbline.llm.words import MULTIPLIER, Words, mix, slices, text_bytes

WINDOW = 35
ANCHOR = 8
DEALT = 4_000
SHARD_PATTERNS = 20_000
STREAM_ROWS = 40_000


def drop_repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, dealt: int = DEALT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space) of every row.

    A word goes if a window of `window` words that covers it has its word sequence somewhere else too, in this text or another;
    windows are judged on the input. Words are runs without blanks, unchanged. Null and empty texts have no word, remove
    nothing and have the hash of the empty text; texts of fewer words than a window stay whole. Rows that repeat remove each
    other's words, ids may be null.
    """
    docs = df.select(row_key(doc_id, text).alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = stored(docs.mapInArrow(_anchors(window), "rid long, doc_id long, n_words long, sha string, h array<long>, sh array<long>, a array<int>, m array<int>"))
    flagged = stored(_repeated_anchors(first, dealt))

    whole = flagged.where("c > 1").select("rid", F.col("a").alias("low"), F.expr(f"a + m + {window - 1}").alias("high"))
    asked = flagged.where("c = 1 or (singles > 0 and leads)")
    asked = asked.groupBy("rid").agg(F.collect_set(F.struct("h", "parts", "a", "m")).alias("asked"))
    texts = _one_of_equal(docs.select("rid", "text"), first)
    stretches = stored(texts.join(asked, "rid").mapInArrow(_stretches(window), "h long, parts int, rid long, a int, code binary"))
    located = _located(stretches, window)

    covered = whole.unionByName(located).groupBy("rid").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    covered = stored(covered)
    changed = texts.join(covered, "rid").mapInArrow(_removed, "rid long, n_removed long, kept string")
    out = first.select("rid", "doc_id", "n_words", "sha").join(changed, "rid", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def _one_of_equal(texts: DataFrame, first: DataFrame) -> DataFrame:
    """`texts` with one row of those that repeat as they are; only the texts of these are shuffled."""
    repeated = stored(first.groupBy("rid").count().where("count > 1").select("rid"))
    n = repeated.count()
    if n == 0:
        return texts
    alone = join_small(texts, repeated, ["rid"], "left_anti", n)
    return alone.unionByName(join_small(texts, repeated, ["rid"], "left_semi", n).dropDuplicates(["rid"]))


def runs(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` values, whichever text they are from; none where there are fewer values."""
    if len(values) < width:
        return values[:0]
    total = np.zeros(len(values) - width + 1, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(MULTIPLIER) + values[k : len(values) - width + 1 + k]
    return mix(total)


def digests(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> list[str]:
    """SHA-256 of each text's kept words, joined by one space."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts[keep]] += 1
    edge[ends[keep]] -= 1
    held = np.cumsum(edge[:-1], dtype=np.int8) > 0
    inner = np.zeros(len(data) + 1, dtype=bool)
    inner[offsets] = True
    after = ends[keep]
    after = after[~inner[after]]
    plain = data.copy()
    held[after], plain[after] = True, 32
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(held, out=total[1:])
    plain, at = plain[held].tobytes(), total[offsets].tolist()
    return [hashlib.sha256(plain[a:b].rstrip(b" ")).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        for batch in batches:
            column = batch.column("text")
            for x, y in slices(column):
                data, offsets = text_bytes(column.slice(x, y - x))
                starts, ends, hashes, firsts = split.split(data, offsets)
                sha = digests(data, offsets, starts, ends, np.ones(len(starts), dtype=bool))
                n = np.diff(firsts)
                h, sh, a, m, owner = anchors(hashes, firsts, window)
                at = np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (h.view(np.int64), sh.view(np.int64), a.astype(np.int32), m.astype(np.int32))]
                part = batch.slice(x, y - x)
                yield pa.record_batch(
                    [part.column("rid"), part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(sha, pa.string()), *lists],
                    names=["rid", "doc_id", "n_words", "sha", "h", "sh", "a", "m"],
                )

    return run


def anchors(hashes: np.ndarray, firsts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of every stretch: anchor, hash of its words, first window (as a word number in its text), number of windows, text."""
    n = np.diff(firsts)
    grams = runs(hashes, ANCHOR)
    span = window - ANCHOR + 1
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(grams) < span:
        return none
    owner = np.repeat(np.arange(len(n)), n)
    valid = owner[: len(hashes) - window + 1] == owner[window - 1 :]
    at = np.flatnonzero(valid)
    if len(at) == 0:
        return none
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    place = np.concatenate([at[i : i + 65536] + view[at[i : i + 65536]].argmin(axis=1) for i in range(0, len(at), 65536)])
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    start = at[begin]
    power, inverse = np.full(len(hashes) + 1, MULTIPLIER, dtype=np.uint64), np.full(len(hashes) + 1, pow(MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[:-1], out=sums[1:])
    stop = start + count + window - 1
    whole = mix((sums[stop] - sums[start]) * inverse[start] + count.astype(np.uint64))
    return grams[place[begin]], whole, start - firsts[owner[start]], count, owner[start]


def _repeated_anchors(first: DataFrame, dealt: int) -> DataFrame:
    """Stretches whose anchor occurs again: with the count of equal stretches, and whether it leads them."""
    stretch = first.select("rid", F.explode(F.arrays_zip("h", "sh", "a", "m")).alias("x")).select("rid", "x.*")
    kinds = stretch.groupBy("h", "sh").agg(F.count("*").alias("c"), F.min(F.struct("rid", "a")).alias("first"))
    totals = kinds.groupBy("h").agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("singles"), F.count("*").alias("kinds")).where("total > 1")
    kinds = kinds.join(totals, "h").select("h", "sh", "c", "first", "singles", F.ceil(F.col("kinds") / dealt).cast("int").alias("parts"))
    leads = (F.col("first.rid") == F.col("rid")) & (F.col("first.a") == F.col("a"))
    return stretch.join(kinds, ["h", "sh"]).select("rid", "h", "a", "m", "c", "singles", "parts", leads.alias("leads"))


def _stretches(window: int):
    """The words of the asked stretches, as 32 bits of each word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        for batch in batches:
            column = batch.column("text")
            for x, y in slices(column):
                _, _, hashes, firsts = split.split(*text_bytes(column.slice(x, y - x)))
                codes = (hashes >> np.uint64(32)).astype(np.uint32)
                out: list[list] = [[], [], [], [], []]
                for rid, base, asked in zip(batch.column("rid").slice(x, y - x).to_pylist(), firsts[:-1].tolist(), batch.column("asked").slice(x, y - x), strict=True):
                    fields = [asked.values.field(k).to_numpy() for k in ("h", "parts", "a", "m")]
                    for h, parts, a, m in zip(*(f.tolist() for f in fields), strict=True):
                        for held, value in zip(out, (h, parts, rid, a, codes[base + a : base + a + m + window - 1].tobytes()), strict=True):
                            held.append(value)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["h", "parts", "rid", "a", "code"])

    return run


def _windows(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the stretches in a row; of every window its hash, its stretch and its first word."""
    code = table.column("code").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(code.buffers()[1], dtype=np.int64)[code.offset : code.offset + len(code) + 1]
    words = np.frombuffer(code.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint32)
    firsts = (offsets - offsets[0]) // 4
    owner = np.repeat(np.arange(len(code)), np.diff(firsts))
    hashes = runs(mix(words.astype(np.uint64)), window)
    at = np.flatnonzero(owner[: len(words) - window + 1] == owner[window - 1 :])
    return words, hashes[at], owner[at], at


def _confirm(window: int):
    """Patterns of the stretches of a part, and, of anchors that are dealt over several parts, every other window once a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        h, parts = table.column("h").to_numpy(), table.column("parts").to_numpy()
        words, hashes, owner, at = _windows(table, window)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        twin = np.zeros(len(ordered), dtype=bool)
        twin[1:] = ordered[1:] == ordered[:-1]
        twin[:-1] |= twin[1:]
        again = np.zeros(len(ordered), dtype=bool)
        again[order] = twin
        joined = again[1:] & again[:-1] & (owner[1:] == owner[:-1])
        edge = again & ~(np.concatenate([[False], joined]) & np.concatenate([joined, [False]]))
        # A window inside a run here may be single in another part, which then needs it as a pattern.
        for pick, settled in ((np.flatnonzero(edge), True), (np.flatnonzero(~edge & (parts[owner] > 1)), False)):
            _, one = np.unique(hashes[pick], return_index=True)
            pick = pick[one]
            for i in range(0, len(pick), 20_000):
                k = pick[i : i + 20_000]
                code = [words[x : x + window].tobytes() for x in at[k].tolist()]
                yield pa.record_batch(
                    [pa.array(hashes[k].view(np.int64)), pa.array(h[owner[k]]), pa.array(code, pa.binary()), pa.array(np.full(len(k), settled))], names=["w", "h", "pattern", "settled"]
                )

    return run


def _located(stretches: DataFrame, window: int) -> DataFrame:
    """(rid, low, high) of the words in windows that repeat."""
    dealt = stretches.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    found = dealt.repartition("h", "part").mapInArrow(_confirm(window), "w long, h long, pattern binary, settled boolean")
    patterns = found.groupBy("w").agg(F.count("*").alias("c"), F.max("settled").alias("settled"), F.first("h").alias("h"), F.first("pattern").alias("pattern"))
    patterns = stored(patterns.where("settled or c > 1").select("h", "pattern"))
    n_patterns, n_stretches = patterns.count(), stretches.count()
    shards = max(1, -(-n_patterns // SHARD_PATTERNS))
    salts = max(1, -(-n_stretches // (shards * STREAM_ROWS)))
    left = patterns.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"), "pattern")
    right = stretches.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("rid", "a"), F.lit(salts)).alias("salt"), "rid", "a", "code")
    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(_stream(window), "rid long, low int, high int")


def as_text(code: bytes) -> str:
    """One character a word, from 20 bits of its hash."""
    return ((np.frombuffer(code, dtype=np.uint32) & np.uint32(0xFFFFF)) + np.uint32(0x10000)).tobytes().decode("utf-32-le")


def _stream(window: int):
    def run(patterns: pa.Table, stretches: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], []]
        if patterns.num_rows and stretches.num_rows:
            automaton: dict[str, set[bytes]] = {}
            for pattern in patterns.column("pattern").to_pylist():
                automaton.setdefault(as_text(pattern), set()).add(pattern)
            machine = ahocorasick.Automaton()
            for key, exact in automaton.items():
                machine.add_word(key, exact)
            machine.make_automaton()
            for rid, a, code in zip(stretches.column("rid").to_pylist(), stretches.column("a").to_pylist(), stretches.column("code").to_pylist(), strict=True):
                low = high = -1
                for last, exact in machine.iter(as_text(code)):
                    begin = last - window + 1
                    if code[4 * begin : 4 * last + 4] in exact:
                        if begin > high:
                            if high >= 0:
                                _add(out, rid, a + low, a + high)
                            low = begin
                        high = last + 1
                if high >= 0:
                    _add(out, rid, a + low, a + high)
        return pa.table({"rid": pa.array(out[0], pa.int64()), "low": pa.array(out[1], pa.int32()), "high": pa.array(out[2], pa.int32())})

    return run


def _add(out: list[list[int]], *values: int) -> None:
    for column, value in zip(out, values, strict=True):
        column.append(value)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = Words()
    for batch in batches:
        column = batch.column("text")
        for x, y in slices(column):
            data, offsets = text_bytes(column.slice(x, y - x))
            starts, ends, _, firsts = split.split(data, offsets)
            cover = np.zeros(len(starts) + 1, dtype=np.int64)
            for base, spans in zip(firsts[:-1].tolist(), batch.column("spans").slice(x, y - x), strict=True):
                np.add.at(cover, spans.values.field("low").to_numpy() + base, 1)
                np.add.at(cover, spans.values.field("high").to_numpy() + base, -1)
            gone = np.cumsum(cover[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            yield pa.record_batch(
                [batch.column("rid").slice(x, y - x), pa.array((total[firsts[1:]] - total[firsts[:-1]]).astype(np.int64)), pa.array(digests(data, offsets, starts, ends, ~gone), pa.string())],
                names=["rid", "n_removed", "kept"],
            )
